"""Quality classifier: hashed word, word pair and subword n-gram vectors averaged per document, softmax output, numpy SGD."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlake.llm.common import sliced

#: Subwords: byte n-grams of one word, with the white space before and behind it as its border marks; buckets of each kind
#: of feature, and the length of a vector.
GRAMS, BUCKET_BITS, DIMENSIONS = (2, 3, 4), 16, 8
#: Labelled rows the model is fitted on, at most, of each class (those with the least hash of their id).
MAX_TRAIN_PER_CLASS = 1500
EPOCHS, RATE, VECTOR_RATE, SEED = 4, 0.5, 20.0, 20
#: Text whose features are held at once; a longer text is taken in parts that end at white space.
CHUNK_BYTES = 1 << 19
#: Kinds of features: the n-grams, words, word pairs.
KINDS = len(GRAMS) + 2
_BASE = np.uint64(0x100000001B3)  # odd, so that it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + np.int32(kind << BUCKET_BITS)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of at most CHUNK_BYTES that end after white space where there is any."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        cut = max(text.rfind(b" ", at, at + CHUNK_BYTES), text.rfind(b"\n", at, at + CHUNK_BYTES)) + 1
        cut = cut if cut > at else at + CHUNK_BYTES
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: (buckets, first, last): part i has buckets[first[i]:last[i]]."""
    raw = b"".join(parts)
    size = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(size)
    start = end - size
    text = np.frombuffer(raw + bytes(8), np.uint8)
    with np.errstate(over="ignore"):
        space = _SPACE[text[: len(raw)]]
        marked = np.where(_SPACE[text], np.uint8(32), text)  # one border mark
        word = np.ndarray((len(raw),), "<u8", marked, 0, (1,))
        for kind, n in enumerate(GRAMS):
            # windows with white space inside span two words, those of white space at both ends and no more say nothing
            inside = np.zeros(len(raw), bool)
            for i in range(1, n - 1):
                inside[: len(raw) - i] |= space[i:]
            if n == 2:
                inside[:-1] |= space[:-1] & space[1:]
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(~inside)])
            yield _bucket(word[~inside] & np.uint64((1 << 8 * n) - 1), kind), upto[start], upto[np.maximum(end - n + 1, start)]
        # whole words: differences of a running polynomial, scaled back to the word's own place
        solid = ~_SPACE[text[: len(raw)]]
        edge = np.zeros(len(raw) + 1, bool)
        edge[start[size > 0]] = True
        first = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]][: len(raw)]))
        edge[:] = False
        edge[end[size > 0]] = True
        last = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True][: len(raw)])) + 1
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text[: len(raw)] + np.uint64(1)) * _powers(_BASE, len(raw))[:-1])])
        h = (running[last] - running[first]) * _powers(_INVERSE, len(raw))[first]
        h ^= h >> np.uint64(32)
    lo, hi = np.searchsorted(first, start), np.searchsorted(first, end)
    yield _bucket(h, len(GRAMS)), lo, hi
    # pairs of neighbouring words, hashed by what tells them apart: all repetitions of a word share one bucket
    yield _bucket(h[1:] ^ h[:-1], len(GRAMS) + 1), lo, np.maximum(hi - 1, lo)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a whole document: how its averaged vector is made of feature vectors."""
    got = [b[f[0]: l[0]] for part in _parts(text) for b, f, l in features([part])]
    bucket, count = np.unique(np.concatenate(got), return_counts=True)
    return bucket, (count / max(1, count.sum())).astype(np.float32)


def gradient(share: np.ndarray, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray, y: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, and its gradient by vectors, output and bias) of one document: softmax over the mean of its feature vectors."""
    mean = share @ vectors
    z = output @ mean + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -math.log(max(float(p[y]), 1e-300))
    p[y] -= 1
    return loss, np.outer(share, p @ output), np.outer(p, mean), p


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): the log-odds of label 1 are the bias and the mean weight of a document's features.

    Vectors and output layer are learned by plain stochastic gradient descent
    from documents as (buckets, shares); as the document vector is a mean,
    vectors times output weights give one number a bucket for scoring. Classes
    weigh alike. A document's step is spread over thousands of vectors, so
    these have a rate of their own.
    """
    rng = np.random.default_rng(SEED)
    rows = KINDS << BUCKET_BITS
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (rows, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    y = np.array(labels)
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = np.float32((1 - done / steps) * weight[y[i]])
            done += 1
            bucket, share = bags[i]
            _, by_vectors, by_output, by_bias = gradient(share, vectors[bucket], output, bias, y[i])
            output -= rate * RATE * by_output
            bias -= rate * RATE * by_bias
            vectors[bucket] -= rate * VECTOR_RATE * by_vectors
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def score(texts: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text (a text without features: that of the bias)."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    held, owner, size = [], [], 0

    def add() -> None:
        of = np.array(owner)
        for bucket, first, last in features(held):
            some = np.flatnonzero(last > first)
            if not len(some):
                continue
            bounds = np.stack([first[some], last[some]], axis=1).ravel()
            values = np.concatenate([weight[bucket].astype(np.float64), np.zeros(1)])
            np.add.at(total, of[some], np.add.reduceat(values, bounds)[::2])
            np.add.at(count, of[some], last[some] - first[some])

    for i, text in enumerate(texts):
        for part in _parts(text):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= CHUNK_BYTES:
                add()
                held, owner, size = [], [], 0
    if held:
        add()
    return 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(count, 1), -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = MAX_TRAIN_PER_CLASS) -> tuple[np.ndarray, float]:
    """The model, fitted in one task on at most ``per_class`` rows of each class that are not held out.

    Texts become bags of buckets where they are read, so the fitting task
    holds 8 bytes for each distinct feature of a document (at most 2.6 MB,
    however long the text) and no text.

    Labels that are null or neither 0 nor 1 are left out; of several labels
    of a document the lowest counts. Without rows of both classes the model is
    neutral (every score 0.5).
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    order = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"))
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = chosen[0].unionAll(chosen[1]).select(F.col("doc_id").alias("id"), "y")
    texts = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("id")).select(
        "id", F.col("text").cast("string").alias("text"), "y").dropDuplicates(["id"])

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16):
            bags = [_bag(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("y"), pa.array([b.tobytes() for b, _ in bags], pa.binary()),
                                   pa.array([s.tobytes() for _, s in bags], pa.binary())], names=["id", "y", "bucket", "share"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for batch in sliced(batches, 16)
                for i, y, b, s in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "bucket", "share")))]
        rows.sort(key=lambda r: r[0])
        if len({r[1] for r in rows}) == 2:
            weight, bias = train([r[2:] for r in rows], [r[1] for r in rows])
            yield pa.record_batch([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], names=["weight", "bias"])

    kind = dict(texts.dtypes)["id"]
    bagged = texts.mapInArrow(bag, f"id {kind}, y int, bucket binary, share binary")
    model = bagged.repartition(1).mapInArrow(one, "weight binary, bias double").collect()  # one row of a fixed size
    if not model:
        return np.zeros(KINDS << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(bytes(model[0]["weight"]), np.float32), model[0]["bias"]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = MAX_TRAIN_PER_CLASS) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted) from its whole text alone.

    Null and empty texts have no feature and get the bias's score. A row with
    a null doc_id is scored and not held out. Repeated rows are scored each;
    other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, per_class))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            scores = score(texts, *model.value)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                                   pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
            .mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int"))
