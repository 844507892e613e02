"""Exact substring deduplication across documents with partitioned suffix arrays (deep-shallow sorting).

Every window of ``length`` bytes is dealt to the bucket of its minimizer (the
least hash of its 16-byte substrings), which depends on the window's bytes
only: equal windows of all documents meet in one bucket. Neighbouring windows
with one minimizer travel together as one segment, so a text costs about 3.7
times its bytes before compression, whatever the data. In a bucket the
suffixes of the segments that share a minimizer are sorted to ``length``
bytes; equal ones are ordered by document.

A minimizer with very many different segments (the edges of a passage that
very many documents have, each between other bytes) would be one task's work.
Such minimizers are counted first; their windows are dealt one by one, by a
hash of their own bytes, so that equal windows still meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.llm.common import NO_ID, fresh, long_id, materialize, release_memory, sliced
from statlake.llm.deep_shallow import equal_suffixes

LENGTH = 50
#: Bytes under one hash of the minimizer, and the longest run of windows in one segment (a longer run is cut).
GRAM, MAX_RUN = 16, 200
#: Text hashed at once, text whose segments are dealt together (larger blobs compress better), text of a bucket sorted at once.
HASH_BYTES, BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 12 << 20, 3 << 20
BUCKETS_PER_PARTITION, LEVEL = 4, 6
#: One segment: document and text key (number in the blob's list), place of its first window, windows, 24 bits of the
#: minimizer's hash (two that agree share a group: more to sort, the same result); then its place in the bucket's bytes.
_SEGMENT = np.dtype([("doc", "<u4"), ("pos", "<i8"), ("run", "u1"), ("low", "<u4")])
_PLACED = np.dtype([*_SEGMENT.descr, ("at", "<i8")])
#: Different segments from which a minimizer's windows are dealt one by one, different segments in one block of text from
#: which a minimizer is counted at all, and minimizers in the list. They only say where windows meet; the result is the same.
HOT_SEGMENTS, LOCAL_SEGMENTS, HOT_MINIMIZERS = 1 << 15, 4, 100_000
_NONE = np.empty(0, np.uint64)
_SPAN = np.dtype([("start", "<i8"), ("end", "<i8")])
_SPAN_OF = np.dtype([("doc", "<u4"), ("start", "<i8"), ("end", "<i8")])


def window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """The minimizer hash of the window at each place of ``text`` (places with a whole window)."""
    n = len(text) - length + 1
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.ndarray((len(text),), "<u8", padded, 0, (1,))
    h = word[: len(text) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[GRAM - 8: len(text) - 7]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:  # least of 2 * span neighbours from the least of span
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[width - span: width - span + n])


def _pieces(ids: list[int], keys: list[int], texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(document, text key, offset, bytes) of at most HASH_BYTES windows; a longer text gives several that overlap by length - 1."""
    for i, key, text in zip(ids, keys, texts):
        for at in range(0, len(text) - length + 1, HASH_BYTES):
            yield i, key, at, text[at: at + HASH_BYTES + length - 1]


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers by byte planes (all lowest bytes, then the next): small ones compress to little."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), at + n * width


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def _pack(segments: np.ndarray, raw: bytes, spans: np.ndarray, docs: np.ndarray) -> bytes:
    """One compressed blob: documents, segments, spans already decided, the segments' bytes one after the other."""
    used = np.unique(np.concatenate([segments["doc"], spans["doc"]]))
    head = np.array([len(used), len(segments), len(spans)], "<i8").tobytes()
    doc = np.searchsorted(used, segments["doc"])
    parts = [_planes(_steps(docs[used, 0]), "<i8"), _planes(docs[used, 1], "<i8"), _planes(_steps(doc), "<i4"),
             *(_planes(segments[c], _SEGMENT[c].str) for c in ("pos", "run", "low")),
             _planes(np.searchsorted(used, spans["doc"]), "<i4"), _planes(spans["start"], "<i8"), _planes(spans["end"], "<i8")]
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(parts) + raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n_docs, n, n_spans = np.frombuffer(data, "<i8", 3).tolist()
    ids, at = _from_planes(data, 24, n_docs, "<i8")
    keys, at = _from_planes(data, at, n_docs, "<i8")
    segments = np.empty(n, _PLACED)
    doc, at = _from_planes(data, at, n, "<i4")
    segments["doc"] = np.cumsum(doc)
    for c in ("pos", "run", "low"):
        segments[c], at = _from_planes(data, at, n, _SEGMENT[c].str)
    doc, at = _from_planes(data, at, n_spans, "<i4")
    start, at = _from_planes(data, at, n_spans, "<i8")
    end, at = _from_planes(data, at, n_spans, "<i8")
    return np.stack([np.cumsum(ids), keys], axis=1), segments, (doc.astype(np.int64), start, end), data[at:]


def _whole_hashes(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of all ``length`` bytes at each of the places ``at``."""
    word = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = np.full(len(at), length, np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ word[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _listed(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in the sorted list."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _runs(text: np.ndarray, base: np.ndarray, sizes: np.ndarray, length: int,
          hot: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one key, inside the pieces: (first window, windows, key, whether the key is hot).

    The key is the minimizer's hash; for a minimizer in ``hot`` it is the hash of the whole window.
    """
    least = window_hashes(text, length)
    split = _listed(least, hot)
    if split.any():
        least = least.copy()
        least[split] = _whole_hashes(text, np.flatnonzero(split), length)
    whole = np.zeros(len(least) + 1, np.int64)
    whole[base] += 1
    ends = base + sizes - length + 1
    np.add.at(whole, ends[ends <= len(least)], -1)
    inside = np.cumsum(whole)[:-1] > 0
    new = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (split[1:] != split[:-1])]
    new[base] = True
    first = np.flatnonzero(new)
    run = np.diff(np.r_[first, len(least)])
    first, run = first[inside[first]], run[inside[first]]
    if run.max() > MAX_RUN:
        parts = -(-run // MAX_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, run = np.repeat(first, parts) + nth * MAX_RUN, np.minimum(np.repeat(run, parts) - nth * MAX_RUN, MAX_RUN)
    return first, run, least[first], split[first]


def _different(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimizer hashes with LOCAL_SEGMENTS or more different segments in these pieces, and how many they have.

    Segments are told apart by their windows and first and last eight bytes.
    """
    keys, at = [], 0
    sizes = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(pieces), np.uint8)
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(base, base[at] + HASH_BYTES)))
        part = text[base[at]: base[to - 1] + sizes[to - 1]]
        first, run, low, _ = _runs(part, base[at:to] - base[at], sizes[at:to], length)
        word = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,))
        sign = (word[first] * np.uint64(0x9E3779B97F4A7C15)) ^ word[first + run + length - 9]
        keys.append(np.stack([low, sign * np.uint64(0xBF58476D1CE4E5B9) + run.astype(np.uint64)]))
        at = to
    low, sign = np.concatenate(keys, axis=1)
    order = np.lexsort((sign, low))
    low, sign = low[order], sign[order]
    low = low[np.r_[True, (low[1:] != low[:-1]) | (sign[1:] != sign[:-1])]]
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    count = np.diff(np.r_[first, len(low)])
    many = count >= LOCAL_SEGMENTS
    return low[first][many], count[many]


def hot_minimizers(docs: DataFrame, length: int = LENGTH, segments: int = HOT_SEGMENTS) -> np.ndarray:
    """Sorted hashes of the minimizers with ``segments`` or more different segments in ``text`` (equal ones count once a block).

    At most the HOT_MINIMIZERS largest. A minimizer with under LOCAL_SEGMENTS
    in every block of BLOCK_BYTES is not found, however many blocks there are.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[bytes]) -> pa.RecordBatch:
            low, n = _different(held, length)
            return pa.record_batch([pa.array(low.view(np.int64)), pa.array(n.astype(np.int64))], names=["low", "n"])

        held, size = [], 0
        for batch in sliced(batches, 64):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for _, _, _, piece in _pieces([0] * len(texts), [0] * len(texts), texts, length):
                held.append(piece)
                size += len(piece)
                if size >= BLOCK_BYTES:
                    yield counted(held)
                    held, size = [], 0
                    release_memory()
        if held:
            yield counted(held)
            del held
            release_memory()

    found = (docs.select("text").mapInArrow(count, "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= segments).orderBy(F.desc("n"), "low").limit(HOT_MINIMIZERS))
    return np.sort(np.array([r["low"] for r in found.collect()], np.int64).view(np.uint64))


def _deal(pieces: list[tuple[int, int, int, bytes]], length: int, buckets: int,
          hot: np.ndarray = _NONE) -> tuple[list[int], list[bytes]]:
    """The segments of some pieces as one blob for each bucket.

    A segment that a smaller document of these pieces has too is decided
    here (a passage that very many documents share leaves a task once).
    Windows of the minimizers in ``hot`` are segments of their own.
    """
    pieces = sorted(pieces, key=lambda p: (p[0], p[1], p[2]))
    docs = np.array([(p[0], p[1]) for p in pieces], "<i8").reshape(-1, 2)
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    base = np.cumsum(sizes) - sizes
    raw = b"".join(p[3] for p in pieces)
    offset = np.array([p[2] for p in pieces], np.int64)
    text, found, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(pieces):  # hash some pieces at once
        to = max(at + 1, int(np.searchsorted(base, base[at] + HASH_BYTES)))
        lo, hi = int(base[at]), int(base[to - 1] + sizes[to - 1])
        first, run, low, split = _runs(text[lo:hi], base[at:to] - lo, sizes[at:to], length, hot)
        found.append((first + lo, run, low, split))
        at = to
    first, run, low, split = (np.concatenate([f[i] for f in found]) for i in range(4))
    piece = np.searchsorted(base, first, side="right") - 1
    segments = np.empty(len(first), _SEGMENT)
    segments["doc"], segments["run"], segments["low"] = piece, run, low & np.uint64(0xFFFFFF)
    segments["pos"] = first - base[piece] + offset[piece]
    spread = (low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    bucket = (spread % np.uint64(buckets)).astype(np.int32)
    last = first + run + length - 1

    keep, decided = np.ones(len(first), bool), []
    _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(count[inverse] > 1).tolist():  # in order of documents
        if docs[seen.setdefault(raw[first[i]: last[i]], int(piece[i])), 0] < docs[piece[i], 0]:
            keep[i] = False
            decided.append(i)
    gone = np.zeros(len(decided), _SPAN_OF)
    if decided:
        s = segments[decided]
        gone["doc"], gone["start"], gone["end"] = s["doc"], s["pos"], s["pos"] + s["run"] + length - 1
    gone_bucket = bucket[decided] if decided else np.empty(0, np.int64)
    single = split[decided] if decided else np.empty(0, bool)
    if single.any():  # neighbouring windows make one span, which goes to any bucket: by document
        doc, start, end = _merged(*(gone[single][c].astype(np.int64) for c in ("doc", "start", "end")))
        joined = np.empty(len(doc), _SPAN_OF)
        joined["doc"], joined["start"], joined["end"] = doc, start, end
        by_doc = ((docs[doc, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
        gone = np.concatenate([gone[~single], joined])
        gone_bucket = np.concatenate([gone_bucket[~single], by_doc.astype(gone_bucket.dtype)])
    kept = np.flatnonzero(keep)
    kept = kept[np.argsort(bucket[kept], kind="stable")]
    gone_order = np.argsort(gone_bucket, kind="stable")
    gone, gone_bucket = gone[gone_order], gone_bucket[gone_order]
    out_bucket, out_blob, of = [], [], bucket[kept]
    for b in np.unique(np.concatenate([of, gone_bucket])).tolist():
        rows = kept[np.searchsorted(of, b): np.searchsorted(of, b, side="right")]
        lost = gone[np.searchsorted(gone_bucket, b): np.searchsorted(gone_bucket, b, side="right")]
        out_bucket.append(b)
        held = b"".join([raw[i:j] for i, j in zip(first[rows].tolist(), last[rows].tolist())])
        out_blob.append(_pack(segments[rows], held, lost, docs))
    return out_bucket, out_blob


def _decide(docs: np.ndarray, segments: np.ndarray, raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed spans (number in docs, start, end) of segments of whole minimizer groups.

    ``segments``: fields of _SEGMENT plus their places in ``raw``.
    """
    none = np.empty(0, np.int64)
    if not len(segments):
        return none, none, none
    order = np.lexsort((docs[segments["doc"], 0], segments["low"]))
    segments = segments[order]
    doc = docs[segments["doc"], 0]
    first = np.flatnonzero(np.r_[True, segments["low"][1:] != segments["low"][:-1]])
    size = np.diff(np.r_[first, len(segments)])
    several = np.repeat(doc[first] != doc[first + size - 1], size)  # sorted by document: more than one of them
    segments, doc = segments[several], doc[several]
    n_doc, start, end = [], [], []
    if not len(segments):
        return none, none, none
    begin, run, place, number, low = (segments[c].tolist() for c in ("at", "run", "pos", "doc", "low"))
    ids = doc.tolist()
    # equal segments of one group: all but the smallest document's go whole
    least: dict[tuple[int, bytes], int] = {}
    rows, twins = [], {}
    for i in range(len(segments)):
        key = (low[i], raw[begin[i]: begin[i] + run[i] + length - 1])
        j = least.setdefault(key, i)
        if j == i:
            rows.append(i)
        elif ids[j] < ids[i]:
            n_doc.append(number[i])
            start.append(place[i])
            end.append(place[i] + run[i] + length - 1)
        else:
            twins.setdefault(j, []).append(i)  # the same document again: decided like its first place
    # the windows of the different segments of each group, as suffixes
    rows = np.array(rows, np.int64)
    group = segments["low"][rows]
    many = np.unique(group, return_inverse=True, return_counts=True)
    rows = rows[many[2][many[1]] > 1]
    if len(rows):
        runs = segments["run"][rows].astype(np.int64)
        owner = np.repeat(rows, runs)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        suffix = segments["at"][owner] + offset
        text = np.frombuffer(raw + bytes(8), np.uint8)
        removed = np.zeros(len(owner), bool)
        owner_doc = doc[owner]
        for leaf in equal_suffixes(text, suffix, segments["low"][owner].astype(np.int64), length):
            leaf = np.array(leaf)
            of = owner_doc[leaf]
            removed[leaf[of > of.min()]] = True
        hit = np.flatnonzero(removed)
        if len(hit):  # neighbouring windows of one segment make one span
            new = np.r_[True, (owner[hit][1:] != owner[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1)]
            head, tail = hit[new], hit[np.r_[new[1:], True]]
            for i, a, b in zip(owner[head].tolist(), offset[head].tolist(), offset[tail].tolist()):
                for j in (i, *twins.get(i, ())):
                    n_doc.append(number[j])
                    start.append(place[j] + a)
                    end.append(place[j] + b + length)
    return np.array(n_doc, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one document joined, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    reach = end.copy()  # furthest end so far inside the document: offset by document keeps one running maximum
    width = int(end.max()) + 2
    rank = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + rank * width) - rank * width
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], start[new], reach[last]


def duplicate_spans(docs: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(id, text_key, spans): bytes of each text covered by a ``length``-byte string that also starts in a smaller doc_id.

    ``spans``: binary (start, end) pairs, possibly several rows a document and
    overlapping. Only texts with such bytes return. ``docs``: id, text_key, text.
    ``hot_segments``: see HOT_SEGMENTS; any value gives the same bytes.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_minimizers(docs, length, hot_segments)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held: list) -> Iterator[pa.RecordBatch]:
            bucket, blob = _deal(held, length, buckets, hot)
            for at in range(0, len(bucket), 32):
                yield pa.record_batch([pa.array(bucket[at: at + 32], pa.int32()), pa.array(blob[at: at + 32], pa.binary())],
                                      names=["bucket", "blob"])
            del bucket, blob
            release_memory()

        held, size = [], 0
        for batch in sliced(batches, 64):
            texts = (t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist())
            for piece in _pieces(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), list(texts), length):
                held.append(piece)
                size += len(piece[3])
                if size >= BLOCK_BYTES:
                    yield from blobs(held)
                    held, size = [], 0
        if held:
            yield from blobs(held)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
            docs, segments, raws, spans, n_docs, at = [], [], [], [], 0, 0
            for blob in blobs:
                d, placed, decided, raw = _unpack(blob)
                width = placed["run"].astype(np.int64) + length - 1
                placed["at"] = at + np.cumsum(width) - width
                placed["doc"] += np.uint32(n_docs)
                docs.append(d)
                segments.append(placed)
                raws.append(raw)
                spans.append((decided[0] + n_docs, *decided[1:]))
                n_docs += len(d)
                at += len(raw)
            docs = np.concatenate(docs)
            segments, raw = np.concatenate(segments), b"".join(raws)
            del raws, placed, d
            step = max(1, -(-at // BUCKET_BYTES))  # a large bucket by shares of its minimizers, each whole
            for share in range(step):
                part = segments[segments["low"] % step == share] if step > 1 else segments
                spans.append(_decide(docs, part, raw, length))
            doc, start, end = (np.concatenate([s[i] for s in spans]) for i in range(3))
            # a document may come in several blobs: number equal (id, text key) alike
            unique, number = np.unique(docs, axis=0, return_inverse=True)
            yield unique, *_merged(number.ravel()[doc], start, end)

        def rows(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            for docs, doc, start, end in finish(blobs):
                if not len(doc):
                    continue
                span = np.empty(len(doc), _SPAN)
                span["start"], span["end"] = start, end
                head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                tail = np.r_[head[1:], len(doc)]
                yield pa.record_batch([pa.array(docs[doc[head], 0]), pa.array(docs[doc[head], 1]),
                                       pa.array([span[a:b].tobytes() for a, b in zip(head, tail)], pa.binary())],
                                      names=["id", "text_key", "spans"])

        blobs, now = [], None
        for batch in sliced(batches, 256):
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now and blobs:
                    yield from rows(blobs)
                    blobs = []
                    release_memory()
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from rows(blobs)
            del blobs
            release_memory()

    dealt = docs.select("id", "text_key", "text").mapInArrow(deal, "bucket int, blob binary")
    return (dealt.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(decide, "id long, text_key long, spans binary"))


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str, str, str]:
    """``docs`` with each row's merged spans (null: none); names of the added columns (id, text key, spans)."""
    i, k, s = fresh(docs, "dd_id"), fresh(docs, "dd_key"), fresh(docs, "dd_spans")
    keyed = docs.withColumn(i, long_id("doc_id")).withColumn(k, F.xxhash64(F.col("text").cast("string")))
    source = keyed.select(F.col(i).alias("id"), F.col(k).alias("text_key"), F.col("text").cast("string").alias("text"))
    spans = materialize(duplicate_spans(source, length), "suffix-spans")
    spans = spans.groupBy(F.col("id").alias(i), F.col("text_key").alias(k)).agg(F.collect_list("spans").alias(s))
    return keyed.join(spans, [i, k], "left"), i, k, s


def _cut(text: bytes, spans: list[bytes] | None) -> tuple[bytes, int]:
    """The text without the bytes of the spans, and the number of maximal removed runs."""
    if not spans:
        return text, 0
    pairs = np.frombuffer(b"".join(spans), _SPAN)
    _, start, end = _merged(np.zeros(len(pairs), np.int64), pairs["start"].astype(np.int64), pairs["end"].astype(np.int64))
    keep_from, keep_to = [0, *end.tolist()], [*start.tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(keep_from, keep_to)]), len(start)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Each byte covered by a string of ``length`` bytes that also starts in a
    document with a smaller doc_id is removed; strings are judged on the input
    and never cross documents. Null text: empty. A null doc_id counts as
    larger than every id. Rows with one doc_id do not remove each other's
    bytes; each is judged and returns. Other columns are ignored; an empty
    table gives no rows.
    """
    import hashlib

    joined, i, _, s = _with_spans(docs.select("doc_id", "text"), length)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            out = []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()):
                kept, runs = _cut(text or b"", spans)
                out.append((len(text or b""), len(text or b"") - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (joined.select(F.when(F.col(i) != NO_ID, F.col(i)).alias("id"), F.col("text").cast("string").alias("text"), F.col(s).alias("spans"))
            .mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the bytes that :func:`suffix_dedup` names taken out of ``text``; a row whose text lost every byte goes.

    A cut inside a multi-byte character leaves a part of it; such broken
    characters at the seams are dropped. A column n_chars is set to the new
    length of changed texts; all other columns and untouched rows stay as they are.
    """
    joined, i, k, s = _with_spans(docs, length)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _cut(bytes(t), [bytes(x) for x in p])[0].decode("utf-8", "ignore")
                          for t, p in zip(texts, spans)], dtype=object)

    touched = F.col(s).isNotNull()
    text = F.when(touched, cut(F.encode(F.col("text").cast("string"), "utf-8"), F.coalesce(F.col(s), F.array().cast("array<binary>")))
                  ).otherwise(F.col("text"))
    kinds, new = dict(docs.dtypes), fresh(joined, "dd_text")
    out = joined.withColumn(new, text).where(~touched | (F.length(new) > 0))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(new).cast(kinds[c]).alias(c))
        elif c == "n_chars":
            columns.append(F.when(touched, F.length(new)).otherwise(F.col(c)).cast(kinds[c]).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
