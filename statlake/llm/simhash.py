"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.llm.common import NO_ID, binary_column, fresh, long_id, materialize, sliced
from statlake.llm.components import connected_components

#: Shingle length and greatest bit distance of the production queries.
SHINGLE_WORDS, MAX_DISTANCE = 3, 3
#: Hash seed of a shingle (fixed value).
SEED = 42
#: The top bits of a variant, by which variants are shuffled.
KEY_BITS = 20
_LOW_BITS = 64 - KEY_BITS
_HASHES_AT_ONCE = 1 << 15


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a text's word shingles (repeats count); 0 for no word. Whole text, bounded memory."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        return digest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, end = (end - length)[: len(words) - shingle_words + 1], end[shingle_words - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), _HASHES_AT_ONCE):
        spans = zip(start[at: at + _HASHES_AT_ONCE].tolist(), end[at: at + _HASHES_AT_ONCE].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every row: id is doc_id with a missing id last, fp the fingerprint as a signed long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            fps = np.fromiter((simhash(t, shingle_words) for t in binary_column(batch, "text")), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(long_id("doc_id").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "id long, fp long")


def _flips(positions: list[list[int]], most: int) -> list[tuple[int, int, int]]:
    """(mask, flips, class) for up to ``most`` (0 to 2) flips; two flips only inside one class of ``positions``."""
    out = [(0, 0, -1)]
    for c, group in enumerate(positions):
        for i, p in enumerate(group):
            if most >= 1:
                out.append((1 << p, 1, c))
            out += [(1 << p | 1 << q, 2, c) for q in group[:i] if most >= 2]
    return out


def _classes(lo: int, hi: int) -> list[list[int]]:
    return [[p for p in range(lo, hi) if p % 2 == c] for c in (0, 1)]


#: Bits fall into two classes, the even and the odd positions: of any three bits, two share a class.
_LOW, _HIGH = _classes(0, _LOW_BITS), [[p - _LOW_BITS for p in group] for group in _classes(_LOW_BITS, 64)]


def _expand(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants, under their keys, of (key, fingerprint) rows: (variant, fingerprint, flips)."""
    flipped = (fp >> np.uint64(_LOW_BITS)) ^ key
    count, odd = np.bitwise_count(flipped), np.bitwise_count(fp) % 2 == 1
    evens = sum(1 << p for p in _HIGH[0])
    in_class = np.where(flipped & np.uint64(evens) != 0, 0, 1)
    plans = [((odd & (count == 0)), [(m, n) for m, n, _ in _flips(_LOW, 2)]),
             ((~odd & (count == 0)), [(m, n) for m, n, _ in _flips(_LOW, 1) if n == 1]),
             ((odd & (count == 2)) | (~odd & (count == 1)), [(0, 0)])]
    plans += [(odd & (count == 1) & (in_class == c), [(0, 0)] + [(1 << p, 1) for p in _LOW[c]]) for c in (0, 1)]
    low_mask, variants, owners, flips = np.uint64((1 << _LOW_BITS) - 1), [], [], []
    for rows, masks in plans:
        if not rows.any():
            continue
        mask = np.array([m for m, _ in masks], np.uint64)
        n = np.array([n for _, n in masks], np.uint8)
        base = (key[rows] << np.uint64(_LOW_BITS)) | (fp[rows] & low_mask)
        variants.append((base[:, None] ^ mask[None, :]).ravel())
        owners.append(np.repeat(fp[rows], len(mask)))
        flips.append((count[rows].astype(np.uint8)[:, None] + n[None, :]).ravel())
    return np.concatenate(variants), np.concatenate(owners), np.concatenate(flips)


def _collisions(key: np.ndarray, fp: np.ndarray, max_distance: int) -> np.ndarray:
    """Verified links among rows of whole keys: two columns, each link once.

    Under one variant all fingerprints within one flip of it are linked to
    each other and to those two flips away (distance at most 3), so each is
    linked to the least of the former: a star, not all pairs. Two
    fingerprints that are both two flips away and linked differ in two bits
    and meet under another variant, one flip from each.
    """
    variant, owner, flips = _expand(key, fp)
    order = np.argsort(variant, kind="stable")
    variant, owner, flips = variant[order], owner[order], flips[order]
    first = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    size = np.diff(np.r_[first, len(variant)])
    shared = np.repeat(size > 1, size)
    owner, flips, size = owner[shared], flips[shared], size[size > 1]
    if not len(owner):
        return np.empty((0, 2), np.uint64)
    first = np.cumsum(size) - size
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    near = flips <= 1
    center = np.repeat(np.minimum.reduceat(np.where(near, owner, none), first), size)
    has_center = np.repeat(np.bitwise_or.reduceat(near, first), size)
    keep = has_center & (owner != center) & (np.bitwise_count(owner ^ center) <= max_distance)
    pairs = np.stack([np.maximum(owner[keep], center[keep]), np.minimum(owner[keep], center[keep])], axis=1)
    return np.unique(pairs, axis=0)


def fingerprint_links(fps: DataFrame, max_distance: int = MAX_DISTANCE, rows_at_once: int = 20_000) -> DataFrame:
    """(hi, lo): links whose components equal those of all pairs of distinct ``fp`` at most ``max_distance`` (1 to 3) bits apart.

    Two fingerprints at distance 3 differ in parity. The odd one emits all
    variants within two flips (two flips only inside one class of bits: of
    the three differing bits two share a class), the even one all at one
    flip, and they meet in the middle; at distance 2 both meet at one flip
    each, at distance 1 the even one's flip meets the odd one itself. Variants
    that share their top 20 bits travel as one row under that key and are
    written out beside their partners, so a fingerprint costs about 66
    shuffled rows for its 560 variants (on average over parities).
    """
    if not 1 <= max_distance <= 3:
        raise ValueError("max_distance must be 1, 2 or 3")
    odd = F.array(*[F.lit(m) for m, n, _ in _flips(_HIGH, 2)])
    even = F.array(*[F.lit(m) for m, n, _ in _flips(_HIGH, 1)])
    top = F.shiftrightunsigned("fp", _LOW_BITS)
    keyed = (fps.select("fp").distinct()
             .select("fp", F.explode(F.when(F.bit_count("fp") % 2 == 1, odd).otherwise(even)).alias("mask"))
             .select(top.bitwiseXOR(F.col("mask").cast("long")).cast("int").alias("key"), "fp"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key, fp):
            pairs = _collisions(key.astype(np.uint64), fp.view(np.uint64), max_distance).view(np.int64)
            signed = np.sort(pairs, axis=1)  # as Spark compares them
            return pa.record_batch([pa.array(signed[:, 1]), pa.array(signed[:, 0])], names=["hi", "lo"])

        key, fp = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            while len(key) >= rows_at_once and key[0] != key[-1]:  # whole keys only
                cut = int(np.searchsorted(key, key[min(rows_at_once, len(key) - 1)]))
                cut = cut or int(np.searchsorted(key, key[0], side="right"))
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links(key, fp)

    return (keyed.repartition("key").sortWithinPartitions("key")
            .mapInArrow(meet, "hi long, lo long").distinct())


def _groups(docs: DataFrame, shingle_words: int, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) per row, and (fp, root, component) per distinct fingerprint; component NO_ID: no id in the group."""
    fps = materialize(fingerprints(docs, shingle_words), "simhash-fp")
    least = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = connected_components(materialize(fingerprint_links(least, max_distance), "simhash-links"))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return fps, materialize(rooted.join(component, "root").select("fp", "root", "component"), "simhash-classes")


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: (doc_id, fingerprint, component_id).

    Equal fingerprints and fingerprints at most ``max_distance`` bits apart
    are linked; component_id is the smallest doc_id reachable. Texts are
    compared by words (runs of non-space ASCII bytes, A-Z lower-cased); a text
    without words, an empty or a null text has fingerprint zero and is linked
    like any other. A row with a null doc_id links too; component_id is null
    only where the group has no id at all. Repeated rows each return. Other
    columns are ignored; an empty table gives no rows.
    """
    fps, classes = _groups(docs, shingle_words, max_distance)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return fps.join(classes, "fp").select(
        known("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        known("component").alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group of :func:`simhash_groups`, with all columns of ``docs``.

    It is the row with the group's smallest doc_id (rows without one come
    last); of several such rows that with the least fingerprint, then the
    least digest of all its columns. A doc_id that repeats with texts of
    different groups so keeps a row in each group.
    """
    fps, classes = _groups(docs, shingle_words, max_distance)
    repeated = fps.groupBy("id").count().where((F.col("count") > 1) | (F.col("id") == NO_ID)).select(F.col("id").alias("again"))
    chosen = fps.join(classes, "fp").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("m")).select("root", "m.*")
    # an id of one row names its text: such rows are found by id alone
    single = chosen.join(repeated, F.col("id") == F.col("again"), "left_anti").select("id")
    alone = docs.join(single, docs["doc_id"] == single["id"], "left_semi")

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        fps = [simhash(None if t is None else bytes(t), shingle_words) for t in texts]
        return pd.Series(np.array(fps, np.uint64).view(np.int64))

    own, fp, root, tie = (fresh(docs, c) for c in ("own_id", "own_fp", "own_root", "own_tie"))
    several = docs.withColumn(own, long_id("doc_id"))
    several = (several.join(repeated, several[own] == repeated["again"], "left_semi")
               .withColumn(fp, fingerprint(F.encode(F.col("text").cast("string"), "utf-8")))
               .withColumn(tie, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)))
    named = chosen.select(F.col("id").alias(own), F.col("fp").alias(fp), F.col("root").alias(root))
    several = several.join(named, [own, fp])
    least = several.groupBy(root).agg(F.min(tie).alias(tie))
    several = several.join(least, [root, tie], "left_semi").dropDuplicates([root]).select(*docs.columns)
    return alone.unionByName(several)
