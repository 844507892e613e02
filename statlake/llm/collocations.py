"""Phrase collocation mining: n-gram counts in a HAT-trie, spilled as sorted runs that are merged per prefix partition.

A task counts into a shallow trie over word ids whose leaves are hash
containers; a container that grows too large bursts into a trie node with a
container per next word. Beyond a bound on entries the largest subtrees are
spilled whole: as sorted runs, cut by prefix partition. A run travels as one
compressed blob per partition; the partition's runs are merged and summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statlake.llm.common import binary_column, materialize, release_memory, sliced

#: A phrase counts from this frequency on; a longer candidate with this percentage of its frequency drops it; rows per language.
MIN_COUNT, COVERED_PERCENT, TOP = 10, 50, 2000
#: Shares of a language's phrases that are ranked apart first.
SHARES = 16
#: Entries of a task's trie and words of its dictionary before it spills, and entries of a container before it bursts.
MAX_ENTRIES, MAX_WORDS, BURST = 800_000, 500_000, 16_384
#: Text of a prefix partition, about, and the partitions over which one two-word prefix is spread.
PARTITION_BYTES, SPREAD = 24 << 20, 16
#: Bytes of a text that are cut into words at once, and words that are counted at once.
SLICE_BYTES, COUNT_WORDS = 1 << 20, 1 << 18
#: Piece borders (fixed: ``.,;:!?`` and the ASCII line ends) become line feeds, tabs become spaces.
_BORDERS = bytes.maketrans(b".,;:!?\x0B\x0C\x0D\x09", b"\n" * 9 + b" ")

#: First, second and third word id (0: none) and count.
Rows = list[np.ndarray]
#: Bits of a word id in a packed phrase, and the shifts of its base-64 digits in the order in which the trie branches.
_BITS = 21
_DIGITS = tuple(word * _BITS + 6 * digit for word in (2, 1) for digit in range(4))


class Words(dict):
    """Word -> id from 1 on, in order of appearance. A line feed is 0 and an empty word -1."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        new = self[word] = len(self) - 1
        return new


def token_ids(text: bytes, words: Words) -> Iterator[np.ndarray]:
    """Ids of a lower-cased text's words with 0 at every piece border, slice by slice."""
    text = text.lower().translate(_BORDERS)
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= SLICE_BYTES else text.find(b" ", at + SLICE_BYTES)
        to = len(text) if to < 0 else to
        some = text[at:to].replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(words.__getitem__, some), np.int64, len(some))
        yield ids[ids >= 0]
        at = to


def phrases(ids: np.ndarray) -> np.ndarray:
    """Packed (word, next, next but one) of every word but the last two; 0 from a border on."""
    first, second, third = ids[:-2], ids[1:-1], ids[2:]
    packed = first << 2 * _BITS | second << _BITS | np.where(second > 0, third, 0)
    return packed[first > 0]


class HatTrie:
    """Counts of packed phrases: a shallow trie over the digits of their word ids, its leaves hash containers.

    A container that outgrows ``burst`` entries becomes a node with a
    container for each value of the next digit: first the digits of the first
    word's id (the lowest ahead, so that ids spread evenly), then the
    second's.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.children: list = [Counter() for _ in range(64)]

    def add(self, packed: np.ndarray) -> None:
        self._add(self.children, packed, 0)

    def _add(self, children: list, packed: np.ndarray, depth: int) -> None:
        digit = packed >> _DIGITS[depth] & 63
        order = np.argsort(digit, kind="stable")
        packed, cuts = packed[order], np.searchsorted(digit[order], np.arange(65))
        for d in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            some, child = packed[cuts[d]: cuts[d + 1]], children[d]
            if isinstance(child, list):
                self._add(child, some, depth + 1)
                continue
            child.update(some.tolist())
            if len(child) > self.burst and depth + 1 < len(_DIGITS):
                children[d] = self._burst(child, depth + 1)

    def _burst(self, container: Counter, depth: int) -> list:
        children: list = [Counter() for _ in range(64)]
        shift = _DIGITS[depth]
        for packed, n in container.items():
            children[packed >> shift & 63][packed] = n
        if depth + 1 < len(_DIGITS):
            children = [self._burst(c, depth + 1) if len(c) > self.burst else c for c in children]
        return children

    def sizes(self) -> list[int]:
        """Entries of each subtree under the root."""
        return [sum(map(len, self._containers(c))) for c in self.children]

    def _containers(self, child) -> list[Counter]:
        return [child] if isinstance(child, Counter) else [x for c in child for x in self._containers(c)]

    def take(self, subtrees: list[int]) -> Rows:
        """Remove whole subtrees; the total of each phrase of one, two and three words in them, sorted by length and ids."""
        boxes = [b for d in subtrees for b in self._containers(self.children[d]) if b]
        for d in subtrees:
            self.children[d] = Counter()
        n = sum(map(len, boxes))
        packed = np.fromiter(chain.from_iterable(boxes), np.int64, n)
        count = np.fromiter(chain.from_iterable(b.values() for b in boxes), np.int64, n)
        order = np.argsort(packed)
        packed, count = packed[order], count[order]
        out = []
        for words in (1, 2, 3):
            own = packed >> (3 - words) * _BITS << (3 - words) * _BITS
            at = np.flatnonzero(np.diff(own, prepend=-1))
            keys, total = own[at], np.add.reduceat(count, at) if n else count
            whole = keys >> (3 - words) * _BITS & (1 << _BITS) - 1 > 0  # the last of the words is there
            out.append((keys[whole], total[whole]))
        keys, total = (np.concatenate(x) for x in zip(*out))
        return [*_unpacked(keys), total]


def _unpacked(packed: np.ndarray) -> Rows:
    mask = (1 << _BITS) - 1
    return [packed >> 2 * _BITS, packed >> _BITS & mask, packed & mask]


def summed(pile: list[Rows], words: int) -> Rows:
    """The rows of all runs, equal phrases added up; ids are up to ``words``."""
    first, second, third, count = (np.concatenate(x) for x in zip(*pile))
    if words < 1 << _BITS:
        keys = [first << 2 * _BITS | second << _BITS | third]
        order = np.argsort(keys[0])
    else:
        keys = [first, second, third]
        order = np.lexsort((third, second, first))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [*(x[order[at]] for x in (first, second, third)), np.add.reduceat(count[order], at) if len(at) else count]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _partition(lang: int, h1, h2, h3, partitions: int) -> np.ndarray:
    """Prefix partition of phrases from their words' hashes (0: no word): by the first two words, spread by the third."""
    prefix = _mix(_mix(h1 ^ np.uint64(lang)) + h2)
    spread = np.where(h3 > 0, _mix(h3) >> np.uint64(40), np.uint64(0)) % np.uint64(min(SPREAD, partitions))
    return ((prefix >> np.uint64(20)) + spread) % np.uint64(partitions)


_BLOB = ("<i4", "<i4", "<i4", "<i8")


def _pack(words: list[bytes], rows: Rows) -> bytes:
    """A sorted run: its dictionary, then ids as differences where they are sorted."""
    names = b" ".join(words)
    a, b, c, n = rows
    arrays = [np.diff(a, prepend=0).astype("<i4"), b.astype("<i4"), c.astype("<i4"), n.astype("<i8")]
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays]  # byte planes compress better
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(names), len(a)], "<i8").tobytes() + names + b"".join(planes))


def _unpack(blob: bytes) -> tuple[list[bytes], Rows]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size, rows = np.frombuffer(data, "<i8", 2).tolist()
    at, out = 16 + size, []
    for kind in _BLOB:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, rows * width, at).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(rows).astype(np.int64))
        at += rows * width
    out[0] = np.cumsum(out[0])
    return data[16: 16 + size].split(b" "), out


def runs(docs: DataFrame, partitions: int, max_entries: int = MAX_ENTRIES, max_words: int = MAX_WORDS, burst: int = BURST) -> DataFrame:
    """(part, lang, blob): sorted runs of phrase counts, cut by prefix partition."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        tries: dict[str, HatTrie] = {}
        waiting: dict[str, list[np.ndarray]] = {}  # ids that are not counted yet; each document ends with two borders

        def drain(lang: str) -> None:
            """Count all that waits; the last two words may still be followed by others and go on waiting."""
            ids = np.concatenate(waiting[lang])
            for at in range(0, len(ids) - 2, COUNT_WORDS):
                tries[lang].add(phrases(ids[at: at + COUNT_WORDS + 2]))
            waiting[lang] = [ids[-2:]]

        def spill(everything: bool) -> Iterator[pa.RecordBatch]:
            names = [b"", *islice(words, 2, None)]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) | 1 if w else 0 for w in names), np.uint64, len(names))
            sizes = sorted(((n, d, lang) for lang, t in tries.items() for d, n in enumerate(t.sizes()) if n), reverse=True)
            left = sum(n for n, _, _ in sizes)
            chosen: dict[str, list[int]] = {}
            for n, d, lang in sizes:  # whole subtrees, the largest first, until half is free
                if not everything and left <= max_entries // 2:
                    break
                chosen.setdefault(lang, []).append(d)
                left -= n
            for lang, subtrees in chosen.items():
                rows = tries[lang].take(subtrees)
                part = _partition(xxhash.xxh64_intdigest(lang.encode()), *(hashes[x] for x in rows[:3]), partitions).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, rows = part[order], [x[order] for x in rows]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                out, size = [], 0
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    here = [x[lo:hi] for x in rows]
                    local = np.zeros(len(names), np.int64)  # id in the run's own dictionary
                    for x in here[:3]:
                        local[x] = 1
                    local[0] = 0
                    used = np.flatnonzero(local)
                    local[used] = np.arange(1, len(used) + 1)
                    blob = _pack([names[i] for i in used.tolist()], [*(local[x] for x in here[:3]), here[3]])
                    out.append((int(part[lo]), lang, blob))
                    size += len(blob)
                    if size > 4 << 20:
                        yield flush(out)
                        out, size = [], 0
                if out:
                    yield flush(out)
            if everything:
                tails = {lang: [names[i] if i else b"\n" for i in ids[0].tolist()] for lang, ids in waiting.items()}
                words.clear()
                words.update(Words())
                tries.clear()
                for lang, tail in tails.items():
                    tries[lang] = HatTrie(burst)
                    waiting[lang] = [np.array([words[w] for w in tail], np.int64)]
            release_memory()

        def flush(out):
            part, lang, blob = zip(*out)
            return pa.record_batch([pa.array(part, pa.int64()), pa.array(lang, pa.string()), pa.array(blob, pa.binary())], names=["part", "lang", "blob"])

        def checked(lang: str) -> Iterator[pa.RecordBatch]:
            """Count what waits in ``lang`` if it is much, and spill if there is too much to hold."""
            full = len(words) > max_words
            for name in [*waiting] if full else [lang]:
                if full or sum(map(len, waiting[name])) >= min(COUNT_WORDS, max_entries):
                    drain(name)
                    if full or sum(sum(t.sizes()) for t in tries.values()) > max_entries:
                        yield from spill(False)
            if full:
                yield from spill(True)

        for batch in sliced(batches, 64):
            for lang, text in zip(batch.column("lang").to_pylist(), binary_column(batch, "text")):
                if lang not in tries:
                    tries[lang], waiting[lang] = HatTrie(burst), [np.zeros(2, np.int64)]
                for ids in token_ids(text, words):
                    waiting[lang].append(ids)
                    yield from checked(lang)
                waiting[lang].append(np.zeros(2, np.int64))
        for lang in waiting:
            drain(lang)
        if tries:
            yield from spill(True)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where("text is not null").mapInArrow(count, "part long, lang string, blob binary")


def merged(spilled: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, k, phrase, f): phrases of k words with f >= ``min_count``; k = 0: the words counted in one prefix partition.

    All runs of a partition meet in one task, sorted by partition; their
    entries are added up whenever they have doubled.
    """
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(lang, words, rows):
            names = [b"", *islice(words, 2, None)]
            k = 1 + (rows[1] > 0) + (rows[2] > 0)
            yield out([lang], [0], [None], [int(rows[3][k == 1].sum())])
            frequent = np.flatnonzero(rows[3] >= min_count)
            for at in range(0, len(frequent), 50_000):
                here = frequent[at: at + 50_000]
                ids = [x[here].tolist() for x in rows[:3]]
                phrase = [b" ".join(names[i] for i in t if i) for t in zip(*ids)]
                yield out([lang] * len(here), k[here], phrase, rows[3][here])

        def out(lang, k, phrase, f):
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(k, pa.int64()), pa.array(phrase, pa.binary()), pa.array(f, pa.int64())],
                                   names=["lang", "k", "phrase", "f"])

        now, words, pile, held, least = None, Words(), [], 0, 0
        for batch in batches:
            for part, lang, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "blob"))):
                if (part, lang) != now:
                    if pile:
                        yield from flush(now[1], words, summed(pile, len(words)))
                        release_memory()
                    now, words, pile, held, least = (part, lang), Words(), [], 0, 1 << 20
                names, rows = _unpack(blob)
                own = np.zeros(len(names) + 1, np.int64)
                own[1:] = np.fromiter(map(words.__getitem__, names), np.int64, len(names))
                pile.append([*(own[x] for x in rows[:3]), rows[3]])
                held += len(rows[3])
                if held > 2 * least:
                    pile = [summed(pile, len(words))]
                    held = len(pile[0][3])
                    least = max(least, held)
        if pile:
            yield from flush(now[1], words, summed(pile, len(words)))

    return (spilled.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(merge, "lang string, k long, phrase binary, f long")
            .withColumn("phrase", F.col("phrase").cast("string")))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, partition_bytes: int = PARTITION_BYTES, **bounds: int) -> DataFrame:
    """:func:`merged` counts of ``docs`` (lang, text), with a partition for each ``partition_bytes`` of text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return merged(runs(docs, max(1, -(-size // partition_bytes)), **bounds), min_count)


def _first(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, top: int = TOP, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of two and three words of each language.

    Texts (A-Z lower-cased) are cut at ``.,;:!?`` and line ends, words are
    runs without space and tab; a phrase stays inside a piece. score is
    floor(1000000 a a / (l r)) at the lowest-scoring cut (ties: the shorter
    first part), in decimals: exact for frequencies below 10^15. A phrase
    inside a longer candidate with at least ``covered_percent`` of its
    frequency is dropped. Order: score and a descending, phrase ascending by
    UTF-8 bytes.

    A null language is ``und``; null and empty texts count nothing; repeated
    rows count each; other columns are ignored; an empty table gives no rows.
    """
    counts = materialize(phrase_counts(docs, min_count, **bounds), "phrases")
    words = counts.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("k > 0").select("lang", "phrase", "f")
    found = counts.where("k >= 2").withColumnRenamed("f", "a")
    inside = (found.where("k = 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        _first(F.col("phrase"), 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    open_ = (found.join(inside, ["lang", "phrase"], "left")
             .where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < covered_percent * F.col("a").cast("decimal(38,0)"))))
    cut = lambda k: F.struct(F.lit(k).alias("cut"), _first(F.col("phrase"), k).alias("head"),
                             F.expr(f"substring_index(phrase, ' ', {k} - cast(k as int))").alias("tail"))
    cuts = open_.select("lang", "phrase", "a", "k", F.explode(F.when(F.col("k") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.cut", "c.head", "c.tail")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    big = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("under", big("l") * big("r"))
    scored = scored.withColumn("score", F.expr("over div under").cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # the best of each share of a language's phrases first: no task gets more than `top` rows of each share
    order = [F.col("m.score").desc(), F.col("a").desc(), F.col("phrase")]
    shared = lowest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = shared.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "m.l", "m.r", "n", "m.score")


#: The counts, cuts and drops again, in DuckDB. The character class and the constants are the contract's.
ORACLE_SQL = r"""
with d as (select coalesce(lang, 'und') lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
           from documents where text is not null),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w where len(ws) > 0),
g as (select lang, unnest([ws[i:i], case when i + 1 <= len(ws) then ws[i:i + 1] end, case when i + 2 <= len(ws) then ws[i:i + 2] end]) ph from s),
f as (select lang, ph, len(ph) k, count(*)::bigint f from g where ph is not null group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, ph, k, f a from f where k >= 2 and f >= 10),
o as (select * from c where not exists (
        select 1 from c b where b.lang = c.lang and b.k > c.k and (b.ph[1:2] = c.ph or b.ph[2:3] = c.ph) and 100::hugeint * b.a >= 50::hugeint * c.a)),
x as (select o.lang, o.ph, o.a, j.cut, h.f l, t.f r, (1000000::hugeint * o.a * o.a) // (h.f::hugeint * t.f) score
      from o join (values (1), (2)) j(cut) on j.cut < o.k
      join f h on h.lang = o.lang and h.ph = o.ph[1:j.cut] join f t on t.lang = o.lang and t.ph = o.ph[j.cut + 1:]),
m as (select lang, ph, a, unnest(min(struct_pack(score := score, cut := cut, l := l, r := r))) from x group by lang, ph, a),
q as (select lang, array_to_string(ph, ' ') phrase, a, l, r, score::bigint score from m),
z as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) "rank" from q)
select z.lang, "rank", phrase, a, l, r, n, score from z join n using (lang) where "rank" <= 2000
"""
