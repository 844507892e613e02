"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A rotation is three rounds of random signs and a Hadamard transform; the hash
of a vector is the signed axis its rotation is nearest to. A bucket joins
several such hashes, and a vector enters those buckets of each table whose axes
are nearest to it. Pairs that share a bucket are verified by their cosine.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.llm.common import NO_ID, long_id, materialize, sliced
from statlake.llm.components import connected_components

MIN_COSINE, TABLES, SEED = 0.9, 3, 13
#: Distinct vectors up to which a bucket joins so many hashes, and its probes: two vectors of cosine 0.9 then share a
#: bucket of one table with probability 0.95 to 0.97 (measured in 64 dimensions), of three tables with 0.9999.
#: Other widths take more tables for that (:func:`tables_of`).
PLANS: tuple[tuple[float, int, int], ...] = ((1e6, 2, 12), (6e7, 3, 48), (math.inf, 4, 128))
#: Nearest axes of a hash from which probes are combined.
AXES = 4
#: Vectors compared in one cell of a hot route, vectors of a bucket from which it gets a ball, rows compared at once.
CELL_ROWS, BALL_ROWS, BLOCK_ROWS = 32_768, 1024, 1024


def decode(payload: bytes) -> np.ndarray:
    """A vector from its bytes: a width (4 or 8), then components."""
    return np.frombuffer(payload, "<f4" if payload[0] == 4 else "<f8", offset=1).astype(np.float64)


def encode(values: np.ndarray) -> bytes | None:
    """Bytes of a usable vector, 4 a component where that loses nothing; None if it is empty, zero or not finite."""
    if not len(values) or not np.isfinite(values).all() or not values.any():
        return None
    values = values + 0.0  # one zero
    with np.errstate(over="ignore"):
        short = values.astype("<f4")
    return b"\x04" + short.tobytes() if (short == values).all() else b"\x08" + values.astype("<f8").tobytes()


def units(payloads: list[bytes]) -> np.ndarray:
    rows = np.stack([decode(p) for p in payloads])
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), up to its length's root."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows


def padded(width: int) -> int:
    return max(16, 1 << (width - 1).bit_length())


def tables_of(width: int) -> int:
    """Tables of vectors of ``width`` components.

    One table finds a pair of cosine 0.9 less often the wider the vectors are
    (0.75 to 0.81 at 1536 components), and very narrow vectors lie in the same
    few places of each table; so each doubling from 64 on adds a table, and
    fewer than 8 components take twice as many.
    """
    return 2 * TABLES if width < 8 else TABLES + max(0, (padded(width) // 64).bit_length() - 1)


class Hasher:
    """Buckets of unit vectors of one width."""

    def __init__(self, width: int, hashes: int, probes: int, tables: int | None = None, seed: int = SEED) -> None:
        self.width, self.hashes, self.tables = padded(width), hashes, tables or tables_of(width)
        tables = self.tables
        combos = np.array(list(itertools.product(range(AXES), repeat=hashes)))
        self.combos, self.probes = combos, min(probes, len(combos))
        self.signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, routes): [row, table, probe], the nearest bucket first. A route is a bucket without its last hash."""
        n = len(rows)
        full = np.zeros((n, self.width))
        full[:, : rows.shape[1]] = rows
        bucket = np.empty((n, self.tables, self.probes), np.int64)
        route = np.empty_like(bucket)
        for t in range(self.tables):
            axes, gaps = [], []
            for h in range(self.hashes):
                r = full
                for s in self.signs[t, h]:
                    r = hadamard(r * s) / math.sqrt(self.width)
                near = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :AXES]
                value = np.take_along_axis(r, near, axis=1)
                axes.append(2 * near + (value < 0))
                gaps.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
            far = sum(g[:, self.combos[:, h]] for h, g in enumerate(gaps))
            chosen = self.combos[np.argsort(far, axis=1, kind="stable")[:, : self.probes]]
            key = np.full((n, self.probes), t, np.int64)
            for h in range(self.hashes):
                if h == self.hashes - 1:
                    route[:, t] = key
                key = key * (2 * self.width) + np.take_along_axis(axes[h], chosen[:, :, h], axis=1)
            bucket[:, t] = key
        return bucket, route


def vectors(embeddings: DataFrame) -> DataFrame:
    """(id, key, payload) per row; key (a digest) and payload are null for vectors that link with nothing."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            payloads = []
            for row in batch.column("v"):
                if not row.is_valid or row.values.null_count:
                    payloads.append(None)
                else:
                    payloads.append(encode(row.values.to_numpy(zero_copy_only=False)))
            keys = [None if p is None else hashlib.md5(p, usedforsecurity=False).digest() for p in payloads]
            yield pa.record_batch([batch.column("id"), pa.array(keys, pa.binary()), pa.array(payloads, pa.binary())], names=["id", "key", "payload"])

    return (embeddings.select(long_id("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
            .mapInArrow(pack, "id long, key binary, payload binary"))


def _by_width(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, positions) of payloads of equally many components."""
    width = np.array([(len(p) - 1) // p[0] for p in payloads])
    for w in np.unique(width):
        yield int(w), np.flatnonzero(width == w)


def _home(hasher: Callable[[int], Hasher]) -> Callable:
    """Adds (width, home): each vector's nearest bucket in the first table."""
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            payloads = batch.column("payload").to_pylist()
            home, widths = np.empty(len(payloads), np.int64), np.empty(len(payloads), np.int32)
            for w, at in _by_width(payloads) if payloads else ():
                home[at], widths[at] = hasher(w)(units([payloads[i] for i in at]))[0][:, 0, 0], w
            yield pa.record_batch([*batch.columns, pa.array(widths), pa.array(home)], names=[*batch.schema.names, "width", "home"])

    return homes


def balls(classes: DataFrame, hasher: Callable[[int], Hasher], min_cosine: float, ball_rows: int) -> DataFrame:
    """``classes`` with (width, ball): vectors of one ball all have at least ``min_cosine`` with each other.

    A first-table home bucket of more than ``ball_rows`` vectors gets a ball
    around their mean direction, of half the greatest angle of a link. Its
    pairs then need no comparison, however many they are.
    """
    at_home = materialize(classes.mapInArrow(_home(hasher), "key binary, rep long, copies long, payload binary, width int, home long"), "embedding-home")
    hot = at_home.groupBy("width", "home").count().where(F.col("count") > ball_rows).select("width", "home")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def flush():
            return pa.record_batch([pa.array([w for w, _ in total], pa.int32()), pa.array([h for _, h in total], pa.int64()),
                                    pa.array([x.astype("<f8").tobytes() for x in total.values()], pa.binary())], names=["width", "home", "total"])

        for batch in sliced(batches, 4096):
            payloads, home = batch.column("payload").to_pylist(), batch.column("home").to_numpy()
            for w, at in _by_width(payloads) if payloads else ():
                rows = units([payloads[i] for i in at])
                for h in np.unique(home[at]):
                    total[w, int(h)] = total.get((w, int(h)), 0.0) + rows[home[at] == h].sum(axis=0)
            if len(total) >= 1024:
                yield flush()
                total.clear()
        if total:
            yield flush()

    def centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for w, h, part in zip(*(batch.column(c).to_pylist() for c in ("width", "home", "total"))):
                part = np.frombuffer(part, "<f8")
                if (w, h) != now:
                    if now:
                        yield center(now, total)
                    now, total = (w, h), 0.0
                total = total + part
        if now:
            yield center(now, total)

    def center(key, total):
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())],
                               names=["width", "home", "center"])

    middle = materialize(at_home.join(hot, ["width", "home"], "left_semi").mapInArrow(sums, "width int, home long, total binary")
                         .repartition("width", "home").sortWithinPartitions("width", "home")
                         .mapInArrow(centers, "width int, home long, center binary"), "embedding-centers")
    nearest = math.cos(math.acos(min_cosine) / 2) + 1e-9

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            payloads, center_of = batch.column("payload").to_pylist(), batch.column("center").to_pylist()
            ball = [None] * len(payloads)
            for i, c in enumerate(center_of):
                if c is not None:
                    c = np.frombuffer(c, "<f8")
                    size = math.sqrt(float(c @ c))
                    if size > 0 and float(units([payloads[i]])[0] @ c) / size >= nearest:
                        ball[i] = int(batch.column("home")[i].as_py())
            yield pa.record_batch([*(batch.column(c) for c in ("key", "rep", "copies", "payload", "width")), pa.array(ball, pa.int64())],
                                  names=["key", "rep", "copies", "payload", "width", "ball"])

    return materialize(at_home.join(middle, ["width", "home"], "left").mapInArrow(
        inside, "key binary, rep long, copies long, payload binary, width int, ball long"), "embedding-balls")


def _cells(members: DataFrame, hasher: Callable[[int], Hasher], cell_rows: int) -> DataFrame:
    """Members at every route they enter, hot routes dealt to cells of at most about ``cell_rows``.

    In a hot route the vectors of its largest ball need no comparison with
    each other: each goes to one block. The others (mostly few) are dealt to
    blocks too; a cell is a pair of blocks, and every pair of vectors that
    needs a comparison meets in exactly one cell. side: 0 or 1 in cells of two
    blocks (only pairs across are compared), 2 in cells of one.
    """
    def routes(carry: bool) -> Callable:
        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1024):
                payloads = batch.column("payload").to_pylist()
                row, route, entered = [], [], []
                for w, at in _by_width(payloads) if payloads else ():
                    bucket, own = (x.reshape(len(at), -1) for x in hasher(w)(units([payloads[i] for i in at])))
                    order = np.argsort(own, axis=1, kind="stable")
                    own, bucket = np.take_along_axis(own, order, axis=1), np.take_along_axis(bucket, order, axis=1)
                    new = np.ones(own.shape, bool)
                    new[:, 1:] = own[:, 1:] != own[:, :-1]
                    r, c = np.nonzero(new)
                    row.append(at[r])
                    route.append(own[r, c])
                    starts = np.append(np.flatnonzero(new.ravel()), own.size)
                    entered.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(bucket.ravel())))
                if row:
                    taken = batch.select(["width", "ball", *(("key", "copies", "payload") if carry else ())]).take(pa.array(np.concatenate(row)))
                    more = [pa.array(np.concatenate(route))] + ([pa.concat_arrays(entered)] if carry else [])
                    yield pa.record_batch([*taken.columns, *more], names=[*taken.schema.names, "route", *(["buckets"] if carry else [])])

        return enter

    counts = members.mapInArrow(routes(False), "width int, ball long, route long").groupBy("width", "route", "ball").count()
    size = (counts.groupBy("width", "route").agg(F.sum("count").alias("n"), F.max(F.when(F.col("ball").isNotNull(), F.struct("count", "ball"))).alias("most"))
            .where(F.col("n") > cell_rows)
            .select("width", "route", F.col("most.ball").alias("main"),
                    F.ceil(F.coalesce("most.count", F.lit(0)) / cell_rows).cast("int").alias("mains"),
                    F.greatest(F.lit(1), F.ceil((F.col("n") - F.coalesce("most.count", F.lit(0))) / cell_rows).cast("int")).alias("others")))
    entered = members.mapInArrow(routes(True), "width int, ball long, key binary, copies long, payload binary, route long, buckets array<long>")
    at = entered.join(size, ["width", "route"], "left")
    mine = F.col("ball").isNotNull() & F.col("ball").eqNullSafe(F.col("main"))
    block = F.pmod(F.xxhash64("key"), F.when(mine, F.col("mains")).otherwise(F.col("others"))).cast("int")
    cell = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<kind:int,a:int,b:int,side:int>>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("block")
    as_main = F.transform(upto(F.col("others")), lambda o: cell(1, own, o, 0))
    as_other = F.concat(F.transform(upto(F.coalesce("mains", F.lit(0))), lambda m: cell(1, m, own, 1)),
                        F.transform(upto(F.col("others")), lambda o: F.struct(
                            F.lit(0).alias("kind"), F.least(o, own).alias("a"), F.greatest(o, own).alias("b"),
                            F.when(o == own, 2).when(o > own, 0).otherwise(1).alias("side"))))
    cells = (F.when(F.col("n_hot").isNull(), F.array(cell(0, F.lit(0), F.lit(0), 2)))
             .when(F.col("mine"), as_main).otherwise(as_other))
    at = at.withColumn("mine", mine).withColumn("n_hot", F.col("others")).withColumn("block", F.coalesce(block, F.lit(0)))
    return (at.withColumn("cell", F.explode(F.coalesce(cells, none))).drop("mine", "main", "mains", "others", "n_hot", "block")
            .select("width", "route", "cell.kind", "cell.a", "cell.b", "cell.side", "key", "copies", "ball", "buckets", "payload"))


def _owned(one: np.ndarray, two: np.ndarray, bucket: int, table: int) -> np.ndarray:
    """Whether ``bucket`` is the first that both vectors enter, for pairs of bucket arrays [pair, table, probe]."""
    mine = np.ones(len(one), bool)
    for t in range(table):
        mine &= ~(one[:, t, :, None] == two[:, t, None, :]).any(axis=(1, 2))
    least = np.where((one[:, table, :, None] == two[:, table, None, :]).any(axis=2), one[:, table], np.iinfo(np.int64).max).min(axis=1)
    return mine & (least == bucket)


def _links(unit: np.ndarray, row: np.ndarray, bucket: np.ndarray, table: int, ball: np.ndarray, side: np.ndarray, all_buckets: Callable,
           min_cosine: float, block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) pairs linked under the first bucket that they share, for vectors ``row`` in ``bucket``, in slices."""
    order = np.lexsort((row, bucket))
    row, bucket = row[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        who = row[lo:hi]
        if len(who) < 2:
            continue
        for a in range(0, len(who), block_rows):
            x = who[a: a + block_rows]
            for b in range(a, len(who), block_rows):
                y = who[b: b + block_rows]
                near = unit[x] @ unit[y].T >= min_cosine - 1e-9
                if a == b:
                    near &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                if not near.any():
                    continue
                near &= (ball[x][:, None] != ball[y][None, :]) | (ball[x][:, None] < 0)
                near &= (side[x][:, None] != side[y][None, :]) | (side[x][:, None] == 2)
                i, j = np.nonzero(near)
                for at in range(0, len(i), 1 << 16):
                    p, q = x[i[at: at + (1 << 16)]], y[j[at: at + (1 << 16)]]
                    sure = (unit[p] * unit[q]).sum(axis=1) >= min_cosine
                    p, q = p[sure], q[sure]
                    if not len(p):
                        continue
                    first = _owned(all_buckets(p), all_buckets(q), int(bucket[lo]), table)
                    yield p[first], q[first]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of ``n`` rows reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for p, q in pairs:
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
        root = root[root]
        if (root == before).all():
            return root


def verified(cells: DataFrame, hasher: Callable[[int], Hasher], hashes: int, min_cosine: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, links, root) per vector and cell: its links owned by the cell, and a vector they lead to."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cell, held):
            width, route = cell[:2]
            rows = pa.Table.from_batches(held).combine_chunks()
            payloads = rows.column("payload").to_pylist()
            if len(payloads) < 2:
                return
            unit = units(payloads)
            known, table = {}, route // (2 * padded(width)) ** (hashes - 1)

            def all_buckets(who: np.ndarray) -> np.ndarray:
                """Every bucket of the vectors ``who``; worked out for vectors with a link only."""
                some, back = np.unique(who, return_inverse=True)
                new = [i for i in some.tolist() if i not in known]
                if new:
                    known.update(zip(new, hasher(width)(unit[new])[0]))
                return np.stack([known[i] for i in some.tolist()])[back]

            lists = rows.column("buckets").combine_chunks()
            entered = np.repeat(np.arange(len(payloads)), np.diff(lists.offsets.to_numpy()))
            ball = rows.column("ball").fill_null(-1).to_numpy()
            side, copies = rows.column("side").to_numpy(), rows.column("copies").to_numpy()
            links, found = np.zeros(len(unit), np.int64), []
            root = np.arange(len(unit))
            for p, q in _links(unit, entered, lists.flatten().to_numpy(), table, ball, side, all_buckets, min_cosine, block_rows):
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                found.append((p, q))
                if sum(len(x) for x, _ in found) > 1 << 20:  # a forest instead of the pairs so far
                    root = _roots(len(unit), [*found, (np.arange(len(unit)), root)])
                    found = []
            root = _roots(len(unit), [*found, (np.arange(len(unit)), root)])
            some = np.flatnonzero(links)
            if len(some):
                key = rows.column("key").combine_chunks()
                yield pa.record_batch([key.take(pa.array(some)), pa.array(links[some]), key.take(pa.array(root[some]))], names=["key", "links", "root"])

        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("width", "route", "kind", "a", "b")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1), True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                cell = tuple(ids[lo].tolist())
                if cell != now:
                    if held:
                        yield from compare(now, held)
                    now, held = cell, []
                held.append(batch.slice(lo, hi - lo).select(["key", "copies", "ball", "side", "buckets", "payload"]))
        if held:
            yield from compare(now, held)

    cell = ["width", "route", "kind", "a", "b"]
    return cells.repartition(*cell).sortWithinPartitions(*cell, "key").mapInArrow(meet, "key binary, links long, root binary")


def embedding_dedup(embeddings: DataFrame, min_cosine: float = MIN_COSINE, plans: tuple = PLANS, cell_rows: int = CELL_ROWS,
                    ball_rows: int = BALL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding).

    Pairs found in a common bucket are linked if their cosine, in doubles, is
    ``min_cosine`` or more; n_links counts the linked rows, equal vectors
    included, component_id is the smallest vec_id reachable. A null, empty or
    zero vector, or one with a null or non-finite component, links with
    nothing. Vectors of different widths do not link. Repeated rows and rows
    with equal ids count each. A null vec_id links too; its own id is null,
    and component_id is null only where no id is reachable. Other columns are
    ignored; an empty table gives no rows.

    Equal vectors are reduced to one with a count before anything is
    compared. Vectors of one ball (a dense bucket around its mean) are linked
    without comparing them. No pair leaves its task: a task emits link counts
    and one edge for each vector, and a pair counts under its first bucket.
    """
    rows = materialize(vectors(embeddings), "embedding-rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("payload").alias("payload"))
    classes = materialize(classes, "embedding-classes")
    n = classes.count()
    _, hashes, probes = next(p for p in plans if n <= p[0])

    def hasher(width: int, made: dict[int, Hasher] = {}) -> Hasher:  # noqa: B006 (kept between batches of a task)
        if width not in made:
            made[width] = Hasher(width, hashes, probes)
        return made[width]

    members = balls(classes, hasher, min_cosine, ball_rows)
    found = materialize(verified(_cells(members, hasher, cell_rows), hasher, hashes, min_cosine, block_rows), "embedding-links")
    ball = members.where("ball is not null").groupBy("width", "ball").agg(F.sum("copies").alias("size"), F.min("key").alias("root"))
    inside = (members.where("ball is not null").select("key", "width", "ball", "copies").join(ball, ["width", "ball"])
              .select("key", (F.col("size") - F.col("copies")).alias("links"), "root"))
    links = found.unionByName(inside)
    edges = links.where("key <> root").select(F.greatest("key", "root").alias("hi"), F.least("key", "root").alias("lo")).distinct()
    roots = connected_components(materialize(edges, "embedding-edges"))
    rooted = classes.select("key", "rep", "copies").join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", "copies", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    result = (rooted.join(least, "root").join(counted, "key", "left")
              .select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"))
    known = lambda c: F.when(c != NO_ID, c)
    linked = rows.where("key is not null").join(result, F.col("key") == F.col("k")).select("id", "links", "component")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        known(F.col("id")).alias("vec_id"), F.col("links").alias("n_links"), known(F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"))
