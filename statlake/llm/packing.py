"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statlake.llm.common import materialize, word_count

#: Permitted sequence lengths (tokens), cost of a sequence beside its tokens, and pieces packed together.
CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 32.0
SHARD_PIECES = 4096


def best_fit(sizes: list[int], capacities: list[int], bin_cost: float = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Best fit of sizes given in falling order: (bin of each, offset of each, capacity of each bin).

    A size goes into the open bin with the least room that holds it. If none
    does, the bin is opened whose cost, less the price of the room that the
    sizes still to come can fill, is least: all capacities compete for every
    new bin. In the end each bin gets the least capacity that holds its
    contents.
    """
    capacities = sorted(capacities)
    largest = capacities[-1]
    price = min((c + bin_cost) / c for c in capacities)
    count = np.bincount(np.array(sizes, np.int64), minlength=largest + 1)
    tokens_upto = np.cumsum(count * np.arange(largest + 1)).tolist()
    bins, offsets, used = [], [], []
    rooms: list[list[int]] = [[] for _ in range(largest + 1)]
    open_rooms, free, left = 0, 0, tokens_upto[-1]  # bit r: some bin has room r
    for size in sizes:
        left -= size
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            free -= size
        else:
            best = None
            for c in capacities:
                if c < size:
                    continue
                rest = c - size
                supply = max(0, min(tokens_upto[rest], left) - free)
                cost = c + bin_cost - price * min(rest, supply)
                if best is None or cost < best[0]:
                    best = (cost, c)
            room, b = best[1], len(used)
            used.append(0)
            free += room - size
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            rooms[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: (doc_id, piece, start, n_tokens, bin_id, capacity, offset).

    Tokens are words. A text longer than the largest capacity is cut into
    pieces of that length and a rest (``start``: its first word), so no token
    is lost. Pieces are packed in shards of about ``shard_pieces`` (dealt by a
    hash of their values, so the bins do not depend on the layout of the
    files), each by best fit; the shards grow in number, not in size. A row without words (null or empty text) returns once with
    n_tokens 0 and no bin. Repeated rows are packed each; null ids stay null;
    other columns are ignored; an empty table gives no rows.
    """
    largest = max(capacities)
    counted = docs.select("doc_id", word_count("text").alias("n"))
    pieces = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * largest).alias("start"),
                           F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n_tokens"))
    pieces = materialize(pieces, "pack-pieces")
    shards = max(1, -(-pieces.where("n_tokens > 0").count() // shard_pieces))
    # rows that repeat in all of these are told apart by a number: they are alike, so its order does not matter
    alike = W.partitionBy("doc_id", "piece", "n_tokens").orderBy(F.lit(1))
    placed = (pieces.where("n_tokens > 0").withColumn("tie", F.row_number().over(alike))
              .withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id"), F.col("piece"), F.col("n_tokens"), F.col("tie")), F.lit(shards))).drop("tie"))
    kind = dict(docs.dtypes)["doc_id"]

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, caps = best_fit(rows["n_tokens"].tolist(), list(capacities), bin_cost)
        return rows.assign(bin_id=rows["shard"] * (1 << 32) + np.array(bins, np.int64), capacity=np.array(caps, np.int64)[bins],
                           offset=np.array(offsets, np.int64)).drop(columns="shard")

    packed = placed.groupBy("shard").applyInPandas(
        shard, f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, capacity long, offset long")
    empty = pieces.where("n_tokens = 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "capacity", "offset")])
    return packed.unionByName(empty)
