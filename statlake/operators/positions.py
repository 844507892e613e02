"""Global positions of a total order, without a single-task sort: range-partitioned, sorted parts and their row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlake.sources.stored import stored

_PLACE_BITS = 33  # of monotonically_increasing_id: the row in its partition below, the partition above


def with_positions(df: DataFrame, order: list[Column], label: str = "positions") -> DataFrame:
    """``df`` with ``position`` (from 1, by ``order``) and ``total``.

    The rows are range-partitioned and sorted part by part, written once with
    their part and place, and each part's offset is the sum of the counts of
    the parts before it: one row a part is all that meets in one task. ``order``
    should be total; ties have any order.
    """
    at = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    rows = stored(parts, label).select(
        *df.columns, F.shiftright("_at", _PLACE_BITS).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place"))
    every = Window.orderBy("_part")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("_part", (F.sum("n").over(every) - F.col("n")).alias("_before"),
                            F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    # one row a part: as many rows as the sort had partitions
    placed = rows.join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias("position"), "total")


def page_at(df: DataFrame, order: list[Column], limit: int, offset: int, label: str = "page") -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` of ``order`` with position and total, however deep the page lies."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    return with_positions(df, order, label).where((F.col("position") > offset) & (F.col("position") <= offset + limit))
