"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.llm.common import materialize


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    near = large.join(low, "hi")
    small = near.select("hi", F.col("m").alias("lo")).unionAll(
        near.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return small.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(hi, lo) links with hi > lo, each once -> (node, root): root is the least node reachable, for linked nodes only.

    Every round is one distributed job over the links (grouped minima and
    joins, so a hub's links stay spread over tasks); the rounds grow with the
    logarithm of the longest chain. Only a row count and a checksum of each
    round reach the driver. Rounds are cut by tables in the shared folder.
    """
    def sign(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()

    now = sign(edges)
    while now[0]:
        edges = materialize(_round(edges), "components")
        before, now = now, sign(edges)
        if before == now:
            break
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots
