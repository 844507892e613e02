"""Exact grouped percentiles without holding a group's values in one task.

``percentile`` (and DuckDB's ``quantile_cont``) interpolate linearly between the
values at 0-based ranks floor(pos) and ceil(pos), pos = (n - 1) * p. The built-in
aggregate merges a group's whole value -> count map in one task, so a hot group
(one path holding a third of all requests, with near-continuous latencies) is
one task holding a third of the distinct values. Here the rank lookup is spread:

1. (keys, value) -> count, a partial aggregate;
2. range-partitioned on (keys, value): a hot group's values span many
   partitions ("chunks"), checkpointed so chunk ids stay fixed;
3. per (keys, chunk) counts -> running offsets per group (at most one row per
   partition for a group);
4. the target rows (at most two per group and percentile) are checkpointed;
   only the chunks holding a target rank are read again, ranked inside the
   chunk, and the values at the target ranks picked and interpolated the way
   ``percentile`` does. The chunk data is scanned twice in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statlake.operators.joins import null_safe_on


def exact_percentiles(df: DataFrame, keys: list[str], value: str, percentages: dict[str, float],
                      partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per group with at least one non-null ``value``: keys + one double column per name.
    A row stands for ``weight`` equal ones (a whole number from 1), else for itself."""
    from statlake.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).cast("double").alias("v"))
               .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c")))
    chunked = (counted.repartitionByRange(n, *keys, "v")
               .withColumn("pid", F.spark_partition_id())
               .checkpoint(eager=True))

    group = Window.partitionBy(*keys)
    chunks = (chunked.groupBy(*keys, "pid").agg(F.sum("c").alias("cnt"))
              .withColumn("before", F.coalesce(F.sum("cnt").over(
                  group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("total", F.sum("cnt").over(group)))
    pos = lambda p: (F.col("total") - 1) * F.lit(float(p))
    targets = chunks.select(
        *keys, "pid", "before", "cnt",
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), pos(p).alias("pos"),
                     (F.floor(pos(p)) if side == "lo" else F.ceil(pos(p))).alias("k"))
            for name, p in percentages.items() for side in ("lo", "hi")])),
    ).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("cnt"))).checkpoint(eager=True)

    # key joins are null-safe: a null key (e.g. a null time window) is a group like any other
    on = [*keys, "pid"]
    needed = targets.select(*on).distinct()
    ranked = (chunked.join(needed, null_safe_on(chunked, needed, on), "left_semi")
              .withColumn("upto", F.sum("c").over(
                  Window.partitionBy(*on).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))))
    tgt = targets.select(*[F.col(c).alias(f"t_{c}") for c in on], "name", "side", "pos", "k", "before")
    hits = (ranked.join(tgt, null_safe_on(ranked, tgt, on, "t_"))
            .where((F.col("k") >= F.col("before") + F.col("upto") - F.col("c"))
                   & (F.col("k") < F.col("before") + F.col("upto"))))
    picked = hits.groupBy(*keys, "name").agg(
        F.max("pos").alias("pos"),
        F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("lo_v"),
        F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("hi_v"),
    )
    lower, higher = F.floor("pos"), F.ceil("pos")
    result = picked.select(
        *keys, "name",
        F.when(higher == lower, F.col("lo_v")).when(F.col("lo_v") == F.col("hi_v"), F.col("lo_v"))
        .otherwise((higher - F.col("pos")) * F.col("lo_v") + (F.col("pos") - lower) * F.col("hi_v"))
        .alias("q"))
    return result.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in percentages])
