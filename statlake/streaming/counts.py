"""R1 and R2 as streams without open windows: every micro-batch lands mergeable counts, a reading merges them.

A batch's counts are a folder of its own, written whole again where a batch is
replayed, so each event counts once. Counts are exact by value (latencies too),
so late events need no watermark and none is lost; there is no state to hold,
and :func:`fold` merges the folders of many batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statlake.operators.joins import null_safe_join
from statlake.operators.quantiles import exact_percentiles
from statlake.sources.files import exists, list_names
from statlake.streaming.events import SLOW_REQUEST_MS, usage_allowlist, usage_counts

Partial = Callable[[DataFrame], DataFrame]


def land_batches(stream: DataFrame, path: str, checkpoint: str, partials: dict[str, Partial]) -> StreamingQuery:
    """Start a run over all that is available now; batch ``i`` writes each partial to ``path/<name>/batch=i``."""

    def land(batch: DataFrame, number: int) -> None:
        batch.persist()  # read once, lost blocks are read again
        try:
            for name, partial in partials.items():
                partial(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, folder: str) -> tuple[list[str], int]:
    """The folders that count (the newest fold and the batches after it, each complete) and the last batch in them."""
    done = {"batch": [], "upto": []}
    for name in list_names(spark, folder):
        kind, _, number = name.partition("=")
        if kind in done and number.isdigit() and exists(spark, f"{folder}/{name}/_SUCCESS"):
            done[kind].append(int(number))
    start = max(done["upto"], default=-1)
    later = sorted(n for n in done["batch"] if n > start)
    folders = [f"{folder}/upto={start}"] if start >= 0 else []
    return folders + [f"{folder}/batch={n}" for n in later], max([start, *later])


def landed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All rows of a partial, of complete batches only."""
    folders, _ = _complete(spark, f"{path}/{name}")
    if not folders:
        raise LookupError(f"no batch of {name} was landed under {path}")
    return spark.read.parquet(*folders)


def fold(spark: SparkSession, path: str, name: str, merge: Partial) -> None:
    """Merge what was landed into one folder, which takes the place of its batches for readers (they may be deleted then)."""
    folders, last = _complete(spark, f"{path}/{name}")
    if len(folders) > 1:
        merge(spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{path}/{name}/upto={last}")


# --- R1 ---------------------------------------------------------------------------
USAGE: dict[str, Partial] = {
    "usage": lambda events: usage_counts(usage_allowlist(events)[0]),
    "quarantine": lambda events: usage_allowlist(events)[1],
}


def merge_usage(counts: DataFrame) -> DataFrame:
    return counts.groupBy("event", "view", "hour_start").agg(F.sum("events").alias("events"))


# --- R2 ---------------------------------------------------------------------------
def latency_counts(requests: DataFrame, window: str = "1 hour") -> DataFrame:
    """Requests and server errors by (path, window, exact latency)."""
    return requests.groupBy("path", F.window("ts", window).start.alias("window_start"), "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("errors"))


REQUESTS: dict[str, Partial] = {"latencies": latency_counts}


def merge_latencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("path", "window_start", "duration_ms").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """R2's figures from landed counts, as ``request_metrics`` gives them for the requests themselves."""
    keys = ["path", "window_start"]
    slow = F.when(F.col("duration_ms") >= SLOW_REQUEST_MS, F.col("n")).otherwise(0)
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("requests"), F.sum("errors").alias("server_errors"), F.sum(slow).alias("slow_requests"))
    shares = exact_percentiles(counts, keys, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, weight="n")
    return null_safe_join(sums, shares, keys, "left").select(
        *keys, "requests", "server_errors", "slow_requests", F.round("p50_ms", 3).alias("p50_ms"), F.round("p95_ms", 3).alias("p95_ms"))
