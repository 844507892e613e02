"""R1 and R2 streams that land mergeable counts: late rows, replayed and torn batches, folding."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from statlake.streaming import counts as ec
from statlake.streaming import events as ev


def _requests(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), ["view", "share", "hack"][i % 3], ["standings", "games"][i % 2],
             f"/api/{['a', 'b'][i % 2]}", 500 if i % 5 == 0 else 200, None if i % 11 == 0 else float(i * 37 % 23 * 100)) for i in range(90)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, event string, view string, path string, status int, duration_ms double")


def _same(got, want):
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _run(spark, df, root, partials):
    ec.land_batches(spark.readStream.schema(df.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint",
                    partials).awaitTermination()


def test_counts_merge_to_the_batch_figures_with_late_rows(spark):
    df, root = _requests(spark), tempfile.mkdtemp(prefix="statlake-test-")
    both = {**ec.USAGE, **ec.REQUESTS}
    for late in (1, 2, 0):  # the last part is the oldest rows of every window
        df.where(F.col("event_id") % 3 == late).write.mode("append").parquet(f"{root}/in")
        _run(spark, df, root, both)
    out = f"{root}/out"

    def check():
        accepted, refused = ev.usage_allowlist(df)
        _same(ec.merge_usage(ec.landed(spark, out, "usage")), ev.usage_counts(accepted))
        _same(ec.landed(spark, out, "quarantine"), refused)
        _same(ec.metrics_of_counts(ec.landed(spark, out, "latencies")), ev.request_metrics(df))

    check()
    # a batch that died while it was written does not count
    ec.latency_counts(df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/latencies/batch=7")
    check()
    ec.fold(spark, out, "usage", ec.merge_usage)
    ec.fold(spark, out, "latencies", ec.merge_latencies)
    assert ec._complete(spark, f"{out}/latencies") == ([f"{out}/latencies/upto=2"], 2)
    check()
    # batches after a fold count beside it
    df.limit(9).write.mode("append").parquet(f"{root}/in")
    _run(spark, df, root, both)
    assert ec.landed(spark, out, "latencies").agg(F.sum("n")).first()[0] == 99


def test_a_replayed_batch_counts_once(spark):
    df, root = _requests(spark), tempfile.mkdtemp(prefix="statlake-test-")
    df.write.parquet(f"{root}/in")
    _run(spark, df, root, ec.REQUESTS)
    # the same batch again, as after a driver lost before its commit was logged
    ec.land_batches(spark.readStream.schema(df.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint-lost",
                    ec.REQUESTS).awaitTermination()
    _same(ec.metrics_of_counts(ec.landed(spark, f"{root}/out", "latencies")), ev.request_metrics(df))
