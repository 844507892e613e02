"""Publication (write-audit-publish) and the operational event jobs."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from statlake.plans import publish as pub
from statlake.streaming import events as ev
from tests.conftest import LEBRON, SEASON


def test_replace_season_publishes_and_keeps_old_version_on_failure(spark, seed):
    root = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "store")
    store = pub.DatasetStore(spark, root)
    assert store.current_version() is None
    v1 = store.replace_season(seed, SEASON, manifest_sha256="a" * 64)
    assert store.current_version() == v1
    t = store.read()
    meta = t.seasons.where(F.col("id") == SEASON).first()
    assert (meta.games_count, meta.players_count, meta.shot_attempts_count, meta.verification_status) == (10, 3, 295, "passed")
    assert t.shot_attempts.count() == 295

    def failing(_):
        raise pub.SeasonLifecycleError("audit failed")

    with pytest.raises(pub.SeasonLifecycleError):
        store.replace_season(seed, SEASON, manifest_sha256="b" * 64, verify=failing)
    assert store.current_version() == v1  # readers still see the verified version
    assert store.read().seasons.first().manifest_sha256 == "a" * 64

    v2 = store.replace_season(seed, SEASON, single_season=True, manifest_sha256="c" * 64)
    assert store.current_version() == v2 and store.read().shot_attempts.count() == 295
    pub.read_back(store.read(), SEASON)


def test_delete_season_needs_confirmation(seed):
    with pytest.raises(pub.SeasonLifecycleError):
        pub.delete_season(seed, SEASON)
    assert pub.delete_season(seed, SEASON, confirm=True).shot_attempts.count() == 0
    assert pub.delete_season_by_game(seed, SEASON).player_game_stats.count() == 0


def test_upsert_and_prune(spark, seed):
    new = seed.players.where(F.col("id") == LEBRON).withColumn("full_name", F.lit("L. James"))
    out = {r.id: r.full_name for r in pub.upsert(seed.players, new, ["id"]).collect()}
    assert out[LEBRON] == "L. James" and len(out) == 3
    kept = pub.prune_not_in(seed.players, seed.shot_attempts.select(F.col("player_id").alias("id")), ["id"])
    assert kept.count() == 2


def reference_limiter(times, window, limit):
    admitted, out = deque(), []
    for now in times:
        while admitted and admitted[0] <= now - window:
            admitted.popleft()
        if len(admitted) >= limit:
            out.append((False, max(1, int(window - (now - admitted[0])) + 1)))
        else:
            admitted.append(now)
            out.append((True, 0))
    return out


def test_limiter_decisions():
    assert reference_limiter([0, 1, 2, 60, 61], 60, 2) == [(True, 0), (True, 0), (False, 59), (True, 0), (True, 0)]
    q = deque()
    assert [ev._decide(q, t, 60, 2) for t in (0, 1, 2, 60, 61)] == reference_limiter([0, 1, 2, 60, 61], 60, 2)


def _requests(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    rid = 0
    for client, offsets in (("a", [0, 1, 2, 3, 30, 61, 62, 63]), ("b", [0, 100, 101, 102])):
        for group in ("general", "expensive"):
            for off in offsets:
                rows.append((rid, base + dt.timedelta(seconds=off), client, group))
                rid += 1
    return spark.createDataFrame(rows, "request_id long, ts timestamp, client string, group string")


def test_rate_limit_batch_matches_reference(spark):
    req = _requests(spark)
    got = {(r.client, r.group, r.request_id): (r.allowed, r.retry_after)
           for r in ev.rate_limit(req, 60, {"general": 3, "expensive": 1}, partitions=3).collect()}
    for (client, group), part in req.toPandas().groupby(["client", "group"]):
        part = part.sort_values(["ts", "request_id"])
        secs = (part["ts"] - dt.datetime(2024, 1, 1)).dt.total_seconds().tolist()
        expected = reference_limiter(secs, 60, {"general": 3, "expensive": 1}[group])
        assert [got[(client, group, rid)] for rid in part["request_id"]] == expected


def test_rate_limit_stream_matches_batch(spark):
    req = _requests(spark)
    d = tempfile.mkdtemp(prefix="statlake-test-")
    req.write.parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(req.schema).parquet(os.path.join(d, "in"))
    out = ev.rate_limit_stream(stream, 60, {"general": 3, "expensive": 1})
    q = (out.writeStream.format("parquet").option("path", os.path.join(d, "out"))
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = {(r.request_id, r.allowed, r.retry_after) for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    batch = {(r.request_id, r.allowed, r.retry_after)
             for r in ev.rate_limit(req, 60, {"general": 3, "expensive": 1}).collect()}
    assert streamed == batch


def test_usage_allowlist_and_client_key(spark):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "view", "standings"), (2, dt.datetime(2024, 1, 1), "hack", "x")],
                              "event_id long, ts timestamp, event string, view string")
    ok, bad = ev.usage_allowlist(e)
    assert [r.event_id for r in ok.collect()] == [1] and [r.event_id for r in bad.collect()] == [2]
    h = spark.createDataFrame([("203.0.113.5", "1.1.1.1, 2.2.2.2", "9.9.9.9"), ("bogus", "1.1.1.1, 2.2.2.2", "9.9.9.9"),
                               (None, None, "9.9.9.9"), (None, "", None)],
                              "edge string, xff string, peer string")
    keys = [r.k for r in h.select(ev.client_key(F.col("edge"), F.col("xff"), F.col("peer"), 1, True).alias("k")).collect()]
    assert keys == ["203.0.113.5", "2.2.2.2", "9.9.9.9", "unknown"]
    keys2 = [r.k for r in h.select(ev.client_key(F.col("edge"), F.col("xff"), F.col("peer"), 2, False).alias("k")).collect()]
    assert keys2 == ["1.1.1.1", "1.1.1.1", "9.9.9.9", "unknown"]


def test_snapshot_retention_and_freshness(spark):
    now = dt.datetime(2024, 3, 1)
    objs = [("p/", f"p/{i:02d}.dump", now - dt.timedelta(days=i)) for i in range(12)] + [("p/", "p/proven.json", now)]
    objects = spark.createDataFrame(objs, "prefix string, key string, modified timestamp")
    pointers = spark.createDataFrame([("p/", "p/10.dump", now - dt.timedelta(days=5))],
                                     "prefix string, key string, proven_at timestamp")
    expired = {r.key for r in ev.expired_snapshots(objects, pointers, F.lit(now), retention_days=8).collect()}
    assert expired == {"p/09.dump", "p/11.dump"}  # newest 7 kept, proven kept, .json ignored
    f = ev.snapshot_freshness(objects, pointers, F.lit(now)).first()
    assert (f.newest_backup, f.backup_count, f.newest_backup_age_hours, f.drill_age_days, f.fresh) == ("p/00.dump", 12, 0.0, 5.0, True)


def _write_clean(spark, seed, root):
    from statlake.sources import files

    for name, df in seed.as_dict().items():
        if name == "seasons":
            continue
        rel = files.CLEAN_FILES[name].format(season=SEASON)
        files.write_csv(df.coalesce(2), os.path.join(root, rel))


def test_manifest_round_trip_and_tamper(spark, seed):
    root = tempfile.mkdtemp(prefix="statlake-test-")
    _write_clean(spark, seed, root)
    manifest = pub.build_manifest(spark, root, SEASON, {"status": "passed", "mismatch_count": 0})
    assert manifest["counts"]["shot_attempts"] == 295 and all(len(e["sha256"]) == 64 for e in manifest["files"])
    data = pub.verify_manifest(spark, root, SEASON, manifest)
    assert data["games"].count() == 10
    with pytest.raises(pub.SeasonLifecycleError):
        pub.build_manifest(spark, root, SEASON, {"status": "failed"})
    games_dir = os.path.join(root, SEASON, "games.csv")
    part = sorted(n for n in os.listdir(games_dir) if n.startswith("part-"))[0]
    with open(os.path.join(games_dir, part), "a") as fh:
        fh.write("0022499999,2024-12-01,2024-25,1,2,3,4\n")
    crc = os.path.join(games_dir, f".{part}.crc")  # an outside edit leaves no Hadoop checksum behind
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(pub.SeasonLifecycleError, match="digest"):
        pub.verify_manifest(spark, root, SEASON, manifest)


def test_export_csv_and_guard(spark, seed, monkeypatch):
    from statlake.operators.shot_filters import ShotFilters
    from statlake.plans import shots

    out = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "export")
    n = shots.export_shots_csv(seed, ShotFilters(season=SEASON, player_id=LEBRON), out)
    lines = open(os.path.join(out, [f for f in os.listdir(out) if f.startswith("part-")][0])).read().splitlines()
    assert n == 200 and lines[0].split(",") == shots.EXPORT_COLUMNS and len(lines) == 201
    assert lines[1].split(",")[1:3] == ["0022400001", "1"]
    monkeypatch.setattr(shots, "EXPORT_LIMIT", 100)
    with pytest.raises(OverflowError):
        shots.export_shots_csv(seed, ShotFilters(season=SEASON, player_id=LEBRON), out + "2")


def test_season_build_round_trip(spark, seed):
    from statlake.operators import transforms as tf
    from statlake.sources.testviews import provider_feeds

    feeds = provider_feeds(seed)
    built = tf.season_build(feeds["teams"], feeds["players"], feeds["team_log"], feeds["player_log"], feeds["shots"], SEASON)
    for name, df in built.items():
        assert df.exceptAll(getattr(seed, name)).count() == 0, name
        assert getattr(seed, name).exceptAll(df).count() == 0, name


def test_usage_and_request_metrics_stream_equal_batch(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), ["view", "share", "hack"][i % 3], ["standings", "games"][i % 2],
             f"/api/{['a', 'b'][i % 2]}", 500 if i % 5 == 0 else 200, float(i * 37 % 1500)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event string, view string, path string, status int, duration_ms double")
    d = tempfile.mkdtemp(prefix="statlake-test-")
    df.write.parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    accepted, _ = ev.usage_allowlist(stream)
    for name, out, batch in (("usage", ev.usage_counts(accepted), ev.usage_counts(ev.usage_allowlist(df)[0])),
                             ("metrics", ev.request_metrics(stream), ev.request_metrics(df))):
        q = (out.writeStream.outputMode("complete").format("memory").queryName(f"r_{name}")
             .option("checkpointLocation", os.path.join(d, f"ckpt_{name}")).trigger(availableNow=True).start())
        q.awaitTermination(300)
        got = spark.table(f"r_{name}")
        assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_rate_limit_hot_key_split_across_partitions(spark):
    """One client holds most requests; range partitioning splits it over many
    partitions and the carried states must reproduce the sequential answer."""
    import random

    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows, rid = [], 0
    for client, n in (("hot", 1500), ("c1", 40), ("c2", 40)):
        t = 0.0
        for _ in range(n):
            t += rnd.choice([0.5, 1.0, 2.0, 5.0, 10.0, 30.0])
            rows.append((rid, base + dt.timedelta(seconds=t), client, rnd.choice(["general", "expensive", "docs"])))
            rid += 1
    req = spark.createDataFrame(rows, "request_id long, ts timestamp, client string, group string")
    limits = {"general": 5, "expensive": 2}  # "docs" is exempt
    out = ev.rate_limit(req, 60, limits, partitions=12)
    got = {r.request_id: (r.allowed, r.retry_after) for r in out.collect()}
    assert len(got) == len(rows)
    for (client, group), part in req.toPandas().groupby(["client", "group"]):
        part = part.sort_values(["ts", "request_id"])
        if group not in limits:
            assert all(got[r] == (True, 0) for r in part["request_id"])
            continue
        secs = (part["ts"] - base).dt.total_seconds().tolist()
        assert [got[r] for r in part["request_id"]] == reference_limiter(secs, 60, limits[group])
    hot_parts = out.where(F.col("client") == "hot").select(F.spark_partition_id()).distinct().count()
    assert hot_parts > 1


def test_exact_percentiles_match_builtin_on_split_hot_group(spark):
    import random

    from statlake.operators.quantiles import exact_percentiles

    rnd = random.Random(3)
    rows = [("hot", round(rnd.expovariate(0.01), 1)) for _ in range(3000)]
    rows += [("hot", 5.0)] * 200  # duplicates straddling chunk edges
    rows += [(f"k{i % 7}", float(rnd.randint(0, 50))) for i in range(300)]
    rows += [("one", 42.0), ("nulls", None), (None, 3.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "path string, d double")
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r.path: r for r in exact_percentiles(df, ["path"], "d", ps, partitions=16).collect()}
    want = {r.path: r for r in df.groupBy("path").agg(
        *[F.percentile("d", F.lit(p)).alias(n) for n, p in ps.items()]).where(F.col("p50").isNotNull()).collect()}
    assert set(got) == set(want) and "nulls" not in got
    for path, r in want.items():
        assert all(got[path][n] == r[n] for n in ps), path


def test_rate_limit_is_time_zone_independent(spark):
    """Across a daylight-saving change in the session zone, decisions follow real
    elapsed time and every timestamp comes back unchanged."""
    utc = dt.timezone.utc
    start = dt.datetime(2024, 11, 3, 4, 0, tzinfo=utc)  # 00:00 EDT; clocks fall back at 06:00 UTC
    stamps = [start + dt.timedelta(minutes=12 * i) for i in range(30)]
    rows = [(i, ts, "c", "general") for i, ts in enumerate(stamps)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        req = spark.createDataFrame(rows, "request_id long, ts timestamp, client string, group string")
        out = ev.rate_limit(req, 3600, {"general": 3}, partitions=4).select(
            "request_id", F.unix_micros("ts").alias("us"), "allowed", "retry_after").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    got = {r.request_id: (r.us, r.allowed, r.retry_after) for r in out}
    secs = [(ts - start).total_seconds() for ts in stamps]
    expected = reference_limiter(secs, 3600, 3)
    for i, ts in enumerate(stamps):
        assert got[i] == (int(ts.timestamp() * 1_000_000), *expected[i]), i


def test_batch_request_metrics_do_not_use_the_single_task_percentile(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), "/api/a", 200, float(i % 97)) for i in range(500)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, path string, status int, duration_ms double")
    out = ev.request_metrics(df)
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "percentile(" not in text and "RangePartitioning" not in text  # chunks come from the checkpoint
    assert "Scan ExistingRDD" in text or "ExistingRDD" in text
