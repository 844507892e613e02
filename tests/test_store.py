"""The season store: parts by season, compare-and-set manifests, counts taken while writing, the stored league baseline."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from statlake.plans import publish as pub
from statlake.plans import shots
from statlake.plans.league import league_counts, with_league
from statlake.sources import files
from tests.conftest import SEASON

OTHER = "2023-24"


def moved(t, season=OTHER):
    """The seed as another season: other game ids, dates a year earlier."""
    other = lambda c: F.concat(F.lit("00223"), F.substring(c, 6, 5))
    facts = {n: getattr(t, n).withColumn("season", F.lit(season)) for n in pub.FACTS}
    facts = {n: df.withColumn("id" if n == "games" else "game_id", other("id" if n == "games" else "game_id")) for n, df in facts.items()}
    facts["games"] = facts["games"].withColumn("game_date", F.add_months("game_date", -12))
    return replace(t, **facts)


def new_store(spark):
    return pub.DatasetStore(spark, os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "store"))


def files_of(store, season):
    out = {}
    for folder, _, names in os.walk(store.root):
        for n in names:
            if f"season={season}/" in folder + "/" and not n.startswith("."):
                path = os.path.join(folder, n)
                out[path] = (os.path.getsize(path), os.stat(path).st_mtime_ns)
    return out


def counts(t):
    return {n: {r.season: r["count"] for r in getattr(t, n).groupBy("season").count().collect()} for n in pub.FACTS}


def test_a_replacement_writes_its_own_season_only(spark, seed):
    store = new_store(spark)
    store.replace_season(seed, SEASON, manifest_sha256="a" * 64)
    before = files_of(store, SEASON)
    first = store.manifest()
    second = store.replace_season(moved(seed), OTHER, manifest_sha256="b" * 64)
    assert files_of(store, SEASON) == before and files_of(store, OTHER)
    both = counts(store.read())
    assert all(set(c) == {SEASON, OTHER} and len(set(c.values())) == 1 for c in both.values())
    third = store.replace_season(replace(seed, players=seed.players.withColumn("last_name", F.lit("X"))), SEASON, manifest_sha256="c" * 64)
    assert store.manifest()["parts"]["shot_attempts"] == {SEASON: third, OTHER: second}
    assert counts(store.read()) == both and store.read().players.where("last_name = 'X'").count() == seed.players.count()
    # earlier versions stay readable
    assert store.manifest(1) == first and counts(store.read(first["version"])) == {n: {SEASON: c[SEASON]} for n, c in both.items()}
    assert {r.id: r.manifest_sha256[0] for r in store.read().seasons.collect()} == {SEASON: "c", OTHER: "b"}


def test_a_publisher_with_a_stale_base_is_refused(spark, seed):
    store = new_store(spark)
    store.replace_season(seed, SEASON, manifest_sha256="a" * 64)
    inner = []

    def meanwhile(_):
        inner.append(store.replace_season(moved(seed), OTHER, manifest_sha256="b" * 64))

    with pytest.raises(pub.StaleVersionError):
        store.replace_season(seed, SEASON, manifest_sha256="c" * 64, verify=meanwhile)
    assert store.current_version() == inner[0] and store.sequences() == [1, 2]
    assert store.read().seasons.where(F.col("id") == SEASON).first().manifest_sha256 == "a" * 64


def test_rows_of_another_season_are_refused(spark, seed):
    store = new_store(spark)
    wrong = replace(seed, shot_attempts=seed.shot_attempts.withColumn("season", F.when(F.col("event_id") == 1, OTHER).otherwise(F.col("season"))))
    with pytest.raises(pub.SeasonLifecycleError, match="not of season"):
        store.replace_season(wrong, SEASON)
    assert store.current_version() is None


def test_rows_of_the_seasons_games_under_another_season_go(spark, seed):
    """K7 through the store: a shot of this season's game that lies in another season is dropped with it."""
    store = new_store(spark)
    strays = moved(seed)
    stray = seed.shot_attempts.limit(1).withColumn("season", F.lit(OTHER)).withColumn("event_id", F.lit(9999))
    both = replace(seed, **{n: getattr(seed, n).unionByName(getattr(strays, n)) for n in pub.FACTS})
    both = replace(both, shot_attempts=both.shot_attempts.unionByName(stray))
    store.import_tables(both)
    assert store.read().shot_attempts.where("event_id = 9999").count() == 1
    before = files_of(store, OTHER)
    store.replace_season(seed, SEASON)
    assert store.read().shot_attempts.where("event_id = 9999").count() == 0
    assert counts(store.read())["shot_attempts"] == {SEASON: seed.shot_attempts.count(), OTHER: seed.shot_attempts.count()}
    after = files_of(store, OTHER)
    assert all(after[p] == v for p, v in before.items()) and {p for p in after if "/shot_attempts/" not in p} == {p for p in before if "/shot_attempts/" not in p}


def test_one_of_many_writers_creates_a_file(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "m", "1.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create_if_absent(spark, path, f"{i}\n" * 100), range(16)))
    assert won.count(True) == 1 and files.read_text(spark, path).split("\n") == [str(won.index(True))] * 100
    files.write_text_atomic(spark, path, "new")
    assert files.read_text(spark, path) == "new" and os.listdir(os.path.dirname(path)) == ["1.json"]


def test_counts_survive_a_lost_task():
    """The rows counted while writing are those written, also where a task fails and runs again."""
    script = """
import sys, tempfile
from pyspark.sql import SparkSession
from pyspark import TaskContext
from statlake.plans import publish as pub
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def flaky(batches):
    t = TaskContext.get()
    for b in batches:
        yield b
    if t.partitionId() == 1 and t.attemptNumber() < 2:
        raise RuntimeError("lost")
df = spark.range(0, 1000, 1, 4).mapInArrow(flaky, "id long")
store = pub.DatasetStore(spark, tempfile.mkdtemp(prefix="statlake-test-"))
n = store._write(df, "teams", None, "v")
print("counted", n, spark.read.parquet(store.part("teams", None, "v")).count())
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=180,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "counted 1000 1000" in out.stdout, out.stderr[-2000:]


def same(a, b):
    a, b = a.select(*b.columns), b
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stored_league_is_refreshed_for_the_replaced_season_only(spark, seed):
    store = new_store(spark)
    store.replace_season(seed, SEASON)
    store.replace_season(moved(seed), OTHER)
    kept = files_of(store, OTHER)
    fewer = replace(seed, shot_attempts=seed.shot_attempts.where("event_id % 3 <> 0"))
    store.replace_season(fewer, SEASON)
    t = store.read()
    assert same(t.league, league_counts(t)) and {p: v for p, v in files_of(store, OTHER).items() if "/league/" in p} == {
        p: v for p, v in kept.items() if "/league/" in p}
    plain = replace(t, league=None)
    for fn in (shots.shot_summary, shots.shot_zones, shots.league_shot_context):
        for f in (shots.ShotFilters(), shots.ShotFilters(season=SEASON, home_away="away", period=2), shots.ShotFilters(shot_type="3PT Field Goal", made=True)):
            assert same(fn(t, f), fn(plain, f))
    assert with_league(t) is t and same(with_league(plain).league, t.league)
