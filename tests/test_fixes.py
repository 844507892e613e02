"""Wrong answers of the first round, each with the input that showed it."""

from __future__ import annotations

import dataclasses
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from statlake.operators import crosscheck as cc
from statlake.operators import rules
from statlake.plans import publish as pub
from statlake.plans import quality, shots
from statlake.sources import files, resultset
from statlake.streaming import events as ev
from tests.conftest import LEBRON, SEASON, frames, seed_rows


def _folder():
    return os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "x")


def test_feed_with_a_null_total_never_passes(spark, seed):
    def feed(local, key, columns):
        return local.select("season", F.col(local.columns[1]).alias(key), *[F.col(v).alias(k) for k, v in columns.items()])

    lt, lp = cc.local_team_totals(seed), cc.local_player_totals(seed)
    teams, players = feed(lt, "TEAM_ID", cc.TEAM_STATS), feed(lp, "PLAYER_ID", cc.PLAYER_STATS)
    assert cc.crosscheck(seed, teams, players).where("issue <> 'difference'").count() == 0
    broken = players.withColumn("PTS", F.when(F.col("PLAYER_ID") == LEBRON, None).otherwise(F.col("PTS")))
    found = cc.crosscheck(seed, teams, broken)
    assert {"mismatch", "invalid_official"} <= {r.issue for r in found.collect()}
    assert cc.report_counts(found).first().status == "failed"


def test_malformed_csv_fails(spark):
    path = _folder()
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as f:
        f.write("id,name,extra\n01,A,x\n2,B,y\n")
    assert [tuple(r) for r in files.read_clean_csv(spark, path, ["id", "name"]).orderBy("name").collect()] == [("01", "A"), ("2", "B")]
    for line in ("3,C,z,more\n", "3\n"):
        with open(f"{path}/a.csv", "w") as f:
            f.write("id,name,extra\n01,A,x\n" + line)
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            files.read_clean_csv(spark, path, ["id"]).collect()


def test_empty_tables_are_refused(seed):
    raw = rules.as_text(seed)
    with pytest.raises(rules.DatasetValidationError, match="without rows"):
        rules.validate_dataset({n: df.limit(0) for n, df in raw.items()})


def test_natural_key_used_in_two_seasons(spark):
    rows = seed_rows()
    rows["shot_attempts"].append(dict(rows["shot_attempts"][0], season="2023-24"))
    rows["seasons"].append(dict(rows["seasons"][0], id="2023-24", start_year=2023, end_year=2024))
    found = {r.season: r.violations for r in quality.d17_natural_keys(frames(spark, rows)).collect()}
    assert found == {SEASON: 1, "2023-24": 1}


def test_unfinished_landing_is_landed_again(spark):
    path = _folder()
    resultset.land_if_absent(spark.range(5), path)
    os.remove(f"{path}/_SUCCESS")
    resultset.land_if_absent(spark.range(7), path)
    assert spark.read.json(path).count() == 7


@pytest.mark.parametrize("address,valid", [
    ("::::", False), ("1:2", False), ("::ffff:1.2.3.4", True), ("::", True), ("2001:db8::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False),
    ("1:2:3:4:5:6:7:8:9", False), ("1::2::3", False), ("12345::", False), ("::a1.2.3.4", False), ("1.2.3.4", True), ("1.2.3.256", False), ("1:2:3:4:5:6:1.2.3.4", True)])
def test_client_address_grammar(spark, address, valid):
    row = spark.createDataFrame([(address, "9.9.9.9", None)], "edge string, xff string, peer string")
    got = row.select(ev.client_key(F.col("edge"), F.col("xff"), F.col("peer"), 1, True)).first()[0]
    assert got == (address if valid else "9.9.9.9")


def test_long_client_values_stay_apart(spark):
    a, b = "x" * 120 + "1", "x" * 120 + "2"
    row = spark.createDataFrame([(a,), (b,)], "peer string")
    keys = {r[0] for r in row.select(ev.client_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("peer"))).collect()}
    assert keys == {a, b}


def test_rows_without_season_survive_a_season_delete(seed):
    shots_ = seed.shot_attempts.withColumn("season", F.when(F.col("event_id") != 1, F.col("season")))
    assert pub.delete_season(dataclasses.replace(seed, shot_attempts=shots_), SEASON, confirm=True).shot_attempts.count() == 10


def test_heatmap_counts_every_attempt_and_small_samples_are_cut(seed):
    cells = shots.shot_heatmap(shots.subject_shots(seed)).where(f"subject_type = 'player' and subject_id = {LEBRON}")
    assert cells.agg(F.sum("attempts")).first()[0] == 200
    sample = shots.shot_sample(seed, max_points=7).where(f"subject_type = 'player' and subject_id = {LEBRON}").collect()
    assert len(sample) == 7 and all(r.truncated for r in sample)


