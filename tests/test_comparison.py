"""Q37: zones aligned without shuffling the result rows."""

from __future__ import annotations

import copy
from dataclasses import replace

from pyspark.sql import functions as F

from statlake.plans import shots
from tests.conftest import CELTICS, LEBRON, frames, seed_rows


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_comparison_keeps_the_zones_of_one_side_and_null_zones(spark):
    rows = copy.deepcopy(seed_rows())
    rows["shot_attempts"][0].update(team_id=CELTICS)  # LeBron shoots once for the other team
    rows["shot_attempts"][1].update(zone_area="lost")
    t = frames(spark, rows)
    t = replace(t, shot_attempts=t.shot_attempts.withColumn("zone_area", F.when(F.col("zone_area") != "lost", F.col("zone_area"))))
    counts = spark.createDataFrame(shots.enriched_shots(t).groupBy("season", "player_id", "team_id", *shots.ZONE).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("shot_made").alias("makes"), F.sum(shots.points_value()).alias("points")).collect())
    zones = [shots._zone_stats(counts, c).select("season", F.lit(k).alias("subject_type"), "subject_id", *shots.ZONE, *shots.COMPARED)
             for k, c in (("player", "player_id"), ("team", "team_id"))]
    joined = shots.shot_compare(zones[0].unionByName(zones[1]), shots.player_team_pairs(t))
    got = shots.player_team_comparison(t)
    assert got.columns == joined.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))
    alone = got.where((F.col("a_id") == LEBRON) & F.col("zone_area").isNull())
    assert alone.where("a_attempts IS NULL").count() == 1 and alone.where("b_attempts IS NULL").count() == 2


def test_comparison_shuffles_no_result_rows(seed):
    assert "FullOuter" not in _optimized(shots.player_team_comparison(seed))


def test_comparison_makes_its_rows_in_generated_code(spark, seed):
    """zones are looked up by key in compiled code, not by nested scans of both lists that Spark interprets."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = shots.player_team_comparison(seed)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    made = [line for line in lines if "Generate " in line]
    assert made and all("*(" in line for line in made), made
