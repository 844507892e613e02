"""Physical-plan assertions: the shapes that keep the jobs scalable."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from statlake.operators import rules
from statlake.operators.shot_filters import ShotFilters
from statlake.plans import browse, season, shots
from statlake.sources.tables import read_tables, write_tables
from statlake.sources.testviews import derive
from tests.conftest import CELTICS, LEBRON, SEASON


@pytest.fixture(scope="module")
def published(spark, seed):
    root = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "v1")
    write_tables(seed, root)
    return read_tables(spark, root)


def plan(df) -> str:
    df.collect()  # runs this DataFrame's own query execution, so the adaptive plan is the final one
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]  # the final section only


def scans_of(text: str, table: str) -> int:
    return sum(1 for line in text.splitlines() if "FileScan" in line and f"/{table}" in line)


def test_shot_queries_scan_shots_once(published):
    assert scans_of(plan(shots.shot_profile(published)), "shot_attempts") == 1


def test_league_baseline_is_not_a_season_wide_window(published):
    """The league is a separate (season, zone) aggregate joined back; windows in the
    shot queries are partitioned by subject only."""
    for fn in (shots.shot_summary, shots.shot_zones):
        windows = [line for line in plan(fn(published)).splitlines() if "Window [" in line]
        assert all("subject_id" in line for line in windows), (fn.__name__, windows)
    assert any("Window [" in line for line in plan(shots.shot_zones(published)).splitlines())  # the share window


def test_sample_uses_partial_group_limit(published):
    text = plan(shots.shot_sample(published))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sample_is_cut_by_one_exchange(published):
    """One exchange by subject, whose order serves the rank and the sign that a sample is cut."""
    text = plan(shots.shot_sample(published))
    assert sum("Exchange hashpartitioning(subject_id" in line for line in text.splitlines()) == 1
    assert sum("Exchange hashpartitioning(" in line and "subject_type" in line for line in text.splitlines()) == 1


def test_profile_splits_share_one_exchange_of_shots(published):
    """a shot is dealt by player and season once; no hash map holds it five times, no exchange the split rows."""
    lines = plan(shots.shot_profile(published)).splitlines()
    dealt = [line for line in lines if "Exchange hashpartitioning(player_id" in line and "season" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1 and len(dealt) == 1 + len(shots.SPLITS)
    assert not any("HashAggregate" in line and "key#" in line and "d#" not in line for line in lines)


def test_profile_of_one_subject_is_its_part_of_the_whole(published):
    whole = shots.shot_profile(published).collect()
    for kind, f in (("player", ShotFilters(player_id=LEBRON)), ("team", ShotFilters(team_id=CELTICS))):
        subject = f.player_id or f.team_id
        part = [r for r in whole if (r.subject_type, r.subject_id) == (kind, subject)]
        assert {r.dimension for r in part} == set(shots.SPLITS)
        assert sorted(shots.shot_profile(published, f).collect()) == sorted(part)


def test_season_rule_sorts_no_facts(published):
    """the games of a partition are held in a map; the facts, several times as many, are not sorted."""
    found = rules.v11_single_season(published)
    text = plan(found)
    assert text.count("ShuffledHashJoin [game_id") == 3 and "SortMergeJoin" not in text and " Sort [" not in text


def test_player_rows_of_the_adapter_need_no_hash_map(spark, tmp_path):
    """also where only their keys are read; a line item whose flag is null counts as any other."""
    for name, rows, schema in (
            ("nation", [(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
            ("part", [(1, "p", 3)], "p_partkey long, p_name string, p_size int"),
            ("customer", [(1, 0)], "c_custkey long, c_nationkey long"),
            ("orders", [(1, 1, dt.datetime(1995, 11, 2)), (2, 1, dt.datetime(1996, 3, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
            ("lineitem", [(1, 1, 1, 1, 5.0, 1.0, 0.0, 0.0, None, "F", None), (1, 1, 2, 2, 5.0, 1.0, 0.0, 0.0, "R", "O", None),
                          (2, 1, 1, 1, 5.0, 1.0, 0.0, 0.0, None, "F", None)],
             "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    keys = derive(spark, str(tmp_path)).player_game_stats.select("game_id", "season")
    assert "HashAggregate" not in plan(keys)
    assert sorted(keys.collect()) == [("0020000001", "1995-96"), ("0020000002", "1995-96")]


def test_global_page_is_bounded_top_k(published):
    text = plan(browse.players(published, limit=2))
    assert "TakeOrderedAndProject" in text


def test_season_filter_prunes_partitions_and_columns(published):
    f = ShotFilters(season=SEASON, player_id=LEBRON)
    df = shots.shot_summary(published, f)
    text = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in text.splitlines() if "FileScan" in line and "/shot_attempts" in line][0]
    assert "PartitionFilters: [isnotnull(season" in scan and SEASON in scan
    assert "loc_x" not in scan  # only the columns the summary needs are read
    assert "PushedFilters" in scan and "player_id" in scan


def test_no_nested_loop_or_cartesian_joins(published):
    for df in (season.standings(published), season.team_season_summary(published), browse.games_page(published),
               shots.shot_zones(published), season.head_to_head(published)):
        text = plan(df)
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
