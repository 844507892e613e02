"""What a query computes, deals out or holds once, told from its plan and from what it writes."""

from __future__ import annotations

import datetime as dt
import re
import time
from dataclasses import replace

from pyspark.sql import functions as F

from statlake.operators import crosscheck as cc
from statlake.operators import transforms as tf
from statlake.operators.shot_filters import ShotFilters
from statlake.operators.substring import SubstringIndex
from statlake.plans import browse, catalog, publish as pub, season, shots
from statlake.plans.league import with_league
from statlake.sources import testviews as tv
from statlake.sources.stored import stored
from statlake.sources.testviews import provider_feeds
from tests.conftest import CELTICS, LAKERS, SEASON, TATUM, frames, seed_rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _times(pattern: str, text: str) -> int:
    return len(re.findall(pattern, text))


def _leaves(df) -> int:
    return sum(bool(re.search(r"LogicalRDD|LocalRelation|Relation \[", line))
               for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_index_postings_are_dealt_before_and_after_the_cuts(spark, tmp_path):
    """a file that one task reads is indexed by several, and no posting is lost."""
    texts = spark.createDataFrame([(i, f"name {i % 7} {i}") for i in range(400)], "id bigint, text string").coalesce(1)
    index = SubstringIndex(spark, str(tmp_path / "index")).build(texts, "text")
    tasks = {r.f.split("part-")[1][:5] for r in index.postings().select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(tasks) > 1  # one task wrote them all before
    found = index.search_all(texts, "text", spark.createDataFrame([("ME 3",), ("",), (None,)], "term string"))
    assert sorted((r.term, r["count"]) for r in found.groupBy("term").count().collect()) == [("", 400), ("ME 3", 57)]


def test_box_scores_are_dealt_once(spark, tmp_path):
    """F15 and all that reads player rows: line items are dealt by game, and the games join there."""
    one = dt.datetime(1995, 12, 1)
    tables = {
        "nation": spark.createDataFrame([(0, "N", 0), (1, "M", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "part": spark.createDataFrame([(1, "bolt", 3)], "p_partkey bigint, p_name string, p_size int"),
        "customer": spark.createDataFrame([(1, 0)], "c_custkey bigint, c_nationkey int"),
        "orders": spark.createDataFrame([(7, 1, one)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame(
            [(7, 1, 2, n, 3.0, 1.0, 0.0, 0.0, flag, status, one) for n, flag, status in ((1, "R", "O"), (2, "A", "F"), (3, None, None))],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
            " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    box = tv.derive(spark, str(tmp_path)).player_game_stats
    assert _times(r"Exchange hashpartitioning\(l_orderkey[^,]*, l_partkey", _plan(box)) == 0
    row = box.collect()
    assert [(r.fga, r.fgm, r.fg3a) for r in row] == [(3, 1, 0)]
    assert row[0].minutes is not None  # least status is F


def test_player_totals_are_dealt_once_and_count_a_game_once(spark):
    """one exchange; a repeated game counts once, its rows are summed, and a row without a game counts none."""
    rows = seed_rows()
    mine = [r for r in rows["player_game_stats"] if r["player_id"] == TATUM]
    rows["player_game_stats"] += [dict(mine[0]), {**mine[1], "game_id": "lost"}, {**mine[1], "game_id": "lost"}]
    t = frames(spark, rows)
    t = replace(t, player_game_stats=t.player_game_stats.withColumn("game_id", F.nullif("game_id", F.lit("lost"))))
    totals = cc.local_player_totals(t)
    assert _times(r"Exchange hashpartitioning", _plan(totals)) == 1
    assert "count(distinct" not in _plan(totals)
    assert [(r.games_played, r.points) for r in totals.where(F.col("player_id") == TATUM).collect()] == [(5, 200)]


def test_crosscheck_reads_each_side_once_for_differences_and_missing_ids(spark):
    """the four kinds of findings come from one full join; a repeated id meets every row of the other side."""
    def totals(rows):
        return spark.createDataFrame(rows, "season string, id bigint, games_played bigint, rebounds bigint")

    local = totals([("s", 1, 5, 10), ("s", 2, 5, 10), ("s", 3, 5, None), (None, 4, 1, 1)])
    official = totals([("s", 1, 6, 11), ("s", 1, 5, 12), ("s", 3, 5, 9), ("s", 5, 1, 1), (None, 4, 1, 1)])
    found = cc._findings(local, official, ["games_played", "rebounds"])
    assert _leaves(found) == 2
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3], str(r[4]))
    got = [(r.season, r.id, r.stat, r.issue, r.difference) for r in found.collect()]
    assert sorted(got, key=key) == sorted([
        ("s", 1, "games_played", "difference", -1), ("s", 1, "games_played", "mismatch", -1), ("s", 1, "rebounds", "difference", -1),
        ("s", 1, "rebounds", "difference", -2), ("s", 1, "rebounds", "mismatch", -2), ("s", 2, None, "missing_official", None),
        ("s", 3, "rebounds", "difference", None), ("s", 3, "rebounds", "mismatch", None), ("s", 5, None, "missing_local", None),
        (None, 4, None, "missing_official", None), (None, 4, None, "missing_local", None)], key=key)
    differences, mismatches = cc.compare(local, official, ["games_played", "rebounds"])
    assert (differences.count(), mismatches.count()) == (4, 7)


def test_season_averages_sort_player_rows_once(seed):
    """nothing is added up before the rows are dealt by player and season."""
    plan = _plan(season.player_season_averages_view(seed))
    assert "REPARTITION_BY_COL" in plan
    assert _times(r"Sort \[player_id[^,]*, season", plan) == 1


def test_player_pages_read_the_rows_once(seed):
    """F19 (Q10) and F22 (Q27): position and total from one sort, without a second reading for the total."""
    for df, leaves in ((browse.player_game_log(seed, limit=2), 5), (browse.player_game_stats_page(seed, limit=2), 3)):
        assert _leaves(df) == leaves
        got = df.where(F.col("player_id") == TATUM).orderBy("position").collect()
        assert [(r.position, r.total) for r in got] == [(1, 5), (2, 5)]


def test_pages_leave_out_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    got = browse.page_of_few(df, ["k"], [F.col("v")], 1, 1)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in browse.page(df, ["k"], [F.col("v")], 1, 1).collect()] == [("a", 2, 2, 2)]


def test_import_counts_the_baseline_from_what_it_wrote(spark, seed, tmp_path, monkeypatch):
    """the shots are made once, for their own parts."""
    seen = []
    monkeypatch.setattr(pub, "league_counts", lambda t, _of=pub.league_counts: (seen.append(t), _of(t))[1])
    store = pub.DatasetStore(spark, str(tmp_path / "store"))
    store.import_tables(seed)
    assert all(str(tmp_path) in f for f in seen[0].shot_attempts.inputFiles())
    assert store.read().league.agg(F.sum("attempts")).first()[0] == 295


def test_a_stage_of_many_columns_has_no_method_too_long_to_compile(spark, seed):
    """the session keeps generated methods within what the JVM compiles."""
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    rows = tf.transform_player_game_stats(provider_feeds(seed)["player_log"], F.col("season"))
    assert rows.count() == seed.player_game_stats.count()


def _same(a, b) -> bool:
    return a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_baseline_of_one_query_has_the_columns_it_names(seed):
    """the baseline is not counted by game where no filter names one; what is answered from it is the same."""
    of = lambda f: with_league(seed, f).league.columns
    assert of(ShotFilters()) == ["season", *shots.ZONE, "attempts", "makes"]
    full = with_league(seed)
    for f in (ShotFilters(), ShotFilters(opponent_id=CELTICS, period=2, shot_type="3PT Field Goal"), ShotFilters(made=True),
              ShotFilters(season=SEASON, team_id=LAKERS, home_away="home", date_from="2024-11-02", date_to="2024-11-07"),
              ShotFilters(game_id="0022400001", action_type="Jump Shot")):
        t = with_league(seed, f)
        assert _same(shots.shot_zones(t, f), shots.shot_zones(full, f)) and _same(shots.shot_summary(t, f), shots.shot_summary(full, f))
        assert _same(shots.league_shot_context(t, f), shots.league_shot_context(full, f))


def test_sample_of_stored_shots_deals_out_few_rows_of_a_team(spark):
    """of a team's rows only those up to the key that ends its sample are shuffled; the sample is the same."""
    rows = seed_rows()
    rows["shot_attempts"].append({**rows["shot_attempts"][0], "event_id": 999})
    t = frames(spark, rows)
    t = replace(t, shot_attempts=t.shot_attempts.withColumn("event_id", F.nullif("event_id", F.lit(999))))
    ahead = stored(shots.sampled_shots(t), "shots")
    for k in (1, 7, 2500):
        assert _same(shots.shot_sample(t, max_points=k, shots=ahead), shots.shot_sample(t, max_points=k))
    mine = ShotFilters(team_id=LAKERS)
    assert _same(shots.shot_sample(t, mine, 7, stored(shots.sampled_shots(t, mine), "shots")), shots.shot_sample(t, mine, 7))
    keyed = ahead.withColumn("sample_key", F.unhex(F.md5(F.concat_ws(":", "game_id", "event_id"))))
    teams = shots._first_by_key(keyed, ["season", "team_id"], 8)
    least = [r.n for r in teams.groupBy("team_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert ahead.count() == 296 and all(8 <= n < 30 for n in least)


def test_ordered_export_stores_its_rows_before_they_are_dealt_out(seed, monkeypatch):
    """the exchanges behind the rows are gone when the sort begins."""
    seen = []
    monkeypatch.setattr(shots, "stored", lambda df, label: (seen.append(label), stored(df, label))[1])
    got = shots.export_positions(seed).orderBy("position").collect()
    assert seen == ["export-rows"]
    assert [(r.game_date, r.game_id, r.event_id) for r in got] == sorted((r.game_date, r.game_id, r.event_id) for r in got)
    assert [r.position for r in got] == list(range(1, 296))


def test_stored_tables_leave_no_shuffle_files(spark, seed, tmp_path):
    """a store's writes remove their shuffle files when they end."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    store = pub.DatasetStore(spark, str(tmp_path / "store"))
    store._import_seasons(seed.shot_attempts, "shot_attempts", "v1")
    store._write(seed.shot_attempts, "shot_attempts", SEASON, "v2")
    stored(seed.shot_attempts.repartition(3, "game_id"), "dealt")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before


def test_rule_sets_and_the_store_make_each_fact_once(spark, tmp_path, monkeypatch):
    """team rows and seasons are derived from the stored facts, not from the line items again."""
    at = dt.datetime(1995, 12, 1)
    tables = {
        "nation": spark.createDataFrame([(0, "N", 0), (1, "M", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "part": spark.createDataFrame([(1, "bolt", 3), (2, "nut", 4)], "p_partkey bigint, p_name string, p_size int"),
        "customer": spark.createDataFrame([(1, 0)], "c_custkey bigint, c_nationkey int"),
        "orders": spark.createDataFrame([(7, 1, at), (8, 1, at)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame(
            [(k, p, 2 + p, n, 3.0, 1.0, 0.0, 0.0, "A", "F", at) for k in (7, 8) for p in (1, 2) for n in (1, 4)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
            " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    plain, kept = tv.derive(spark, str(tmp_path)).as_dict(), tv.derive(spark, str(tmp_path), stored).as_dict()
    assert all(_same(kept[n], plain[n]) for n in plain) and kept["shot_attempts"].count() == 8
    for n in ("seasons", "team_game_stats", "player_game_stats", "shot_attempts", "games"):
        assert not any("lineitem" in f or "orders" in f for f in kept[n].inputFiles())
    seen = []
    monkeypatch.setattr(catalog, "stored", lambda df, label: (seen.append(label), stored(df, label))[1])
    for name in ("V", "V_clean", "D27", "D27_clean"):
        catalog.all_queries()[name](spark, str(tmp_path))
    assert seen == ["games", "player-rows", "shots"] * 4
