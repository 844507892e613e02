"""One-pass rules against the single rules, positions, ordered exports, digests, and the plans of all these."""

from __future__ import annotations

import hashlib
import os
import tempfile
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.operators import rules
from statlake.operators.onepass import KINDS
from statlake.operators.positions import page_at, with_positions
from statlake.plans import browse, publish, quality, shots
from statlake.plans.league import with_league
from statlake.sources import files
from statlake.sources.seeded import seed_faults, seed_text_faults
from statlake.sources.tables import join_by_bucket, read_bucketed, read_tables, save_bucketed, write_tables
from tests.conftest import LEBRON, SEASON


def spread(t):
    """The seed with game numbers at the residues of many faults, so that seeding changes most of its games."""
    out = {}
    for name in ("games", "team_game_stats", "player_game_stats", "shot_attempts"):
        df, c = getattr(t, name), "id" if name == "games" else "game_id"
        n = F.substring(c, 4, 7).cast("int") % 100
        copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(5))))
        out[name] = copies.withColumn(c, F.concat(F.lit("002"), F.lpad((n + 10 * F.col("_k") + 101 * 400).cast("string"), 7, "0"))).drop("_k")
    return type(t)(seasons=t.seasons, teams=t.teams, players=t.players, **out)


@pytest.fixture(scope="module")
def faulty(seed):
    return seed_faults(spread(seed))


def tally(df, *cols):
    return sorted((tuple(r) for r in df.groupBy(*cols).count().collect()), key=repr)


@pytest.mark.parametrize("season", [None, SEASON])
def test_contract_report_has_the_rows_of_the_single_rules(spark, faulty, season):
    root = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "raw")
    raw = {}
    for name, df in seed_text_faults(rules.as_text(faulty)).items():  # written once: the single rules read it many times
        df.write.parquet(f"{root}/{name}")
        raw[name] = spark.read.parquet(f"{root}/{name}")
    typed = rules.typed(raw)
    parts = [r.fn(raw).withColumn("rule_id", F.lit(r.rule_id)) for r in rules.TEXT_RULES]
    parts += [(r.fn(typed, season) if r.rule_id == "V11" else r.fn(typed)).withColumn("rule_id", F.lit(r.rule_id)) for r in rules.TYPED_RULES]
    single = reduce(DataFrame.unionByName, parts)
    got = tally(rules.contract_report(raw, season), "rule_id", "season", "key", "detail")
    assert got == tally(single, "rule_id", "season", "key", "detail")
    assert len({r[0] for r in got}) >= 14, {r[0] for r in got}


def test_quality_report_has_the_rows_of_the_single_checks(faulty):
    single = reduce(DataFrame.unionByName, [fn(faulty).withColumn("check_id", F.lit(cid)) for cid, fn in quality.CHECKS.items()])
    cols = ["check_id", *quality.OUT]
    assert sorted(map(tuple, quality.quality_report(faulty).select(*cols).collect()), key=repr) == sorted(
        map(tuple, single.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def published(spark, seed):
    root = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "v1")
    write_tables(seed, root)
    return read_tables(spark, root)


def first_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> dict[str, int]:
    lines = [line for line in first_plan(df).splitlines() if "FileScan" in line]
    return {n: sum(f"/{n}]" in line or f"/{n}," in line for line in lines) for n in KINDS}


def test_rule_sets_scan_every_fact_once(published):
    once = dict.fromkeys(KINDS, 1)
    assert scans(rules.contract_report(rules.as_text(published))) == once
    assert scans(rules.constraint_counts(published)) == once
    assert scans(quality.quality_report(published)) == once | {"games": 2, "player_game_stats": 2}


def test_windows_of_a_game_share_two_sorts(published):
    """a sort by natural key and one for all other windows."""
    for df in (rules.contract_report(rules.as_text(published)), rules.constraint_counts(published), quality.quality_report(published)):
        sorts = [line for line in first_plan(df).splitlines() if "Sort [game_" in line and "game_key" in line]
        assert len(sorts) == 2, sorts


def test_shot_queries_scan_the_shots_once(published):
    stored = with_league(published)
    for df in (shots.shot_summary(stored), shots.shot_zones(stored), shots.shot_sample(stored)):
        assert scans(df)["shot_attempts"] == 1
    assert scans(shots.league_shot_context(stored))["shot_attempts"] == 0
    assert scans(shots.player_team_comparison(published))["shot_attempts"] == 0  # counted once, ahead


def test_bucketed_tables_meet_by_game_without_an_exchange(spark, seed):
    root = tempfile.mkdtemp(prefix="statlake-test-")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        save_bucketed(seed, "bucketed", 4, root)
        t = read_bucketed(spark, "bucketed")
        join_by_bucket(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for fn in (rules.v15_to_v17_team_rows, rules.v18_participants, rules.v19_player_rows_both_teams, rules.v20_one_team_per_player_game,
                   rules.v21_shot_totals, quality.d20_scores_match_team_stats, quality.d21_two_teams_per_game, quality.d24_shots_reconcile,
                   publish.integrity_violations):
            plan = first_plan(fn(t))
            moved = [line for line in plan.splitlines() if "Exchange" in line and "game_id" in line]
            assert "Bucketed: true" in plan and not moved, (fn.__name__, moved)
            assert sorted(map(tuple, fn(t).collect()), key=repr) == sorted(map(tuple, fn(seed).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for name in ("seasons", "teams", "players", *KINDS):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_positions_are_those_of_a_whole_sort(spark):
    rows = [(i, (i * 7919) % 1000 if i % 50 else None, f"n{i % 13}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, value int, name string").repartition(7)
    order = [F.col("value").desc_nulls_last(), F.col("name"), F.col("id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))]
    got = with_positions(df, order).orderBy("position").collect()
    assert [r.id for r in got] == want and [r.position for r in got] == list(range(1, 3001)) and {r.total for r in got} == {3000}
    deep = page_at(df, order, 10, 2500).orderBy("position").collect()
    assert [r.id for r in deep] == want[2500:2510]
    assert page_at(df, order, 10, 3000).count() == 0 and with_positions(df.limit(0), order).count() == 0


def test_pages_by_continuation(seed):
    every = [(r.full_name, r.id) for r in seed.players.orderBy("full_name", "id").collect()]
    page, seen = browse.players(seed, limit=1).collect(), []
    while page:
        seen += [(r.full_name, r.id) for r in page]
        page = browse.players_after(seed, *seen[-1], limit=1).collect()
    assert seen == every
    assert [r.full_name for r in browse.players_page_at(seed, 2, 1).orderBy("position").collect()] == [n for n, _ in every[1:3]]


def test_export_is_in_order_across_parts(spark, seed):
    out = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "export")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = shots.export_shots(seed, shots.ShotFilters(season=SEASON), out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    lines = []
    for p in parts:
        with open(os.path.join(out, p["file"])) as f:
            header, *own = f.read().splitlines()
        assert header.split(",") == shots.EXPORT_COLUMNS and len(own) == p["rows"] and len(lines) == p["offset"]
        lines += own
    keys = [(c[0], c[1], int(c[2])) for c in (line.split(",") for line in lines)]
    assert len(parts) > 1 and len(keys) == seed.shot_attempts.count() and keys == sorted(keys)
    with pytest.raises(OverflowError):
        shots.export_shots(seed, shots.ShotFilters(season=SEASON, player_id=LEBRON), out + "2", max_rows=10)


def test_digests_are_streamed_in_bounded_pieces(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="statlake-test-")
    want = {}
    for i, size in enumerate((77, 1, 5_000_000, 3 << 20)):
        data = bytes(range(251)) * (size // 251 + 1)
        with open(f"{root}/f{i}.bin", "wb") as f:
            f.write(data[:size])
        want[f"f{i}.bin"] = (size, hashlib.sha256(data[:size]).hexdigest())
    found = files.file_digests(spark, [root])
    assert {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in found.collect()} == want
    assert "content" not in first_plan(found)  # no task holds a file
    monkeypatch.setattr(files, "STREAMED", ())
    assert {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.file_digests(spark, [root]).collect()} == want
    whole = hashlib.sha256("".join(want[f"f{i}.bin"][1] for i in range(4)).encode()).hexdigest()
    one = f"{root}/f2.bin"
    assert {r["name"]: r.sha256 for r in files.table_digests(spark, {"one": one, "two": f"{root}/f1.bin"}).collect()} == {
        "one": want["f2.bin"][1], "two": want["f1.bin"][1]}
    assert files.table_digest(spark, root) == whole
