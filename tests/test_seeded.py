"""The seeded faults reach every rule, and the clean tables break only the rules known to fire there."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from statlake.operators import rules
from statlake.plans import quality, season
from statlake.plans.catalog import all_queries
from statlake.sources.seeded import core_roster, seed_faults
from statlake.sources.testviews import derive

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def tables(spark):
    return derive(spark, SF)


def test_every_constraint_finds_a_seeded_fault(tables):
    counts = {r.rule_id: r.violations for r in rules.constraint_counts(seed_faults(tables)).collect()}
    assert set(counts) == {f"X{i}" for i in range(1, 40)}
    assert [k for k, v in counts.items() if v == 0] == []


def test_clean_tables_break_no_constraint(tables):
    assert [r.rule_id for r in rules.constraint_counts(tables).collect() if r.violations] == []


def test_every_quality_check_fails_on_seeded_faults(tables):
    report = quality.quality_report(seed_faults(tables))
    failed = {r.check_id for r in report.where(~F.col("passed")).select("check_id").distinct().collect()}
    assert set(quality.CHECKS) - failed == {"D8"}  # the players table cannot be empty here


def test_every_contract_rule_finds_a_seeded_fault(spark):
    found = {r.rule_id for r in all_queries()["V"](spark, SF).where("violations > 0").select("rule_id").distinct().collect()}
    assert found == {r.rule_id for r in [*rules.TEXT_RULES, *rules.TYPED_RULES]}
    for rid in ("V16", "V17"):
        assert not all_queries()[rid](spark, SF).isEmpty()


def test_copies_of_a_game_row_do_not_multiply_its_team_rows(tables):
    g, r = tables.games.limit(1).collect(), rules.v15_to_v17_team_rows
    twice = type(tables)(**(tables.as_dict() | {"games": tables.games.unionByName(
        tables.games.where(F.col("id") == g[0].id))}))
    assert r(twice).isEmpty()


def test_core_roster_has_leaders(tables):
    top = season.leaders(core_roster(tables))
    assert top.where("games_played < minimum_games").isEmpty()
    assert top.select("stat").distinct().count() == len(season.STAT_CATEGORIES)


def test_core_roster_adds_regulars_and_keeps_every_player_row(tables):
    before, after = tables.player_game_stats, core_roster(tables)
    rows, sides = before.count(), before.select("game_id", "team_id").distinct().count()
    assert after.player_game_stats.count() == rows + sides
    same = [c for c in before.columns if c != "player_id"]
    assert before.select(same).exceptAll(after.player_game_stats.select(same)).isEmpty()
    assert after.player_game_stats.join(after.players.withColumnRenamed("id", "player_id"), "player_id", "left_anti").isEmpty()
    games = after.player_game_stats.groupBy("player_id").count()
    assert games.count() == before.select("player_id").distinct().count() + before.select("team_id").distinct().count()
    assert after.players.count() == after.players.select("id").distinct().count()
    assert season.leaders(after).where("player_id > 25").isEmpty() and not season.leaders(after).isEmpty()
