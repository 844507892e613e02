"""Browse and paging queries (Q1-Q4, Q7, Q8, Q10, Q23-Q27, Q36, Q38).

Pages are expressed for every subject at once: ``row_number()`` over the
subject's rows in the product's order (with a unique tiebreak added where the
product leaves ties open), kept between ``offset`` and ``offset + limit``,
together with the subject's ``total`` from a grouped count. A single-subject
page is the same plan with the subject predicate pushed into the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlake.functions.expr import contains_ci
from statlake.operators.legs import opponent_of, team_legs
from statlake.operators.positions import page_at, with_positions
from statlake.sources.tables import Tables


def _check_page(limit: int, offset: int, max_limit: int) -> None:
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def page(df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Per-``keys`` page: rows offset+1 .. offset+limit in ``order`` plus the group total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("position", F.row_number().over(w).cast("bigint")).where(
        (F.col("position") > offset) & (F.col("position") <= offset + limit))
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, keys)


def page_of_few(df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """As :func:`page` where a subject has few rows (a player's games of a season): position and total from one sort,
    so ``df`` is computed once. The total's window goes over all rows of a subject, so it is not for teams or seasons."""
    subject = Window.partitionBy(*keys)
    placed = (df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
              .withColumn("position", F.row_number().over(subject.orderBy(*order)).cast("bigint"))
              .withColumn("total", F.count(F.lit(1)).over(subject)))
    return placed.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select(
        *keys, *[c for c in placed.columns if c not in keys])


# --- seasons, status, readiness ------------------------------------------------
def seasons(t: Tables) -> DataFrame:
    """Q1: all seasons (the product orders by id desc)."""
    return t.seasons


def _live_counts(t: Tables) -> DataFrame:
    g = t.games.groupBy("season").agg(F.count(F.lit(1)).alias("live_games"))
    tg = t.team_game_stats.groupBy("season").agg(F.count(F.lit(1)).alias("live_team_game_stats"))
    pg = t.player_game_stats.groupBy("season").agg(
        F.count(F.lit(1)).alias("live_player_game_stats"), F.count_distinct("player_id").alias("live_players"))
    sh = t.shot_attempts.groupBy("season").agg(F.count(F.lit(1)).alias("live_shots"))
    base = t.seasons.select(F.col("id").alias("season"))
    out = base
    for df in (g, tg, pg, sh):
        out = out.join(df, "season", "left")
    return out.fillna(0, ["live_games", "live_team_game_stats", "live_player_game_stats", "live_players", "live_shots"])


def dataset_status(t: Tables) -> DataFrame:
    """Q2: provenance of each season plus live row counts of the three fact tables."""
    live = _live_counts(t)
    s = t.seasons.withColumnRenamed("id", "season")
    return s.join(live, "season").select(
        "season", "loaded_at", "manifest_generated_at", "verified_at", "verification_status",
        F.trim(F.col("manifest_sha256")).alias("manifest_sha256"),
        F.col("games_count").cast("bigint").alias("games"), F.col("players_count").cast("bigint").alias("players"),
        F.col("live_team_game_stats").alias("team_game_stats"),
        F.col("live_player_game_stats").alias("player_game_stats"),
        F.col("live_shots").alias("shot_attempts"),
    )


def readiness(t: Tables) -> DataFrame:
    """Q3: ready when verification passed and recorded counts equal live counts."""
    live = _live_counts(t)
    s = t.seasons.withColumnRenamed("id", "season")
    ready = (
        (F.col("verification_status") == "passed")
        & (F.col("games_count") == F.col("live_games"))
        & (F.col("players_count") == F.col("live_players"))
        & (F.col("shot_attempts_count") == F.col("live_shots"))
    )
    return s.join(live, "season").select(
        "season", F.when(ready, "ready").otherwise("not ready").alias("status"), "verification_status",
        "live_games", "live_players", "live_shots",
    )


# --- teams and players -----------------------------------------------------------
def teams(t: Tables) -> DataFrame:
    """Q4: all teams (ordered by name by the caller)."""
    return t.teams


def team(t: Tables, team_id: int) -> DataFrame:
    """Q4 point form: one team; empty when absent (callers raise LookupError)."""
    return t.teams.where(F.col("id") == team_id)


def players(t: Tables, search: str | None = None, active: bool | None = None,
            limit: int = 50, offset: int = 0) -> DataFrame:
    """Q7: search page (case-insensitive literal substring, F6) with total, by full_name then id."""
    _check_page(limit, offset, 500)
    df = t.players
    if search:
        df = df.where(contains_ci(F.col("full_name"), search))
    if active is not None:
        df = df.where(F.col("is_active") == F.lit(active))
    # one global page: a bounded top-(offset+limit) per partition then a merge
    # (TakeOrderedAndProject), not a window over one key; the total is a global count
    rows = df.orderBy(F.col("full_name"), F.col("id")).offset(offset).limit(limit)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("full_name", "id")).cast("bigint") + offset)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return rows.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _player_order() -> list[Column]:
    return [F.col("full_name"), F.col("id")]


def players_page_at(t: Tables, limit: int, offset: int) -> DataFrame:
    """Q7 at any depth: positions come from sorted parts and their counts, so no task holds ``offset + limit`` rows."""
    return page_at(t.players, _player_order(), limit, offset, "players-page")


def players_after(t: Tables, full_name: str, player_id: int, limit: int = 50) -> DataFrame:
    """Q7 by continuation: the ``limit`` players after the last one of a page (a bounded top-k, whatever the depth)."""
    _check_page(limit, 0, 500)
    after = (F.col("full_name") > full_name) | ((F.col("full_name") == full_name) & (F.col("id") > player_id))
    return t.players.where(after).orderBy(*_player_order()).limit(limit)


def in_order(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """A whole list in the product's order, with ``position``."""
    return with_positions(df, order, label).drop("total")


def player(t: Tables, player_id: int) -> DataFrame:
    """Q8: one player by id (F1)."""
    return t.players.where(F.col("id") == player_id)


def exists(df: DataFrame) -> bool:
    """F1 existence probe: reads at most one row."""
    return not df.limit(1).isEmpty()


# --- game logs ---------------------------------------------------------------------
def _player_game_rows(t: Tables) -> DataFrame:
    """Non-DNP player rows with opponent, venue, W/L (ties 'L') and scores (Q10)."""
    pgs = t.player_game_stats.where(F.col("minutes").isNotNull())
    g = t.games.select(F.col("id").alias("game_id"), "game_date", "home_team_id", "away_team_id", "home_score", "away_score")
    p = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    team_ = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("team_abbr"))
    opp = t.teams.select(F.col("id").alias("opponent_id"), F.col("full_name").alias("opponent_name"),
                         F.col("abbreviation").alias("opponent_abbr"))
    j = pgs.join(p, "player_id").join(g, "game_id").join(team_, "team_id")
    j = j.withColumn("opponent_id", opponent_of("team_id")).join(opp, "opponent_id")
    home = F.col("home_team_id") == F.col("team_id")
    win = (home & (F.col("home_score") > F.col("away_score"))) | (
        (F.col("away_team_id") == F.col("team_id")) & (F.col("away_score") > F.col("home_score")))
    return j.select(
        *t.player_game_stats.columns, "player_name", "team_abbr", "game_date", "opponent_id", "opponent_name",
        "opponent_abbr", home.alias("is_home"), F.when(win, "W").otherwise("L").alias("result"),
        F.when(home, F.col("home_score")).otherwise(F.col("away_score")).alias("team_score"),
        F.when(home, F.col("away_score")).otherwise(F.col("home_score")).alias("opponent_score"),
    )


def player_game_log(t: Tables, limit: int = 10, offset: int = 0) -> DataFrame:
    """Q10 for every (player, season): newest first, one page, with the total."""
    _check_page(limit, offset, 100)
    rows = _player_game_rows(t)
    return page_of_few(rows, ["player_id", "season"],
                       [F.col("game_date").desc_nulls_last(), F.col("game_id").desc()], limit, offset)


def scoring_trend(t: Tables, n: int = 10) -> DataFrame:
    """Q36 (W5): last ``n`` games per (player, season), oldest -> newest, points scaled to the max (>= 1)."""
    log = player_game_log(t, limit=n)
    w = Window.partitionBy("player_id", "season")
    return log.select(
        "player_id", "season", "game_id", "game_date", "points",
        (F.count(F.lit(1)).over(w) - F.col("position") + 1).alias("idx"),
        F.greatest(F.max("points").over(w), F.lit(1)).alias("max_points"),
    ).withColumn("scaled", F.col("points").cast("double") / F.col("max_points").cast("double"))


# --- games -------------------------------------------------------------------------
def game_details(t: Tables) -> DataFrame:
    """Q24 relation: games with home/away team names (J2); the lookup is a filter on id."""
    ht = t.teams.select(F.col("id").alias("home_team_id"), F.col("full_name").alias("home_team"))
    at = t.teams.select(F.col("id").alias("away_team_id"), F.col("full_name").alias("away_team"))
    return t.games.join(ht, "home_team_id").join(at, "away_team_id").select(*t.games.columns, "home_team", "away_team")


def games_page(t: Tables, sort: str = "desc", limit: int = 50, offset: int = 0) -> DataFrame:
    """Q23 for every (season, team): the team's games by date (and id), one page, with total.

    The product's ``home = t OR away = t`` filter is the two-leg explode, so
    every team's page comes from one equi-keyed window.
    """
    _check_page(limit, offset, 100)
    d = game_details(t)
    legs = team_legs(t.games).select("game_id", "team_id")
    j = legs.join(d.withColumnRenamed("id", "game_id"), "game_id")
    asc = sort == "asc"
    order = [F.col("game_date").asc() if asc else F.col("game_date").desc(),
             F.col("game_id").asc() if asc else F.col("game_id").desc()]
    return page(j, ["season", "team_id"], order, limit, offset)


def team_game_table(t: Tables, n: int = 10) -> DataFrame:
    """Q38: a team's recent games from its perspective (vs/@, opponent, W/L with ties as L, score)."""
    recent = games_page(t, "desc", n, 0)
    home = F.col("home_team_id") == F.col("team_id")
    team_score = F.when(home, F.col("home_score")).otherwise(F.col("away_score"))
    opp_score = F.when(home, F.col("away_score")).otherwise(F.col("home_score"))
    return recent.select(
        "season", "team_id", "position", "game_id", "game_date",
        F.when(home, "vs").otherwise("@").alias("venue"),
        F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("opponent"),
        F.when(team_score > opp_score, "W").otherwise("L").alias("result"),
        team_score.alias("team_score"), opp_score.alias("opponent_score"),
    )


def boxscore_players(t: Tables) -> DataFrame:
    """Q25 player rows for every game: side home/away, ordered within team by points desc."""
    p = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("team_abbr"))
    g = t.games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id")
    j = t.player_game_stats.join(p, "player_id").join(tm, "team_id").join(g, "game_id")
    side = (F.when(F.col("team_id") == F.col("home_team_id"), "home")
            .when(F.col("team_id") == F.col("away_team_id"), "away"))
    w = Window.partitionBy("game_id", "team_id").orderBy(F.col("points").desc(), F.col("player_id"))
    return j.select(*t.player_game_stats.columns, "player_name", "team_abbr", side.alias("side"),
                    F.row_number().over(w).cast("bigint").alias("position"))


def boxscore_teams(t: Tables) -> DataFrame:
    """Q25 team rows for every game with side and abbreviation."""
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("team_abbr"))
    g = t.games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id")
    j = t.team_game_stats.join(tm, "team_id").join(g, "game_id")
    side = (F.when(F.col("team_id") == F.col("home_team_id"), "home")
            .when(F.col("team_id") == F.col("away_team_id"), "away"))
    return j.select(*t.team_game_stats.columns, "team_abbr", side.alias("side"))


def team_game_stats_page(t: Tables, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q26 for every (season, team): box-score rows by game_id desc, one page, with total."""
    _check_page(limit, offset, 500)
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("team_abbr"))
    return page(t.team_game_stats.join(tm, "team_id"), ["season", "team_id"], [F.col("game_id").desc()], limit, offset)


def player_game_stats_page(t: Tables, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q27 for every (season, player): rows by game_id desc, points desc (player_id tiebreak); DNP rows included."""
    _check_page(limit, offset, 500)
    p = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("team_abbr"))
    rows = t.player_game_stats.join(p, "player_id").join(tm, "team_id")
    return page_of_few(rows, ["season", "player_id"], [F.col("game_id").desc(), F.col("points").desc(), F.col("team_id")],
                       limit, offset)
