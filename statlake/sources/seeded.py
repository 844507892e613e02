"""Test data with seeded faults, so that every validation rule has rows to find.

``seed_faults`` changes the clean star schema at fixed residues of the game number
(modulo ``STRIDE``), one fault per residue, and the seasons by start year.
``seed_text_faults`` spoils single cells of the text form. ``core_roster`` adds
one regular player to each team, so that the leaders' games threshold is met.
``testviews_sql`` writes the same changes as SQL; the two must stay in step.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlake.sources.tables import Tables

STRIDE = 101
WRONG_SEASON = "1900-01"
#: Teams (ids from 1), and what is added to the ids of players that the regulars take.
TEAMS, MOVED = 25, 20_000_000


def _residue(game_id: str) -> Column:
    return F.pmod(F.substring(game_id, 4, 7).cast("int"), F.lit(STRIDE))


def _set(df: DataFrame, where: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
                           for c, v in values.items()})


def _twice(df: DataFrame, where: Column) -> DataFrame:
    """Rows of ``where`` occur twice; ``_copy`` is 1 on the second."""
    return df.withColumn("_copy", F.explode(
        F.when(where, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def _games(games: DataFrame) -> DataFrame:
    r = F.col("_r")
    g = games.withColumn("_r", _residue("id"))
    g = _set(g, r == 1, home_score=-F.col("home_score"))
    g = _set(g, r == 2, home_score=None)
    g = _set(g, r == 3, away_score=-5)
    g = _set(g, r == 4, away_team_id=F.col("home_team_id"))
    g = _set(g, r == 5, game_date=None)
    g = _twice(g, r == 7)
    g = _set(g, r == 8, home_team_id=F.lit(999).cast("bigint"))
    g = _set(g, r == 9, id=F.concat(F.lit("003"), F.substring("id", 4, 7)))
    return g.select(*games.columns)


def _more_made_than_tried() -> dict[str, Column]:
    return {"fgm": F.col("fga") + 1, "fg3m": F.col("fg3a") + 1, "ftm": F.col("fta") + 1}


def _team_rows(rows: DataFrame) -> DataFrame:
    r, home = F.col("_r"), F.col("_home")
    t = rows.withColumns({"_r": _residue("game_id"), "_home": F.col("is_home")})
    t = t.where((r != 14) & ((r != 13) | home))
    t = _twice(t, (r == 15) & ~home)
    t = _set(t, (r == 11) & home, points=F.col("points") + 1)
    t = _set(t, r == 12, is_home=True)
    t = _set(t, (r == 16) & home, team_id=F.lit(998).cast("bigint"))
    t = _set(t, (r == 17) & home, points=-3, rebounds=-1, assists=-1)
    t = _set(t, (r == 18) & home, **_more_made_than_tried())
    t = _set(t, (r == 19) & home, season=WRONG_SEASON)
    return t.select(*rows.columns)


def _player_rows(rows: DataFrame) -> DataFrame:
    r = F.col("_r")
    p = rows.withColumn("_r", _residue("game_id")).where(r != 30)
    p = _twice(p, r == 23)
    p = _set(p, r == 21, points=-1, rebounds=-1, assists=-1)
    p = _set(p, r == 22, **_more_made_than_tried())
    p = _set(p, r == 24, season=WRONG_SEASON)
    p = _set(p, r == 25, player_id=F.col("player_id") + 5_000_000)
    p = _set(p, r == 26, team_id=F.lit(997).cast("bigint"))
    p = _set(p, r == 27, fga=F.col("fga") + 1, fg3a=F.col("fg3a") + 1)
    p = _set(p, r == 28, fga=F.col("fga") + 2)
    p = _set(p, r == 29, points=101, fg_pct=F.lit(1.5).cast("decimal(5,3)"))
    return p.select(*rows.columns)


def _shots(shots: DataFrame) -> DataFrame:
    r, copy = F.col("_r"), F.col("_copy") == 1
    s = shots.withColumn("_r", _residue("game_id")).where(r != 40)
    s = _twice(s, (r == 36) | (r == 39))
    s = _set(s, r == 31, period=21)
    s = _set(s, r == 32, loc_x=401, loc_y=-101)
    s = _set(s, r == 33, minutes_remaining=13, shot_distance=101)
    s = _set(s, r == 34, shot_type="4PT Field Goal")
    s = _set(s, r == 35, zone_area="  ")
    s = _set(s, (r == 36) & copy, season=WRONG_SEASON)
    s = _set(s, r == 37, player_id=F.col("player_id") + 5_000_000)
    s = _set(s, r == 38, team_id=F.lit(996).cast("bigint"))
    s = _set(s, (r == 39) & copy, event_id=F.col("event_id") + 100, team_id=F.lit(995).cast("bigint"))
    return s.select(*shots.columns)


def _seasons(seasons: DataFrame) -> DataFrame:
    y = F.col("_y")
    s = seasons.withColumn("_y", F.col("start_year")).where(y != 1999)
    s = _twice(s, y == 1997)  # the second becomes a season without rows
    s = _set(s, F.col("_copy") == 1, id="2030-31", start_year=2030, end_year=2031)
    s = _set(s, y == 2000, games_count=F.col("games_count") + 1, players_count=F.col("players_count") + 1)
    s = _set(s, y == 1994, verification_status="failed", manifest_sha256="xyz")
    s = _set(s, y == 1995, shot_attempts_count=F.col("shot_attempts_count") - 1, end_year=F.col("end_year") + 1)
    s = _set(s, y == 1996, games_count=-1, manifest_sha256=None)
    return s.select(*seasons.columns)


def seed_faults(t: Tables) -> Tables:
    teams = _set(t.teams, F.pmod("id", F.lit(12)) == 0, abbreviation="DUP")
    teams = _set(teams, F.col("id") == 5, year_founded=1900)
    idle = t.players.where("is_active").withColumn("id", F.col("id") + 10_000_000)
    return Tables(
        seasons=_seasons(t.seasons), teams=teams, players=t.players.unionByName(idle), games=_games(t.games),
        team_game_stats=_team_rows(t.team_game_stats), player_game_stats=_player_rows(t.player_game_stats),
        shot_attempts=_shots(t.shot_attempts))


def seed_seasons(t: Tables) -> Tables:
    """Faulty seasons over clean facts: some seasons still agree with their facts."""
    return replace(t, seasons=_seasons(t.seasons))


def seed_text_faults(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    r = _residue("game_id")
    p = raw["player_game_stats"]
    for at, cell in ((51, "n/a"), (52, "NaN"), (53, "1.5"), (54, "Infinity"), (55, None)):
        p = _set(p, r == at, steals=cell)
    return raw | {
        "teams": _set(raw["teams"], F.pmod(F.col("id").cast("bigint"), F.lit(7)) == 3, full_name=None),
        "players": _set(raw["players"], F.pmod(F.col("id").cast("bigint"), F.lit(50)) == 7, is_active="yes"),
        "player_game_stats": p,
    }


def core_roster(t: Tables) -> Tables:
    """Every player row, and one more per (game, team): the team's regular, with the statistics of the smallest player id.

    Regular's player id = team id; teams divisible by 5 lend theirs to the team before in odd games (a traded
    player). The players who have these ids otherwise are moved by ``MOVED``, rows and shots with them."""
    cols = t.player_game_stats.columns
    first = t.player_game_stats.groupBy("game_id", "team_id").agg(
        F.min_by(F.struct(*cols), F.col("player_id")).alias("row")).select("row.*")
    odd = F.pmod(F.substring("game_id", 4, 7).cast("int"), F.lit(2)) == 1
    lent = odd & (F.pmod("team_id", F.lit(5)) == 0)
    regulars = first.withColumn(
        "player_id", F.when(lent, F.col("team_id") - 1).otherwise(F.col("team_id"))).select(*cols)
    taken = F.col("player_id") <= TEAMS
    others = _set(t.player_game_stats, taken, player_id=F.col("player_id") + MOVED)
    moved = t.players.where(F.col("id") <= TEAMS).withColumn("id", F.col("id") + MOVED)
    return replace(t, players=t.players.unionByName(moved), player_game_stats=others.unionByName(regulars),
                   shot_attempts=_set(t.shot_attempts, taken, player_id=F.col("player_id") + MOVED))
