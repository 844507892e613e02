"""ETL transforms (T1-T7): provider rows (header-named text columns) to the clean tables.

All transforms are projections with built-in expressions; the one grouping
(T3, two team rows per game -> one game row) is a conditional aggregate per
GAME_ID instead of per-game rescans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlake import schemas

# provider header -> clean column (fixed values of the provider's layout)
BOX_RENAMES = {
    "MIN": "minutes", "PTS": "points", "REB": "rebounds", "OREB": "offensive_rebounds", "DREB": "defensive_rebounds",
    "AST": "assists", "STL": "steals", "BLK": "blocks", "TOV": "turnovers", "PF": "personal_fouls",
    "FGM": "fgm", "FGA": "fga", "FG_PCT": "fg_pct", "FG3M": "fg3m", "FG3A": "fg3a", "FG3_PCT": "fg3_pct",
    "FTM": "ftm", "FTA": "fta", "FT_PCT": "ft_pct", "PLUS_MINUS": "plus_minus",
}
SHOT_RENAMES = {
    "GAME_ID": "game_id", "GAME_EVENT_ID": "event_id", "PLAYER_ID": "player_id", "TEAM_ID": "team_id",
    "PERIOD": "period", "MINUTES_REMAINING": "minutes_remaining", "SECONDS_REMAINING": "seconds_remaining",
    "ACTION_TYPE": "action_type", "SHOT_TYPE": "shot_type", "SHOT_ZONE_BASIC": "zone_basic",
    "SHOT_ZONE_AREA": "zone_area", "SHOT_ZONE_RANGE": "zone_range", "SHOT_DISTANCE": "shot_distance",
    "LOC_X": "loc_x", "LOC_Y": "loc_y", "SHOT_MADE_FLAG": "shot_made",
}
HOME_MARK = " vs. "
AWAY_MARK = " @ "


def _season(season: str | Column) -> Column:
    return F.lit(season) if isinstance(season, str) else season


def transform_teams(records: DataFrame) -> DataFrame:
    """Identity projection of the seven team fields."""
    return records.select(*schemas.TEAMS.fieldNames())


def transform_players(rows: DataFrame) -> DataFrame:
    """PERSON_ID/DISPLAY_FIRST_LAST/ROSTERSTATUS; 'Last, First' split on the first ', '.

    No comma -> both names null; 'X,Y' without the space -> first null, last = whole text.
    """
    lcf = F.col("DISPLAY_LAST_COMMA_FIRST")
    has_comma = F.coalesce(lcf.contains(","), F.lit(False))
    parts = F.split(lcf, ", ", 2)
    return rows.select(
        F.col("PERSON_ID").cast("bigint").alias("id"),
        F.col("DISPLAY_FIRST_LAST").alias("full_name"),
        F.when(has_comma & (F.size(parts) > 1), parts[1]).alias("first_name"),
        F.when(has_comma, parts[0]).alias("last_name"),
        F.coalesce(F.col("ROSTERSTATUS").cast("double") == 1, F.lit(False)).alias("is_active"),
    )


def transform_games(log: DataFrame, season: str | Column) -> DataFrame:
    """Two team rows per game -> one game row.

    The MATCHUP of any row names the home team ('A vs. B': A home; 'A @ B': B
    home); one grouped pass per GAME_ID picks the home/away rows by
    abbreviation and the date of the game's first row (lowest ``row_number``).
    A game whose two sides are not both present yields no row.
    """
    m = F.col("MATCHUP")
    home_abbr = F.when(m.contains(HOME_MARK), F.col("TEAM_ABBREVIATION")).otherwise(F.split_part(m, F.lit(AWAY_MARK), F.lit(2)))
    away_abbr = F.when(m.contains(HOME_MARK), F.split_part(m, F.lit(HOME_MARK), F.lit(2))).otherwise(F.col("TEAM_ABBREVIATION"))
    with_sides = log.withColumn("_season", _season(season)).withColumn("_order", F.struct("source_file", "row_number"))
    first = with_sides.groupBy("GAME_ID").agg(
        F.min_by(F.struct(home_abbr.alias("h"), away_abbr.alias("a"), F.col("GAME_DATE").alias("d")), F.col("_order")).alias("f"),
        F.min("_season").alias("season"),
    )
    j = with_sides.select("GAME_ID", "TEAM_ABBREVIATION", "TEAM_ID", "PTS").join(first, "GAME_ID")
    games = j.groupBy("GAME_ID").agg(
        F.first("f").alias("f"), F.first("season").alias("season"),
        F.max(F.when(F.col("TEAM_ABBREVIATION") == F.col("f.h"), F.col("TEAM_ID"))).alias("home_team_id"),
        F.max(F.when(F.col("TEAM_ABBREVIATION") == F.col("f.a"), F.col("TEAM_ID"))).alias("away_team_id"),
        F.max(F.when(F.col("TEAM_ABBREVIATION") == F.col("f.h"), F.col("PTS"))).alias("home_score"),
        F.max(F.when(F.col("TEAM_ABBREVIATION") == F.col("f.a"), F.col("PTS"))).alias("away_score"),
    )
    return games.where(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()).select(
        F.col("GAME_ID").alias("id"), F.to_date(F.col("f.d")).alias("game_date"), "season",
        F.col("home_team_id").cast("bigint").alias("home_team_id"), F.col("away_team_id").cast("bigint").alias("away_team_id"),
        F.col("home_score").cast("double").cast("int").alias("home_score"),
        F.col("away_score").cast("double").cast("int").alias("away_score"),
    )


def transform_team_game_stats(log: DataFrame, season: str | Column) -> DataFrame:
    """T4: is_home = MATCHUP contains ' vs. ' (literal), 20 renames, season added."""
    df = log.select(
        F.col("GAME_ID").alias("game_id"), F.col("TEAM_ID").alias("team_id"), _season(season).alias("season"),
        F.col("MATCHUP").contains(HOME_MARK).alias("is_home"),
        *[F.col(k).alias(v) for k, v in BOX_RENAMES.items()],
    )
    return _numeric(df, schemas.TEAM_GAME_STATS)


def transform_player_game_stats(log: DataFrame, season: str | Column) -> DataFrame:
    """T5: player box-score rows, 21 renames plus PLAYER_ID, season added."""
    df = log.select(
        F.col("GAME_ID").alias("game_id"), F.col("PLAYER_ID").alias("player_id"), F.col("TEAM_ID").alias("team_id"),
        _season(season).alias("season"), *[F.col(k).alias(v) for k, v in BOX_RENAMES.items()],
    )
    return _numeric(df, schemas.PLAYER_GAME_STATS)


def transform_shot_attempts(rows: DataFrame, season: str | Column) -> DataFrame:
    """16 renames, season added, shot_made = (SHOT_MADE_FLAG == 1)."""
    df = rows.select(*[F.col(k).alias(v) for k, v in SHOT_RENAMES.items() if k != "SHOT_MADE_FLAG"],
                     _season(season).alias("season"),
                     (F.col("SHOT_MADE_FLAG").cast("double") == 1).alias("shot_made"))
    return _numeric(df, schemas.SHOT_ATTEMPTS)


def _numeric(df: DataFrame, schema) -> DataFrame:
    """Text cells to the schema's types; integers via double so '12.0' parses."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (schemas.T.IntegerType, schemas.T.LongType)):
            c = c.cast("double").cast(f.dataType)
        elif not isinstance(f.dataType, (schemas.T.StringType, schemas.T.BooleanType)):
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def season_build(teams_records: DataFrame, players_rows: DataFrame, team_log: DataFrame, player_log: DataFrame,
                 shot_rows: DataFrame, season: str) -> dict[str, DataFrame]:
    """All six clean tables of one season from its raw inputs."""
    return {
        "teams": transform_teams(teams_records),
        "players": transform_players(players_rows),
        "games": transform_games(team_log, season),
        "team_game_stats": transform_team_game_stats(team_log, season),
        "player_game_stats": transform_player_game_stats(player_log, season),
        "shot_attempts": transform_shot_attempts(shot_rows, season),
    }
