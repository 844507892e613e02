"""Fixed schemas of the star schema (seasons, teams, players, games, box scores, shots)."""

from __future__ import annotations

from pyspark.sql import types as T

# Counting columns shared by team and player box scores, in table order.
COUNTING = (
    "points",
    "rebounds",
    "offensive_rebounds",
    "defensive_rebounds",
    "assists",
    "steals",
    "blocks",
    "turnovers",
    "personal_fouls",
)
SHOOTING = ("fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct", "plus_minus")

PCT = T.DecimalType(5, 3)
PLUS_MINUS = T.DecimalType(6, 1)
PLAYER_MINUTES = T.DecimalType(5, 1)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


def _box_columns() -> list[T.StructField]:
    cols = [_f(c, T.IntegerType(), False) for c in COUNTING]
    cols += [
        _f("fgm", T.IntegerType(), False),
        _f("fga", T.IntegerType(), False),
        _f("fg_pct", PCT),
        _f("fg3m", T.IntegerType(), False),
        _f("fg3a", T.IntegerType(), False),
        _f("fg3_pct", PCT),
        _f("ftm", T.IntegerType(), False),
        _f("fta", T.IntegerType(), False),
        _f("ft_pct", PCT),
        _f("plus_minus", PLUS_MINUS),
    ]
    return cols


SEASONS = T.StructType(
    [
        _f("id", T.StringType(), False),
        _f("start_year", T.IntegerType(), False),
        _f("end_year", T.IntegerType(), False),
        _f("games_count", T.IntegerType()),
        _f("players_count", T.IntegerType()),
        _f("loaded_at", T.TimestampNTZType()),
        _f("shot_attempts_count", T.LongType()),
        _f("manifest_generated_at", T.TimestampNTZType()),
        _f("verified_at", T.TimestampNTZType()),
        _f("verification_status", T.StringType(), False),
        _f("manifest_sha256", T.StringType()),
    ]
)

TEAMS = T.StructType(
    [
        _f("id", T.LongType(), False),
        _f("full_name", T.StringType(), False),
        _f("abbreviation", T.StringType(), False),
        _f("nickname", T.StringType()),
        _f("city", T.StringType()),
        _f("state", T.StringType()),
        _f("year_founded", T.IntegerType()),
    ]
)

PLAYERS = T.StructType(
    [
        _f("id", T.LongType(), False),
        _f("full_name", T.StringType(), False),
        _f("first_name", T.StringType()),
        _f("last_name", T.StringType()),
        _f("is_active", T.BooleanType()),
    ]
)

GAMES = T.StructType(
    [
        _f("id", T.StringType(), False),
        _f("game_date", T.DateType(), False),
        _f("season", T.StringType(), False),
        _f("home_team_id", T.LongType(), False),
        _f("away_team_id", T.LongType(), False),
        _f("home_score", T.IntegerType()),
        _f("away_score", T.IntegerType()),
    ]
)

TEAM_GAME_STATS = T.StructType(
    [
        _f("game_id", T.StringType(), False),
        _f("team_id", T.LongType(), False),
        _f("season", T.StringType(), False),
        _f("is_home", T.BooleanType(), False),
        _f("minutes", T.IntegerType()),
    ]
    + _box_columns()
)

PLAYER_GAME_STATS = T.StructType(
    [
        _f("game_id", T.StringType(), False),
        _f("player_id", T.LongType(), False),
        _f("team_id", T.LongType(), False),
        _f("season", T.StringType(), False),
        _f("minutes", PLAYER_MINUTES),
    ]
    + _box_columns()
)

SHOT_ATTEMPTS = T.StructType(
    [
        _f("game_id", T.StringType(), False),
        _f("event_id", T.IntegerType(), False),
        _f("player_id", T.LongType(), False),
        _f("team_id", T.LongType(), False),
        _f("season", T.StringType(), False),
        _f("period", T.IntegerType(), False),
        _f("minutes_remaining", T.IntegerType(), False),
        _f("seconds_remaining", T.IntegerType(), False),
        _f("action_type", T.StringType(), False),
        _f("shot_type", T.StringType(), False),
        _f("zone_basic", T.StringType(), False),
        _f("zone_area", T.StringType(), False),
        _f("zone_range", T.StringType(), False),
        _f("shot_distance", T.IntegerType(), False),
        _f("loc_x", T.IntegerType(), False),
        _f("loc_y", T.IntegerType(), False),
        _f("shot_made", T.BooleanType(), False),
    ]
)

TABLES = {
    "seasons": SEASONS,
    "teams": TEAMS,
    "players": PLAYERS,
    "games": GAMES,
    "team_game_stats": TEAM_GAME_STATS,
    "player_game_stats": PLAYER_GAME_STATS,
    "shot_attempts": SHOT_ATTEMPTS,
}

# Fact tables are partitioned by season on disk so one-season reads prune files.
PARTITIONED_BY_SEASON = ("games", "team_game_stats", "player_game_stats", "shot_attempts")
