"""Reusable relational building blocks: home/away legs, latest team, recency.

* ``team_legs`` turns each game into two team-perspective rows with one
  ``explode`` over a two-element array (J4/U1/J12). This replaces the
  ``t.id = home OR t.id = away`` join, which Spark can only plan as a
  nested-loop join, by an equi-join on ``team_id``.
* The latest team of a player-season (DISTINCT ON ... ORDER BY date DESC NULLS
  LAST, id DESC, W4) is a ``max_by(team, (date, id))`` inside the averages
  aggregate (``plans.season``): partial aggregation, no sort of the group.
* ``with_recency`` numbers each team's games newest first (W1), partitioned by
  (season, team) so no window sees more than one team-season.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def team_legs(games: DataFrame) -> DataFrame:
    """(game_id, game_date, season, team_id, opponent_id, is_home, team_score, opponent_score)."""
    home = F.struct(
        F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_id"),
        F.lit(True).alias("is_home"), F.col("home_score").alias("team_score"),
        F.col("away_score").alias("opponent_score"),
    )
    away = F.struct(
        F.col("away_team_id").alias("team_id"), F.col("home_team_id").alias("opponent_id"),
        F.lit(False).alias("is_home"), F.col("away_score").alias("team_score"),
        F.col("home_score").alias("opponent_score"),
    )
    return games.select(
        F.col("id").alias("game_id"), "game_date", "season", F.inline(F.array(home, away))
    )


def with_recency(legs: DataFrame, name: str = "recency") -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY season, team ORDER BY game_date DESC NULLS LAST, game_id DESC)."""
    w = Window.partitionBy("season", "team_id").orderBy(F.col("game_date").desc_nulls_last(), F.col("game_id").desc())
    return legs.withColumn(name, F.row_number().over(w))


def opponent_of(team_col: str = "team_id") -> F.Column:
    """CASE WHEN home_team_id = team THEN away_team_id ELSE home_team_id END."""
    return F.when(F.col("home_team_id") == F.col(team_col), F.col("away_team_id")).otherwise(F.col("home_team_id"))
