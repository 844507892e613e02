"""Shot filters (F3/F4/F5/F13) and the enriched five-table shot relation.

``ShotFilters`` yields two predicates, as the product does: the *context*
(season, game, opponent, period, shot type, action type, dates, venue) that
also defines the league baseline, and the *subject* predicate (context plus
player/team, plus ``made``). Both are plain Columns, so Catalyst pushes the
shot-table parts into the Parquet scan and the game-date parts into the games
scan before the joins.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlake.functions.expr import SHOT_TYPES, all_of
from statlake.operators.legs import opponent_of
from statlake.sources.tables import Tables


@dataclass(frozen=True)
class ShotFilters:
    season: str | None = None
    player_id: int | None = None
    team_id: int | None = None
    game_id: str | None = None
    opponent_id: int | None = None
    period: int | None = None
    made: bool | None = None
    shot_type: str | None = None
    action_type: str | None = None
    home_away: str | None = None
    date_from: dt.date | str | None = None
    date_to: dt.date | str | None = None

    def __post_init__(self) -> None:
        if self.player_id is not None and self.team_id is not None:
            raise ValueError("Provide exactly one player_id or team_id")
        if self.period is not None and not 1 <= self.period <= 20:
            raise ValueError("period must be between 1 and 20")
        if self.shot_type is not None and self.shot_type not in SHOT_TYPES:
            raise ValueError(f"shot_type must be one of {SHOT_TYPES}")
        if self.home_away is not None and self.home_away not in ("home", "away"):
            raise ValueError("home_away must be 'home' or 'away'")
        if self.action_type is not None and len(self.action_type) > 100:
            raise ValueError("action_type is limited to 100 characters")
        if self.date_from and self.date_to and _as_date(self.date_from) > _as_date(self.date_to):
            raise ValueError("date_from must not be after date_to")

    @property
    def has_subject(self) -> bool:
        return self.player_id is not None or self.team_id is not None

    def require_subject(self) -> None:
        """point queries need exactly one of player/team."""
        if not self.has_subject:
            raise ValueError("Provide exactly one player_id or team_id")

    def context(self, stored: bool = False) -> Column:
        """The predicates that the league keeps, over enriched shots or (``stored``) over the league baseline."""
        preds: list[Column] = []
        for value, col in (
            (self.season, "season"),
            (self.game_id, "game_id"),
            (self.opponent_id, "opponent_id"),
            (self.period, "period"),
            (self.shot_type, "shot_type"),
            (self.action_type, "action_type"),
        ):
            if value is not None:
                preds.append(F.col(col) == F.lit(value))
        if self.date_from is not None:
            preds.append(F.col("game_date") >= F.lit(_as_date(self.date_from)))
        if self.date_to is not None:
            preds.append(F.col("game_date") <= F.lit(_as_date(self.date_to)))
        if stored:
            if self.home_away is not None:
                preds.append(F.col("venue") == self.home_away.capitalize())
        elif self.home_away == "home":
            preds.append(F.col("home_team_id") == F.col("team_id"))
        elif self.home_away == "away":
            preds.append(F.col("away_team_id") == F.col("team_id"))
        return all_of(preds)

    def context_columns(self) -> list[str]:
        """The columns of the league baseline that the context predicates read, and the season."""
        given = {
            "game_id": self.game_id, "game_date": self.date_from or self.date_to, "opponent_id": self.opponent_id, "period": self.period,
            "shot_type": self.shot_type, "action_type": self.action_type, "venue": self.home_away,
        }
        return ["season", *[c for c, value in given.items() if value is not None]]

    def subject(self) -> Column:
        preds = [self.context()]
        if self.player_id is not None:
            preds.append(F.col("player_id") == F.lit(self.player_id))
        if self.team_id is not None:
            preds.append(F.col("team_id") == F.lit(self.team_id))
        if self.made is not None:
            preds.append(F.col("shot_made") == F.lit(self.made))
        return all_of(preds)


def _as_date(v: dt.date | str) -> dt.date:
    return v if isinstance(v, dt.date) else dt.date.fromisoformat(v)


def enriched_shots(t: Tables) -> DataFrame:
    """shots ⨝ players ⨝ team ⨝ games ⨝ opponent, opponent = CASE home/away.

    The opponent id is projected on the game side first so the last join is a
    plain equi-join. Dimensions are small; Spark/AQE broadcasts them when the
    measured size is under the broadcast threshold and sort-merges otherwise.
    """
    s = t.shot_attempts
    p = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    team = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("team_abbr"))
    g = t.games.select(F.col("id").alias("game_id"), "game_date", "home_team_id", "away_team_id")
    opp = t.teams.select(
        F.col("id").alias("opponent_id"), F.col("abbreviation").alias("opponent_abbr"),
        F.col("full_name").alias("opponent_name"),
    )
    j = s.join(p, "player_id").join(team, "team_id").join(g, "game_id")
    j = j.withColumn("opponent_id", opponent_of("team_id")).join(opp, "opponent_id")
    return j.withColumn("venue", F.when(F.col("home_team_id") == F.col("team_id"), "Home").otherwise("Away"))


def with_subjects(df: DataFrame, f: ShotFilters) -> DataFrame:
    """Attach (subject_type, subject_id): the filter's subject, or both a player and a team row per shot."""
    if f.player_id is not None:
        return df.withColumn("subject_type", F.lit("player")).withColumn("subject_id", F.col("player_id"))
    if f.team_id is not None:
        return df.withColumn("subject_type", F.lit("team")).withColumn("subject_id", F.col("team_id"))
    subjects = F.array(
        F.struct(F.lit("player").alias("subject_type"), F.col("player_id").alias("subject_id")),
        F.struct(F.lit("team").alias("subject_type"), F.col("team_id").alias("subject_id")),
    )
    return df.select("*", F.inline(subjects))


SUBJECT = ["season", "subject_type", "subject_id"]
