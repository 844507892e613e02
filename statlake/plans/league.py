"""The stored league baseline (Q16, J19): attempts and makes over the columns that shot filters can name.

Shot summaries and zones compare a subject with the league under the same
context. Counted from the shots, the league is a second scan of the largest
table in every such query; kept as a table beside the facts it is a scan of
counts. The table is partitioned by season like the facts, so a publication
rebuilds the baseline of the season it replaces and no other.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.operators.shot_filters import ShotFilters, enriched_shots
from statlake.sources.stored import stored
from statlake.sources.tables import Tables

#: Context columns (a subject and ``made`` are no context), and the zone.
CONTEXT = ["season", "game_id", "game_date", "opponent_id", "period", "shot_type", "action_type", "venue"]
ZONE = ["zone_basic", "zone_area", "zone_range"]


def league_counts(t: Tables, context: list[str] | None = None) -> DataFrame:
    """The baseline of all seasons of ``t``, counted from the shots, over the columns ``context`` (all unless given)."""
    return enriched_shots(t).groupBy(*(CONTEXT if context is None else context), *ZONE).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("shot_made")).alias("makes"))


def with_league(t: Tables, f: ShotFilters | None = None) -> Tables:
    """``t`` with its baseline counted once and stored; a published version brings its own.

    With the filters ``f`` of the one query that will read it, the baseline has the columns that they name only: over all
    of them it has nearly a row a shot, since they tell games apart.
    """
    return t if t.league is not None else replace(t, league=stored(league_counts(t, f and f.context_columns()), "league"))
