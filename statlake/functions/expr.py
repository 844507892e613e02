"""Scalar and aggregate expression helpers (all built-in, JVM-side Columns).

Ratios and averages are computed in decimal arithmetic and rounded half away
from zero, the way the product's SQL does it, then cast to double at the output.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE_INT = T.DecimalType(20, 0)
WIDE_FRACTION = T.DecimalType(24, 4)

# --- fixed values that must equal the product's ------------------------------
THREE_POINT = "3PT Field Goal"
TWO_POINT = "2PT Field Goal"
SHOT_TYPES = (TWO_POINT, THREE_POINT)
# zone_basic -> normalized area, and the display order of the areas
ZONE_NORMALIZATION = {
    "Restricted Area": "Rim",
    "In The Paint (Non-RA)": "Paint",
    "Mid-Range": "Midrange",
    "Left Corner 3": "Corner 3",
    "Right Corner 3": "Corner 3",
    "Above the Break 3": "Above the Break 3",
}
AREA_ORDER = ("Rim", "Paint", "Midrange", "Corner 3", "Above the Break 3")
# first day after the All-Star break, by season; other seasons use Feb 16 of the end year
ALL_STAR_BREAK_END = {"2025-26": "2026-02-16"}
STAT_CATEGORIES = ("points", "rebounds", "assists", "steals", "blocks")
# -----------------------------------------------------------------------------


def all_of(preds: list[Column]) -> Column:
    """AND-join optional predicates (F2); an empty list is TRUE."""
    return reduce(and_, preds) if preds else F.lit(True)


def ratio(num: Column, den: Column, scale: int = 3) -> Column:
    """ROUND(num::numeric / NULLIF(den, 0), scale) as double."""
    q = num.cast(WIDE_INT) / F.nullif(den, F.lit(0)).cast(WIDE_INT)
    return F.round(q, scale).cast("double")


def ratio_dec(num: Column, den: Column, scale: int = 3) -> Column:
    """As :func:`ratio` but kept decimal, for exact differences of rounded ratios."""
    q = num.cast(WIDE_INT) / F.nullif(den, F.lit(0)).cast(WIDE_INT)
    return F.round(q, scale)


def avg_round(c: Column | str, scale: int = 1) -> Column:
    """ROUND(AVG(c), scale) with an exact decimal mean (A7); nulls ignored."""
    c = F.col(c) if isinstance(c, str) else c
    q = F.sum(c).cast(WIDE_FRACTION) / F.nullif(F.count(c), F.lit(0)).cast(WIDE_INT)
    return F.round(q, scale).cast("double")


def efg(fgm: Column, fg3m: Column, fga: Column) -> Column:
    """(fgm + 0.5*fg3m)/fga, rounded to 3 (A8); computed as (2fgm+fg3m)/(2fga)."""
    return ratio(fgm * 2 + fg3m, fga * 2, 3)


def points_value(made: Column | str = "shot_made", shot_type: Column | str = "shot_type") -> Column:
    """3 for a made three, 2 for a made two, 0 for a miss (C11)."""
    made = F.col(made) if isinstance(made, str) else made
    shot_type = F.col(shot_type) if isinstance(shot_type, str) else shot_type
    return F.when(made, F.when(shot_type == THREE_POINT, 3).otherwise(2)).otherwise(0)


def normalized_zone(zone_basic: Column | str = "zone_basic") -> Column:
    """Seven zones onto five areas; other zones (e.g. Backcourt) pass through."""
    z = F.col(zone_basic) if isinstance(zone_basic, str) else zone_basic
    expr = None
    for basic, area in ZONE_NORMALIZATION.items():
        expr = (F.when(z == basic, area) if expr is None else expr.when(z == basic, area))
    return expr.otherwise(z)


def area_sort_key(area: Column) -> Column:
    expr = None
    for i, name in enumerate(AREA_ORDER, start=1):
        expr = F.when(area == name, str(i)) if expr is None else expr.when(area == name, str(i))
    return expr.otherwise(F.concat(F.lit("9"), area))


def season_start_year(season: Column | str = "season") -> Column:
    s = F.col(season) if isinstance(season, str) else season
    return F.split_part(s, F.lit("-"), F.lit(1)).cast("int")


def season_end_year(season: Column | str = "season") -> Column:
    """start + ((suffix - start % 100 + 100) % 100), i.e. century rollover."""
    s = F.col(season) if isinstance(season, str) else season
    start = season_start_year(s)
    suffix = F.split_part(s, F.lit("-"), F.lit(2)).cast("int")
    return start + F.pmod(suffix - F.pmod(start, F.lit(100)) + 100, F.lit(100))


def season_label(d: Column | str) -> Column:
    """Oct-Dec belong to the season starting that year, else the prior year."""
    d = F.col(d) if isinstance(d, str) else d
    y = F.when(F.month(d) >= 10, F.year(d)).otherwise(F.year(d) - 1)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def season_is_valid(season: Column | str = "season") -> Column:
    """``YYYY-YY`` with the suffix equal to (start + 1) % 100."""
    s = F.col(season) if isinstance(season, str) else season
    start = F.substring(s, 1, 4).cast("int")
    suffix = F.substring(s, 6, 2).cast("int")
    return F.coalesce(s.rlike(r"^\d{4}-\d{2}$") & (suffix == F.pmod(start + 1, F.lit(100))), F.lit(False))


def break_end(season: Column | str = "season") -> Column:
    """All-Star break end for a season: configured date, else Feb 16 of start+1."""
    s = F.col(season) if isinstance(season, str) else season
    configured = None
    for name, day in ALL_STAR_BREAK_END.items():
        configured = (F.when(s == name, F.to_date(F.lit(day))) if configured is None
                      else configured.when(s == name, F.to_date(F.lit(day))))
    default = F.make_date(season_start_year(s) + 1, F.lit(2), F.lit(16))
    return configured.otherwise(default)


def court_x(loc_x: Column | str = "loc_x") -> Column:
    """Court drawing x: loc_x + 260 clamped to 10..510 (C17)."""
    c = F.col(loc_x) if isinstance(loc_x, str) else loc_x
    return F.least(F.greatest(c + 260, F.lit(10)), F.lit(510))


def court_y(loc_y: Column | str = "loc_y") -> Column:
    """Court drawing y: 480 - loc_y clamped to 10..500 (C17)."""
    c = F.col(loc_y) if isinstance(loc_y, str) else loc_y
    return F.least(F.greatest(F.lit(480) - c, F.lit(10)), F.lit(500))


def parse_bool(text: Column) -> Column:
    """'true'/'false' (trimmed, any case) to boolean, anything else null (C14)."""
    t = F.lower(F.trim(text))
    # the plain words first: lower-casing is slow, and most cells need none
    return F.when(text == "true", True).when(text == "false", False).when(t == "true", True).when(t == "false", False)


def escape_like(text: str) -> str:
    """Escape ``% _ \\`` so a search term matches literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c: Column, term: str) -> Column:
    """Case-insensitive literal substring (ILIKE '%term%' with escaping)."""
    return F.lower(c).contains(term.lower())
