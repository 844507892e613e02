"""All rules of a dataset in one pass: every table is read once, and all its rows meet their game in one exchange.

The games and the three fact tables become one table of narrow rows
(:func:`rows_by_game`). Errors that a row shows by itself are found at the scan
as an array; whether its team and player exist comes from one join each. Rows
are then dealt by game id once, and windows over the game and over (game,
player) give each row what it needs of the others: the games rows of its id,
the rows that share its natural key, the shots beside a box score. Two sorts
serve all windows: one by natural key, one whose order begins with the keys of
each of the others. A rule thus costs an expression, not a scan and a join.

Windows hold the rows of one game (or one player's of a game). Rows without a
game id never match another table's row; they are spread by player or team.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlake.functions.expr import THREE_POINT

GAME, TEAM_ROW, PLAYER_ROW, SHOT = 0, 1, 2, 3
KINDS = {"games": GAME, "team_game_stats": TEAM_ROW, "player_game_stats": PLAYER_ROW, "shot_attempts": SHOT}
#: The column that makes a row's natural key beside its game (of a games row: its season).
SECOND_KEY = {"games": "season", "team_game_stats": "team_id", "player_game_stats": "player_id", "shot_attempts": "event_id"}
#: What the rows of a game share.
GAME_KEY = ["game_hash", "game_key"]
ERRORS = "array<struct<rule_id:string,detail:string>>"
#: Columns of the united rows beside kind, errors and what a caller carries.
_COLUMNS = {
    "game_id": "string", "season": "string", "team_id": "bigint", "player_id": "bigint", "event_id": "int",
    "home_team_id": "bigint", "away_team_id": "bigint", "home_score": "int", "away_score": "int",
    "is_home": "boolean", "points": "int", "fga": "int", "fgm": "int", "fg3a": "int", "fg3m": "int",
    "three": "boolean", "made": "boolean", "home_known": "boolean", "away_known": "boolean",
}


# --- error arrays --------------------------------------------------------------------
def no_errors() -> Column:
    return F.array().cast(ERRORS)


def _one(rule_id: str, detail: str) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(detail or rule_id).alias("detail"))


def error(rule_id: str, bad: Column, detail: str = "") -> Column:
    """The error once where ``bad``, else nothing (null counts as nothing)."""
    return F.when(bad, F.array(_one(rule_id, detail))).otherwise(no_errors())


def errors_times(rule_id: str, times: Column, detail: str = "") -> Column:
    """The error ``times`` times (null: not at all)."""
    return F.array_repeat(_one(rule_id, detail), F.coalesce(times, F.lit(0)).cast("int"))


def all_errors(parts: list[Column], any_bad: Column | None = None) -> Column:
    """The errors of all ``parts``; ``any_bad`` is true where there are some, so that other rows build no lists."""
    # the filter keeps nothing back: a higher-order function makes Spark evaluate the tests outside its one generated
    # method a stage, which dozens of tests make too long for the JVM to compile
    if not parts:
        return no_errors()
    errors = F.filter(F.flatten(F.array(*parts)), F.isnotnull)
    return errors if any_bad is None else F.when(any_bad, errors).otherwise(no_errors())


def errors_of(tests: list[tuple[str, Column, str]]) -> Column:
    """The errors of ``(rule_id, bad, detail)`` tests."""
    return all_errors([error(*t) for t in tests], any_of([bad for _, bad, _ in tests]))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def any_of_kind(tests: dict[int, list[Column]]) -> Column:
    """A row breaks one of its kind's tests."""
    return any_of([(F.col("kind") == kind) & any_of(bad) for kind, bad in tests.items()])


# --- the united rows -----------------------------------------------------------------
def known_ids(df: DataFrame, alias: str, flag: str) -> DataFrame:
    """Every id of ``df`` once, with a true ``flag``."""
    return df.where(F.col("id").isNotNull()).select(F.col("id").alias(alias)).distinct().withColumn(flag, F.lit(True))


def is_kind(*kinds: int) -> Column:
    return F.col("kind").isin(*kinds)


def plays(team: Column, game: Column) -> Column:
    return (team == game["home_team_id"]) | (team == game["away_team_id"])


def rows_by_game(tables: dict[str, DataFrame], teams: DataFrame, players: DataFrame,
                 row_errors: Callable[[str], Column], carry: dict[str, str] | None = None) -> DataFrame:
    """The united rows of games and facts, each beside what its rules need of its game.

    ``row_errors(table)``: an error array over the table's own columns;
    ``carry``: name -> type of further columns, null where a table lacks them.
    Beside its own columns a row gets:

    * ``team_known``, ``player_known`` (facts), ``home_known``, ``away_known`` (games)
    * ``copies``: (season, home_team_id, away_team_id) of every games row with its id
    * ``legs``: (team_id, points) of the game's team rows
    * ``team_rows``, ``player_rows``: rows of its game
    * ``same_key``: rows of its table with its natural key (1 where a part is null)
    * ``box_rows`` and ``shot_*``: box scores and shot totals of its (game, player)
    * ``place``, ``in_season``: its number among, and the number of, its table's rows of its (game, season), of box scores and
      shots also of its player; of games rows those with an unknown team come first
    * ``first_shot``: it is the first shot of its (season, game, player); ``shot_teams``: these shots' teams (1 or 2 for more)
    """
    types = _COLUMNS | (carry or {})
    home, away = known_ids(teams, "home_team_id", "home_known"), known_ids(teams, "away_team_id", "away_known")

    def narrow(name: str) -> DataFrame:
        df = tables[name].withColumn("errors", row_errors(name))
        if name == "games":
            df = df.withColumnRenamed("id", "game_id").join(home, "home_team_id", "left").join(away, "away_team_id", "left")
        if name == "shot_attempts":
            df = df.withColumns({"three": F.col("shot_type") == THREE_POINT, "made": F.col("shot_made")})
        have = set(df.columns)
        return df.select(F.lit(KINDS[name]).alias("kind"), "errors",
                         *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    # each id is looked up by the tables that have it, so no table brings null ids to the join
    own = narrow("player_game_stats").unionByName(narrow("shot_attempts")).join(known_ids(players, "player_id", "player_known"), "player_id", "left")
    own = own.unionByName(narrow("team_game_stats"), allowMissingColumns=True).join(known_ids(teams, "team_id", "team_known"), "team_id", "left")
    rows = own.unionByName(narrow("games"), allowMissingColumns=True)
    alone = F.when(is_kind(PLAYER_ROW, SHOT), F.xxhash64("player_id")).otherwise(F.xxhash64("team_id", "home_team_id", "season"))
    rows = rows.withColumn("game_key", F.coalesce(F.concat(F.lit("="), F.col("game_id")), F.concat(F.lit("?"), F.col("kind"), alone)))

    def of(kind: int, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    def count(kind: int, cond: Column | None = None) -> Column:
        return F.count_if(F.col("kind") == kind if cond is None else (F.col("kind") == kind) & cond)

    # what other columns tell is not shuffled: the natural keys' second part is taken after the exchange, the game id at the
    # end; the hash in front of the key: sorts compare eight bytes, where ids begin alike
    second_key = F.coalesce(*[of(kind, F.col(SECOND_KEY[name]).cast("string")) for name, kind in KINDS.items()])
    rows = rows.drop("game_id").repartition("game_key").withColumns({"game_hash": F.xxhash64("game_key"), "second_key": second_key})
    named = F.col("game_key").startswith("=")
    matched = named & F.col("player_id").isNotNull()
    key = Window.partitionBy(*GAME_KEY, "kind", "second_key")
    rows = rows.withColumn("same_key", F.when(named & F.col("second_key").isNotNull(), F.count(F.lit(1)).over(key)).otherwise(F.lit(1)))
    # the order of all windows below, so that they need no sort of their own (rows without a player: games and team rows)
    lost = is_kind(GAME) & (F.col("home_known").isNull() | F.col("away_known").isNull())
    rows = rows.withColumn("behind", ~lost).sortWithinPartitions(*GAME_KEY, "player_id", "kind", "season", "behind", "event_id")
    game, pair = Window.partitionBy(*GAME_KEY), Window.partitionBy(*GAME_KEY, "player_id")
    mine = Window.partitionBy(*GAME_KEY, "player_id", "kind", "season").orderBy("behind", "event_id")
    all_mine = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shot = lambda c: of(SHOT, F.col(c))
    rows = rows.withColumns({
        "copies": F.collect_list(of(GAME, F.struct("season", "home_team_id", "away_team_id"))).over(game),
        "legs": F.collect_list(of(TEAM_ROW, F.struct("team_id", "points"))).over(game),
        "team_rows": count(TEAM_ROW).over(game), "player_rows": count(PLAYER_ROW).over(game),
    }).withColumns({
        "box_rows": F.when(matched, count(PLAYER_ROW).over(pair)).otherwise(F.lit(0)),
        "shot_season": F.min(shot("season")).over(pair),
        "shot_team": F.when(matched, F.min(shot("team_id")).over(pair)),
        **{f"shot_{c}": F.when(matched, count(SHOT, cond).over(pair)).otherwise(F.lit(0)) for c, cond in (
            ("fga", None), ("fgm", F.col("made")), ("fg3a", F.col("three")), ("fg3m", F.col("three") & F.col("made")))},
    }).withColumns({
        "shot_teams": F.when(F.min("team_id").over(all_mine) < F.max("team_id").over(all_mine), 2).otherwise(1),
        "place": F.row_number().over(mine), "in_season": F.count(F.lit(1)).over(all_mine),
    })
    return rows.withColumns({"first_shot": is_kind(SHOT) & (F.col("place") == 1), "game_id": F.when(named, F.expr("substring(game_key, 2)"))})


def with_sides(rows: DataFrame) -> DataFrame:
    """Adds what the game's team and player rows show of its two sides (for the rules on whole games).

    A game id with several different games rows counts its rows beside each.
    """
    game = Window.partitionBy(*GAME_KEY)
    variants = F.array_distinct(F.transform("copies", lambda c: F.struct(c["home_team_id"].alias("home_team_id"), c["away_team_id"].alias("away_team_id"))))
    sided = is_kind(TEAM_ROW, PLAYER_ROW)  # the rows that are looked at
    some = lambda test: sided & F.coalesce(F.exists("variants", test), F.lit(False))
    team = F.col("team_id")
    rows = rows.withColumn("variants", F.when(~is_kind(SHOT), variants)).withColumns({
        "other": F.when(sided, F.size(F.filter("variants", lambda v: ~plays(team, v)))),
        "as_home": some(lambda v: team == v["home_team_id"]), "as_away": some(lambda v: team == v["away_team_id"])})
    mine = is_kind(TEAM_ROW)
    flag = F.col("is_home").cast("int")
    return rows.withColumns({
        "side_rows": F.col("team_rows") * F.size("variants"),
        "side_other": F.sum(F.when(mine, F.col("other"))).over(game),
        "side_teams": F.size(F.collect_set(F.when(mine, team)).over(game)),
        "home_flag": F.max(F.when(mine & F.col("as_home"), flag)).over(game),
        "away_flag": F.max(F.when(mine & F.col("as_away"), flag)).over(game),
        "home_points": F.max(F.when(mine & F.col("as_home"), F.col("points"))).over(game),
        "away_points": F.max(F.when(mine & F.col("as_away"), F.col("points"))).over(game),
        "player_other": F.sum(F.when(is_kind(PLAYER_ROW), F.col("other"))).over(game),
        "player_teams": F.size(F.collect_set(F.when(is_kind(PLAYER_ROW) & (F.col("as_home") | F.col("as_away")), team)).over(game)),
    })


# --- verdicts shared by the rule sets --------------------------------------------------
def game_unknown() -> Column:
    return F.col("game_id").isNull() | (F.size("copies") == 0)


def team_unknown() -> Column:
    return F.col("team_known").isNull()


def player_unknown() -> Column:
    return F.col("player_known").isNull()


def sides() -> dict[str, Column]:
    """Of a games row: team rows missing, of another shape, flags or points wrong; player rows wrong."""
    expected = F.size(F.array_distinct(F.array("home_team_id", "away_team_id")))
    missing = F.col("team_rows") == 0
    shape = ~missing & ((F.col("side_rows") != 2) | (F.col("side_other") > 0) | (F.col("side_teams") != expected))
    good = ~missing & ~shape
    home, away = F.col("home_flag"), F.col("away_flag")
    flags = ((home == 1) & (away == 0)) | ((home == 0) & (away == 0))
    points = (F.col("home_points") == F.col("home_score")) & (F.col("away_points") == F.col("away_score"))
    return {"missing": missing, "shape": shape, "flags": good & ~F.coalesce(flags, F.lit(False)),
            "points": good & ~F.coalesce(points, F.lit(False)),
            "players": (F.col("player_rows") == 0) | (F.col("player_other") > 0) | (F.col("player_teams") != expected)}


def box_differs() -> Column:
    """Of a box-score row: its shots' team or totals differ (attempts by more than one, makes at all)."""
    differs = (F.col("team_id").isNull() | (F.col("shot_team").isNotNull() & (F.col("team_id") != F.col("shot_team")))
               | (F.abs(F.col("fga") - F.col("shot_fga")) > 1) | ~F.col("fgm").eqNullSafe(F.col("shot_fgm").cast("int"))
               | (F.abs(F.col("fg3a") - F.col("shot_fg3a")) > 1) | ~F.col("fg3m").eqNullSafe(F.col("shot_fg3m").cast("int")))
    return F.coalesce(differs, F.lit(True))


def shots_alone() -> Column:
    """Of a shot: it stands for all shots of its (game, player), which have no box score."""
    return F.col("first_shot") & (F.col("box_rows") == 0) & F.col("season").eqNullSafe(F.col("shot_season"))
