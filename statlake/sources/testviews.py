"""Test-data adapter: derive the star schema from the driver's TPC-H-like tables.

The driver ships ``nation customer part orders lineitem events`` (plus others);
this module maps them onto teams, players, games, box scores and shots with
pure DataFrame expressions, so every derived table grows with the input. The
same derivation is written as SQL text in :mod:`statlake.sources.testviews_sql`
for the DuckDB oracle; the two must stay in step.

Mapping (fixed values of the adapter):
  teams    <- nation     id = n_nationkey + 1
  players  <- part       id = p_partkey + 1, active when p_size % 4 <> 0
  games    <- orders x customer, id = '002' || lpad(o_orderkey, 7, '0'),
              home = c_nationkey + 1, away = (c_nationkey + 1 + o_orderkey % 24) % 25 + 1,
              scores 80 + (o_orderkey * 7) % 61 and 80 + (o_orderkey * 13) % 61
  player_game_stats <- lineitem grouped by (l_orderkey, l_partkey); team by parity of min(l_suppkey)
  shot_attempts     <- one shot per lineitem, zone from l_linenumber, made when l_linestatus = 'F'
  team_game_stats   <- both legs of each game plus the sums of its player rows
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statlake import schemas
from statlake.functions.expr import season_end_year, season_label, season_start_year
from statlake.sources.tables import Tables

# --- fixed adapter values ----------------------------------------------------
ZONES = {  # l_linenumber -> (zone_basic, zone_range)
    1: ("Restricted Area", "Less Than 8 ft."),
    2: ("In The Paint (Non-RA)", "8-16 ft."),
    3: ("Mid-Range", "16-24 ft."),
    4: ("Left Corner 3", "24+ ft."),
    5: ("Right Corner 3", "24+ ft."),
    6: ("Above the Break 3", "24+ ft."),
    7: ("Backcourt", "Back Court Shot"),
}
AREAS = ("Center(C)", "Left Side(L)", "Right Side(R)")  # by l_partkey % 3
ACTIONS = ("Jump Shot", "Driving Layup Shot", "Pullup Jump Shot", "Dunk Shot", "Step Back Jump Shot")  # l_suppkey % 5
LOADED_AT = "2026-01-01 00:00:00"
# -----------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def game_id(orderkey) -> F.Column:
    return F.concat(F.lit("002"), F.lpad(orderkey.cast("string"), 7, "0"))


def _pct(made: F.Column, att: F.Column) -> F.Column:
    return F.when(att > 0, F.round(made.cast("decimal(20,0)") / F.nullif(att, F.lit(0)).cast("decimal(20,0)"), 3)).cast(schemas.PCT)


def _case(key: F.Column, mapping: dict, default=None) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr.otherwise(default) if default is not None else expr


def _games_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    g = o.join(c, o.o_custkey == c.c_custkey)
    return g.select(
        k.alias("k"),
        game_id(k).alias("id"),
        F.to_date("o_orderdate").alias("game_date"),
        season_label(F.to_date("o_orderdate")).alias("season"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("home_team_id"),
        (F.pmod(F.col("c_nationkey") + 1 + F.pmod(k, F.lit(24)), F.lit(25)) + 1).cast("bigint").alias("away_team_id"),
        (F.lit(80) + F.pmod(k * 7, F.lit(61))).cast("int").alias("home_score"),
        (F.lit(80) + F.pmod(k * 13, F.lit(61))).cast("int").alias("away_score"),
    )


def derive(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df) -> Tables:
    """The star schema. ``keep`` may store the games, the player rows and the shots, from which the team rows and the seasons
    are derived too: a job that reads most tables then makes each of them once."""
    nation = _read(spark, sf_dir, "nation")
    teams = nation.select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
        F.col("n_name").alias("full_name"),
        F.concat(F.lit("T"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("abbreviation"),
        F.col("n_name").alias("nickname"),
        F.concat(F.lit("City "), F.col("n_nationkey").cast("string")).alias("city"),
        F.concat(F.lit("State "), F.col("n_regionkey").cast("string")).alias("state"),
        (F.lit(1946) + F.col("n_nationkey")).cast("int").alias("year_founded"),
    )

    part = _read(spark, sf_dir, "part")
    players = part.select(
        (F.col("p_partkey") + 1).cast("bigint").alias("id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("full_name"),
        F.col("p_name").alias("first_name"),
        F.col("p_partkey").cast("string").alias("last_name"),
        (F.pmod(F.col("p_size"), F.lit(4)) != 0).alias("is_active"),
    )

    gk = _games_keyed(spark, sf_dir)
    games = keep(gk.select(*schemas.GAMES.fieldNames()), "games")
    sides = gk.select("k", "season", "home_team_id", "away_team_id")

    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    made = F.col("l_linestatus") == "F"
    three = F.col("l_linenumber") >= 4
    # dealt by game once: hardly two items share a player, so nothing is gained by adding up before the exchange; the text
    # aggregates make it a sorted one, and its order is the one in which the games join. The filter keeps nothing back: it
    # makes every reader need a text aggregate, since without one this becomes two hash maps and a sort of their rows
    box = li.repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"),
        F.sum("l_linenumber").cast("bigint").alias("ln"),
        F.min("l_suppkey").alias("s"),
        ((F.max("l_returnflag") == "R") & (F.min("l_linestatus") == "O")).alias("dnp"),
        F.count(F.lit(1)).cast("int").alias("fga"),
        F.sum(made.cast("int")).cast("int").alias("fgm"),
        F.sum(three.cast("int")).cast("int").alias("fg3a"),
        F.sum((three & made).cast("int")).cast("int").alias("fg3m"),
        F.max("l_returnflag").alias("flag"),
    ).where(F.coalesce("flag", F.lit("")) >= "")
    q, ln = F.col("q"), F.col("ln")
    box = box.join(sides, box.l_orderkey == sides.k).select(
        game_id(F.col("l_orderkey")).alias("game_id"),
        (F.col("l_partkey") + 1).cast("bigint").alias("player_id"),
        F.when(F.pmod(F.col("s"), F.lit(2)) == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
        "season",
        F.when(~F.col("dnp"), (F.lit(12) + F.pmod(q * 3, F.lit(30)) + F.pmod(ln, F.lit(2)) * F.lit(0.5))).cast(schemas.PLAYER_MINUTES).alias("minutes"),
        "q", "ln", "fga", "fgm", "fg3a", "fg3m",
    )
    fta = F.pmod(q, F.lit(7))
    ftm = F.pmod(q * 5, fta + 1)
    rebounds = F.pmod(q + ln, F.lit(16))
    player_game_stats = box.select(
        "game_id", "player_id", "team_id", "season", "minutes",
        (F.col("fgm") * 2 + F.col("fg3m") + ftm).cast("int").alias("points"),
        rebounds.cast("int").alias("rebounds"),
        F.pmod(rebounds, F.lit(4)).cast("int").alias("offensive_rebounds"),
        (rebounds - F.pmod(rebounds, F.lit(4))).cast("int").alias("defensive_rebounds"),
        F.pmod(q * 7, F.lit(13)).cast("int").alias("assists"),
        F.pmod(ln, F.lit(4)).cast("int").alias("steals"),
        F.pmod(q + ln * 3, F.lit(4)).cast("int").alias("blocks"),
        F.pmod(q * 5, F.lit(7)).cast("int").alias("turnovers"),
        F.pmod(q + ln, F.lit(7)).cast("int").alias("personal_fouls"),
        "fgm", "fga", _pct(F.col("fgm"), F.col("fga")).alias("fg_pct"),
        "fg3m", "fg3a", _pct(F.col("fg3m"), F.col("fg3a")).alias("fg3_pct"),
        ftm.cast("int").alias("ftm"), fta.cast("int").alias("fta"), _pct(ftm, fta).alias("ft_pct"),
        (F.pmod(q, F.lit(31)) - 15).cast(schemas.PLUS_MINUS).alias("plus_minus"),
    )
    player_game_stats = keep(player_game_stats, "player-rows")

    # one shot per line item; event ids numbered within the game
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    w_game = Window.partitionBy("l_orderkey").orderBy(*order)
    w_player = Window.partitionBy("l_orderkey", "l_partkey")
    shots = li.select(
        "*",
        F.row_number().over(w_game).cast("int").alias("event_id"),
        F.min("l_suppkey").over(w_player).alias("s"),
    )
    shots = shots.join(sides, shots.l_orderkey == sides.k)
    p, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    zone_basic = _case(line, {k: v[0] for k, v in ZONES.items()})
    zone_range = _case(line, {k: v[1] for k, v in ZONES.items()})
    zone_area = (
        F.when(line == 4, AREAS[1]).when(line == 5, AREAS[2]).when(line == 7, "Back Court(BC)")
        .otherwise(_case(F.pmod(p, F.lit(3)), dict(enumerate(AREAS))))
    )
    distance = (
        F.when(line == 1, F.pmod(p, F.lit(4)))
        .when(line == 2, 8 + F.pmod(p, F.lit(8)))
        .when(line == 3, 16 + F.pmod(p, F.lit(8)))
        .when(line <= 5, 22 + F.pmod(p, F.lit(3)))
        .when(line == 6, 24 + F.pmod(p, F.lit(6)))
        .otherwise(40 + F.pmod(p, F.lit(30)))
    )
    shot_attempts = shots.select(
        game_id(F.col("l_orderkey")).alias("game_id"),
        "event_id",
        (p + 1).cast("bigint").alias("player_id"),
        F.when(F.pmod(F.col("s"), F.lit(2)) == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
        "season",
        (F.lit(1) + F.pmod(F.col("event_id") - 1, F.lit(4))).cast("int").alias("period"),
        F.pmod(p, F.lit(12)).cast("int").alias("minutes_remaining"),
        F.pmod(s, F.lit(60)).cast("int").alias("seconds_remaining"),
        _case(F.pmod(s, F.lit(5)), dict(enumerate(ACTIONS))).alias("action_type"),
        F.when(line >= 4, "3PT Field Goal").otherwise("2PT Field Goal").alias("shot_type"),
        zone_basic.alias("zone_basic"),
        zone_area.alias("zone_area"),
        zone_range.alias("zone_range"),
        distance.cast("int").alias("shot_distance"),
        (F.pmod(p * 7, F.lit(501)) - 250).cast("int").alias("loc_x"),
        (F.pmod(s * 11, F.lit(400)) - 50).cast("int").alias("loc_y"),
        (F.col("l_linestatus") == "F").alias("shot_made"),
    )
    shot_attempts = keep(shot_attempts, "shots")

    # team rows: both legs of every game plus the sums of that team's player rows
    sums = player_game_stats.groupBy("game_id", "team_id").agg(
        *[F.sum(c).alias(c) for c in ("rebounds", "offensive_rebounds", "defensive_rebounds", "assists", "steals",
                                       "blocks", "turnovers", "personal_fouls", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")]
    )
    legs = games.select(
        F.col("id").alias("game_id"), "season",
        F.explode(F.array(
            F.struct(F.col("home_team_id").alias("team_id"), F.lit(True).alias("is_home"),
                     F.col("home_score").alias("score"), F.col("away_score").alias("opp")),
            F.struct(F.col("away_team_id").alias("team_id"), F.lit(False).alias("is_home"),
                     F.col("away_score").alias("score"), F.col("home_score").alias("opp")),
        )).alias("leg"),
    ).select("game_id", "season", "leg.*")
    t = legs.join(sums, ["game_id", "team_id"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    team_game_stats = t.select(
        "game_id", "team_id", "season", "is_home", F.lit(240).alias("minutes"),
        F.col("score").cast("int").alias("points"),
        *[z(c).alias(c) for c in ("rebounds", "offensive_rebounds", "defensive_rebounds", "assists", "steals",
                                  "blocks", "turnovers", "personal_fouls")],
        z("fgm").alias("fgm"), z("fga").alias("fga"), _pct(z("fgm"), z("fga")).alias("fg_pct"),
        z("fg3m").alias("fg3m"), z("fg3a").alias("fg3a"), _pct(z("fg3m"), z("fg3a")).alias("fg3_pct"),
        z("ftm").alias("ftm"), z("fta").alias("fta"), _pct(z("ftm"), z("fta")).alias("ft_pct"),
        (F.col("score") - F.col("opp")).cast(schemas.PLUS_MINUS).alias("plus_minus"),
    )

    seasons = _seasons(games, player_game_stats, shot_attempts)
    return Tables(
        seasons=seasons,
        teams=teams,
        players=players,
        games=games,
        team_game_stats=team_game_stats.select(*schemas.TEAM_GAME_STATS.fieldNames()),
        player_game_stats=player_game_stats.select(*schemas.PLAYER_GAME_STATS.fieldNames()),
        shot_attempts=shot_attempts,
    )


def _seasons(games: DataFrame, pgs: DataFrame, shots: DataFrame) -> DataFrame:
    g = games.groupBy("season").agg(F.count(F.lit(1)).alias("games_count"))
    p = pgs.groupBy("season").agg(F.count_distinct("player_id").alias("players_count"))
    s = shots.groupBy("season").agg(F.count(F.lit(1)).alias("shot_attempts_count"))
    stamp = F.lit(LOADED_AT).cast("timestamp_ntz")
    return (
        g.join(p, "season", "left").join(s, "season", "left")
        .select(
            F.col("season").alias("id"),
            season_start_year("season").alias("start_year"),
            season_end_year("season").alias("end_year"),
            F.col("games_count").cast("int").alias("games_count"),
            F.coalesce(F.col("players_count"), F.lit(0)).cast("int").alias("players_count"),
            stamp.alias("loaded_at"),
            F.coalesce(F.col("shot_attempts_count"), F.lit(0)).cast("bigint").alias("shot_attempts_count"),
            stamp.alias("manifest_generated_at"),
            stamp.alias("verified_at"),
            F.lit("passed").alias("verification_status"),
            F.sha2(F.col("season"), 256).alias("manifest_sha256"),
        )
    )


def provider_feeds(t: Tables) -> dict[str, DataFrame]:
    """Provider-shaped rows (upper-case headers, text cells) re-expressed from the star schema,
    to run the ETL transforms end to end on the driver data: team and player game logs,
    the player list, the team records and shot detail."""
    txt = lambda c: F.col(c).cast("string")
    from statlake.operators.transforms import BOX_RENAMES, SHOT_RENAMES

    abbr = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("TEAM_ABBREVIATION"))
    opp = t.teams.select(F.col("id").alias("opponent_id"), F.col("abbreviation").alias("opp_abbr"))
    g = t.games.select(F.col("id").alias("game_id"), "game_date", "home_team_id", "away_team_id")
    tgs = (t.team_game_stats.join(g, "game_id").join(abbr, "team_id")
           .withColumn("opponent_id", F.when(F.col("is_home"), F.col("away_team_id")).otherwise(F.col("home_team_id")))
           .join(opp, "opponent_id"))
    matchup = F.concat(F.col("TEAM_ABBREVIATION"), F.when(F.col("is_home"), F.lit(" vs. ")).otherwise(F.lit(" @ ")),
                       F.col("opp_abbr"))
    team_log = tgs.select(
        F.col("season"), F.col("season").alias("source_file"),
        F.when(F.col("is_home"), 0).otherwise(1).alias("row_number"),
        txt("game_id").alias("GAME_ID"), txt("game_date").alias("GAME_DATE"), matchup.alias("MATCHUP"),
        txt("team_id").alias("TEAM_ID"), "TEAM_ABBREVIATION",
        *[txt(v).alias(k) for k, v in BOX_RENAMES.items()],
    )
    player_log = t.player_game_stats.select(
        "season", txt("game_id").alias("GAME_ID"), txt("player_id").alias("PLAYER_ID"), txt("team_id").alias("TEAM_ID"),
        *[txt(v).alias(k) for k, v in BOX_RENAMES.items()],
    )
    players = t.players.select(
        txt("id").alias("PERSON_ID"), F.col("full_name").alias("DISPLAY_FIRST_LAST"),
        F.when(F.col("last_name").isNotNull(),
               F.concat_ws(", ", F.col("last_name"), F.col("first_name"))).alias("DISPLAY_LAST_COMMA_FIRST"),
        F.when(F.col("is_active"), "1").otherwise("0").alias("ROSTERSTATUS"),
    )
    shots = t.shot_attempts.select(
        "season", *[txt(v).alias(k) for k, v in SHOT_RENAMES.items() if k != "SHOT_MADE_FLAG"],
        F.when(F.col("shot_made"), "1").otherwise("0").alias("SHOT_MADE_FLAG"),
    )
    return {"teams": t.teams, "players": players, "team_log": team_log, "player_log": player_log, "shots": shots}


# --- operational logs derived from the driver's `events` and `orders` tables -------------
VIEW_CANDIDATES = ("standings", "leaders", "games", "shots", "players", "compare", "player", "game", "team",
                   "home", "search")  # by event_id % 11; the last two are not allowlisted


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    views = F.array(*[F.lit(v) for v in VIEW_CANDIDATES])
    return e.select("event_id", "ts", F.col("event_type").alias("event"),
                    F.element_at(views, (F.pmod(F.col("event_id"), F.lit(len(VIEW_CANDIDATES))) + 1).cast("int")).alias("view"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: client = user, group/path from the event type, latency = value x 10 ms."""
    e = _read(spark, sf_dir, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    return e.select(
        eid.alias("request_id"), "ts",
        F.concat(F.lit("c"), uid.cast("string")).alias("client"),
        F.col("event_type").alias("group"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") * 10).alias("duration_ms"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("203.0.113."), F.pmod(uid, F.lit(250)).cast("string")))
        .when(F.col("event_type") == "error", F.lit("not-an-ip")).alias("edge_header"),
        F.when(F.pmod(eid, F.lit(3)) == 1, F.concat(F.lit("198.51.100."), F.pmod(uid, F.lit(200)).cast("string")))
        .when(F.pmod(eid, F.lit(3)) == 2, F.concat(F.lit("10.1.1."), F.pmod(eid, F.lit(250)).cast("string"),
                                                   F.lit(", 198.51.100."), F.pmod(uid, F.lit(200)).cast("string")))
        .alias("forwarded_for"),
        F.concat(F.lit("192.0.2."), F.pmod(uid, F.lit(100)).cast("string")).alias("peer"),
    )


def snapshot_listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(objects, proven pointers): one object per order under a per-season prefix; orders with
    status 'P' are pointer/metadata objects (.json), the rest backups (.dump). The proven copy of
    a prefix is its most valuable order's backup, proven two days after it was written."""
    o = _read(spark, sf_dir, "orders")
    prefix = F.concat(F.lit("backups/"), season_label(F.to_date("o_orderdate")), F.lit("/"))
    modified = (F.col("o_orderdate") + F.make_interval(secs=F.pmod(F.col("o_orderkey"), F.lit(86400)).cast("decimal(18,6)")))
    objects = o.select(
        prefix.alias("prefix"),
        F.concat(prefix, F.lpad(F.col("o_orderkey").cast("string"), 7, "0"),
                 F.when(F.col("o_orderstatus") == "P", ".json").otherwise(".dump")).alias("key"),
        modified.alias("modified"), "o_totalprice")
    pointers = (objects.where(F.col("key").endswith(".dump")).groupBy("prefix")
                .agg(F.max_by(F.struct("key", "modified"), F.struct("o_totalprice", "key")).alias("p"))
                .select("prefix", F.col("p.key").alias("key"), (F.col("p.modified") + F.make_interval(days=F.lit(2))).alias("proven_at")))
    return objects.drop("o_totalprice"), pointers


def listing_now(spark: SparkSession, sf_dir: str):
    """Reference time for the listing: one day after the newest order date (a single scalar)."""
    import datetime as _dt

    latest = _read(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    return latest + _dt.timedelta(days=1)
