"""Binds library functions to registry names (one per SURVEY §2 id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlake.plans import season
from statlake.plans.catalog import star
from statlake.sources.seeded import core_roster, seed_faults, seed_seasons, seed_text_faults

# --- scans of the star schema (S4) -------------------------------------------
for _name in ("seasons", "teams", "players", "games", "team_game_stats", "player_game_stats", "shot_attempts"):
    star(f"S4_{_name}")(lambda t, _n=_name: getattr(t, _n))

# --- season analytics --------------------------------------------------------
star("Q5")(season.team_season_summary)
star("Q6")(season.team_players)
star("Q9")(season.player_season_averages)
star("Q22")(season.head_to_head)
star("Q28")(lambda t: season.leaders(core_roster(t)))
star("Q29")(season.standings)
star("Q30")(season.team_standings_view)
star("Q31")(season.player_season_averages_view)
star("Q32")(season.game_summary_view)
star("Q33")(season.team_season_stats_view)
star("Q34")(season.season_metadata)
star("A9")(season.minimum_games)
star("Q21")(lambda t: season.compare_players(t, 1, 2, "1995-96"))
star("Q22_teams")(lambda t: season.compare_teams(t, 3, 7, "1995-96"))
star("Q29_order")(season.standings_in_order)


# --- shot charts ---------------------------------------------------------------
from statlake.operators.shot_filters import ShotFilters  # noqa: E402
from statlake.plans import shots  # noqa: E402
from statlake.plans.league import with_league  # noqa: E402
from statlake.sources.stored import shared_path, stored  # noqa: E402

star("Q11")(shots.shot_players)
star("Q12")(shots.shot_action_types)
star("Q13")(shots.shot_games)
star("Q14")(shots.shot_export_rows)
# summaries, zones and the league read the stored baseline, which is counted first
star("Q15")(lambda t: shots.shot_summary(with_league(t, ShotFilters())))
star("Q16")(lambda t: shots.league_shot_context(with_league(t, ShotFilters())))
# the product's filters: context predicates, one subject, and ``made`` (which leaves the league out)
FILTERED = {
    "Q15_opponent": ShotFilters(opponent_id=3, period=2, shot_type="3PT Field Goal"),
    "Q15_team": ShotFilters(season="1995-96", team_id=5, home_away="home", date_from="1995-11-01", date_to="1996-03-31"),
    "Q15_made": ShotFilters(made=True, home_away="away"),
}
for _name, _f in FILTERED.items():
    star(_name)(lambda t, _f=_f: shots.shot_summary(with_league(t, _f), _f))
star("Q18_opponent")(lambda t: shots.shot_zones(with_league(t, FILTERED["Q15_opponent"]), FILTERED["Q15_opponent"]))
# the sample is taken from stored shots, so that a team's rows beyond it need not be shuffled
star("Q17")(lambda t: shots.shot_sample(t, shots=stored(shots.sampled_shots(t), "shots")))
star("Q17_small")(lambda t: shots.shot_sample(t, max_points=20, shots=stored(shots.sampled_shots(t), "shots")))
star("Q18")(lambda t: shots.shot_zones(with_league(t, ShotFilters())))
star("Q19")(shots.shot_profile)
star("Q20")(lambda t: shots.best_lowest_area(shots.shot_profile(t)))
star("Q35")(lambda t: shots.shot_heatmap(shots.subject_shots(t)))
MONTHS = ShotFilters(date_from="1995-11-01", date_to="1996-02-29", action_type="Jump Shot")
star("Q17_filtered")(lambda t: shots.shot_sample(t, MONTHS, 20))
star("Q19_filtered")(lambda t: shots.shot_profile(t, MONTHS))
star("Q20_filtered")(lambda t: shots.best_lowest_area(shots.shot_profile(t, MONTHS)))
star("Q35_filtered")(lambda t: shots.shot_heatmap(shots.subject_shots(t, MONTHS)))
star("Q37")(shots.player_team_comparison)
star("Q14_order")(shots.export_positions)

# --- browse / paging -----------------------------------------------------------
from statlake.plans import browse  # noqa: E402

star("Q1")(browse.seasons)
star("Q2")(browse.dataset_status)
star("Q3")(browse.readiness)
star("Q4")(browse.teams)
star("Q7")(browse.players)
star("F6")(lambda t: browse.players(t, search="BOLT 1", limit=500))
star("Q1_order")(lambda t: browse.in_order(t.seasons, [F.col("id").desc()], "seasons-order"))
star("Q4_order")(lambda t: browse.in_order(t.teams, [F.col("full_name"), F.col("id")], "teams-order"))
star("Q7_deep")(lambda t: browse.players_page_at(t, limit=2, offset=1998))  # page 1,000
star("Q8")(lambda t: browse.player(t, 7))
star("Q10_page2")(lambda t: browse.player_game_log(t, limit=2, offset=2))
star("Q12_order")(lambda t: browse.in_order(shots.shot_action_types(t), [F.col("season"), F.col("action_type")], "actions-order"))
star("Q23_asc")(lambda t: browse.games_page(t, sort="asc", limit=20, offset=20))
star("Q26_page2")(lambda t: browse.team_game_stats_page(t, limit=10, offset=10))
star("Q27_page2")(lambda t: browse.player_game_stats_page(t, limit=3, offset=2))
star("Q10")(browse.player_game_log)
star("Q23")(browse.games_page)
star("Q24")(browse.game_details)
star("Q25")(browse.boxscore_players)
star("Q25_teams")(browse.boxscore_teams)
star("Q26")(browse.team_game_stats_page)
star("Q27")(browse.player_game_stats_page)
star("Q36")(browse.scoring_trend)
star("Q38")(browse.team_game_table)

# --- validation: contract (V), constraints (X), quality checks (D) ----------------
from statlake.operators import rules  # noqa: E402
from statlake.plans import quality  # noqa: E402


def _per_season(v):
    return v.groupBy("season").agg(F.count(F.lit(1)).alias("violations"))


# the rules run over tables with seeded faults (clean tables break none of them); the
# summaries V, X and D27 run over both
def _faulty_text(t):
    return seed_text_faults(rules.as_text(seed_faults(t)))


def _contract(raw):
    return rules.violation_counts(rules.contract_report(raw)).drop("detail")


for _rule in rules.TEXT_RULES:
    star(_rule.rule_id)(lambda t, _r=_rule: _per_season(_r.fn(_faulty_text(t))))
for _rule in [*rules.TYPED_RULES, rules.Rule("V16", rules.v16_home_flags), rules.Rule("V17", rules.v17_points)]:
    star(_rule.rule_id)(lambda t, _r=_rule: _per_season(_r.fn(rules.typed(_faulty_text(t)))))
star("V22")(lambda t: rules.v22_corrections(rules.typed(_faulty_text(t))))
star("V", staged=True)(lambda t: _contract(_faulty_text(t)))
star("V_clean", staged=True)(lambda t: _contract(rules.as_text(t)))
star("X")(lambda t: rules.constraint_counts(seed_faults(t)))
star("X_clean")(rules.constraint_counts)
for _cid, _fn in quality.CHECKS.items():
    star(_cid)(lambda t, _fn=_fn: _fn(seed_faults(t)))
star("D27", staged=True)(lambda t: quality.quality_report(seed_faults(t)))
star("D27_clean", staged=True)(quality.quality_report)

# --- official aggregate cross-check (G) ---------------------------------------------
from statlake.operators import crosscheck as cc  # noqa: E402


def _staged_feeds(lt, lp):
    """Provider feeds staged from the data: the local totals (``lt`` of teams, ``lp`` of players) in the provider layout with its
    typical one-count corrections (FGA/FG3A off by one on odd game counts, points off by one
    for every seventh team id, so that both tolerance paths run), a null total (every 13th id),
    ids left out (every 11th) and ids that only the feed has (every fifth again under a new id)."""
    odd = F.pmod(F.col("games_played"), F.lit(2))
    seventh = F.when(F.pmod(F.col("team_id"), F.lit(7)) == 0, 1).otherwise(0)
    teams = lt.withColumns({"fga": F.col("fga") + odd, "points": F.col("points") + seventh})
    players = lp.withColumn("fg3a", F.col("fg3a") + odd)
    return (cc.as_feed(_gaps(teams, lt, "team_id"), "team_id", "TEAM_ID", cc.TEAM_STATS),
            cc.as_feed(_gaps(players, lp, "player_id"), "player_id", "PLAYER_ID", cc.PLAYER_STATS))


def _crosschecked(t):
    """The cross-check against the staged feeds; the local totals are counted once, both sides read them."""
    totals = stored(cc.local_team_totals(t), "team-totals"), stored(cc.local_player_totals(t), "player-totals")
    return cc.crosscheck(t, *_staged_feeds(*totals), local=totals)


def _gaps(totals, local, idcol):
    every = lambda n: F.pmod(F.col(idcol), F.lit(n)) == 0
    kept = totals.where(~every(11)).withColumn("points", F.when(~every(13), F.col("points")))
    return kept.unionByName(local.where(every(5)).withColumn(idcol, F.col(idcol) + 9_000_000))


star("G1")(cc.local_team_totals)
star("G2")(cc.local_player_totals)
star("G4")(lambda t: _crosschecked(t))
star("G5")(lambda t: cc.report_counts(_crosschecked(t)))

# --- ETL transforms, end to end on provider-shaped rows (T) ---------------------------
from statlake.operators import transforms as tf  # noqa: E402
from statlake.sources.testviews import provider_feeds  # noqa: E402

star("T1")(lambda t: tf.transform_teams(provider_feeds(t)["teams"]))
star("T2")(lambda t: tf.transform_players(provider_feeds(t)["players"]))
star("T3")(lambda t: tf.transform_games(provider_feeds(t)["team_log"], F.col("season")))
star("T4")(lambda t: tf.transform_team_game_stats(provider_feeds(t)["team_log"], F.col("season")))
star("T5")(lambda t: tf.transform_player_game_stats(provider_feeds(t)["player_log"], F.col("season")))
star("T6")(lambda t: tf.transform_shot_attempts(provider_feeds(t)["shots"], F.col("season")))

# --- landing: ledger of sources, result-set documents, substring index (S7, S1, S6, F6) ---
from statlake.operators.substring import SubstringIndex  # noqa: E402
from statlake.sources import ledger as lg  # noqa: E402
from statlake.sources import resultset  # noqa: E402
from statlake.sources.resultset_split import read_resultset_split  # noqa: E402


@star("S7")
def _s7(t):
    """The ledger after three landings of the team log, a source per team and season: the even teams; all, where every
    fifth team's points were corrected; and all once more, which finds nothing to do."""
    spark = t.games.sparkSession
    feed = t.team_game_stats.select(
        F.concat_ws("/", "season", F.concat(F.lit("team-"), F.col("team_id").cast("string"))).alias("source"), "team_id",
        F.col("game_id").alias("GAME_ID"), F.col("points").alias("PTS"), F.col("rebounds").alias("REB"))
    corrected = feed.withColumn("PTS", F.col("PTS") + (F.col("team_id") % 5 == 0).cast("int")).drop("team_id")
    ledger = lg.LandingLedger(spark, shared_path(spark, "landing"))
    ledger.land(feed.where(F.col("team_id") % 2 == 0).drop("team_id"))
    ledger.land(corrected, take=lg.CHANGED)
    ledger.land(corrected)
    return ledger.latest()


def _team_documents(t) -> str:
    """Provider documents of the team log, one a team and season: the wanted result set comes second."""
    cells = F.array("GAME_ID", "TEAM_ID", "MATCHUP", "PTS")
    row = F.struct(F.col("GAME_ID").alias("k"), F.col("row_number").alias("n"), cells.alias("cells"))
    season_rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])  # a team's games of one season
    text = lambda *names: F.array(*[F.lit(n) for n in names])
    none = text().cast("array<array<string>>")
    document = F.to_json(F.struct(F.array(
        F.struct(F.lit("Parameters ]").alias("name"), text("[A]").alias("headers"), none.alias("rowSet")),
        F.struct(F.lit("TeamGameLogs").alias("name"), text("GAME_ID", "TEAM_ID", "MATCHUP", "PTS").alias("headers"),
                 F.col("rows").alias("rowSet"))).alias("resultSets")), {"ignoreNullFields": "false"})
    folder = shared_path(t.games.sparkSession, "documents")
    log = provider_feeds(t)["team_log"]
    (log.groupBy("season", F.col("TEAM_ID").alias("team")).agg(season_rows.alias("rows"))
     .select("season", "team", document.alias("document")).write.partitionBy("season", "team").text(folder))
    return folder


def _document_rows(rows):
    place = [F.regexp_extract("source_file", pattern, 1).alias(name) for pattern, name in
             ((r"season=([^/]+)", "season"), (r"team=([^/]+)", "requested"))]
    return resultset.columns(rows.select("*", *place), ["GAME_ID", "TEAM_ID", "MATCHUP", "PTS"], ("season", "requested", "row_number"))


@star("S1")
def _s1(t):
    return _document_rows(read_resultset_split(t.games.sparkSession, _team_documents(t), 1))


@star("S6")
def _s6(t):
    docs = resultset.read_documents(t.games.sparkSession, _team_documents(t))
    return _document_rows(resultset.combine_partitioned_extract(docs, resultset.requested_team_by_file(docs, r"team=(\d+)/"), 1))


@star("F6_index")
def _f6_index(t):
    """Players by pieces of other players' names, one to seven characters long, over the substring index."""
    spark = t.games.sparkSession
    index = SubstringIndex(spark, shared_path(spark, "substrings")).build(t.players, "full_name")
    terms = t.players.where(F.col("id") % 50 == 0).select(
        F.upper(F.substr(F.col("full_name"), (F.col("id") / 50 % 5 + 1).cast("int"), (F.col("id") / 50 % 7 + 1).cast("int"))).alias("term"))
    return index.search_all(t.players, "full_name", terms)


# --- table mutations and publication gates (K, M, U3, A14) --------------------------
from dataclasses import replace  # noqa: E402

from statlake.plans import publish as pub  # noqa: E402


def _latest_season(t) -> str:
    """The most recent season of the games table (one scalar read)."""
    return t.games.agg(F.max("season").alias("s")).first().s


def _k4(t):
    latest = _latest_season(t)
    refreshed = t.players.join(t.player_game_stats.where(F.col("season") == latest).select(
        F.col("player_id").alias("id")).distinct(), "id", "left_semi").withColumn("full_name", F.upper("full_name"))
    return pub.upsert(t.players, refreshed, ["id"])


star("K4")(_k4)
star("K5")(lambda t: pub.prune_not_in(t.players, t.player_game_stats.select(F.col("player_id").alias("id")), ["id"]))
star("K7")(lambda t: pub.delete_season_by_game(t, _latest_season(t)).shot_attempts)
def _k8(t):
    """A store with all seasons, the latest published anew with its even games; every table of the version that results."""
    spark, latest = t.games.sparkSession, _latest_season(t)
    store = pub.DatasetStore(spark, shared_path(spark, "store"))
    store.import_tables(t)
    t = store.read()  # what was imported: no table is made a second time
    games = t.games.where((F.col("season") == latest) & (F.substring("id", 4, 7).cast("bigint") % 2 == 0))
    kept = games.select(F.col("id").alias("game_id"))
    facts = {n: getattr(t, n).where(F.col("season") == latest).join(kept, "game_id", "left_semi") for n in pub.FACTS[1:]}
    seen = facts["player_game_stats"].select(F.col("player_id").alias("id")).distinct()
    players = t.players.join(seen, "id", "left_semi").withColumn("full_name", F.concat("full_name", F.lit(" II")))
    store.replace_season(replace(t, games=games, players=players, **facts), latest, manifest_sha256="a" * 64)
    v = store.read()

    def figures(name: str, key: str, figure) -> DataFrame:
        df = getattr(v, name)
        season_ = F.col("season") if "season" in df.columns else F.col("id") if name == "seasons" else F.lit(None)
        return df.select(F.lit(name).alias("table_name"), season_.cast("string").alias("season"), F.col(key).cast("string").alias("key"),
                         figure.cast("bigint").alias("figure"))

    rows = [figures("games", "id", F.col("home_score") - F.col("away_score")), figures("team_game_stats", "game_id", F.col("points")),
            figures("player_game_stats", "game_id", F.col("points")), figures("shot_attempts", "game_id", F.col("shot_made").cast("int")),
            figures("players", "id", F.length("full_name")), figures("seasons", "verification_status", F.col("games_count"))]
    return reduce(DataFrame.unionByName, rows).groupBy("table_name", "season", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("figure").alias("figure"))


star("K8", staged=True)(_k8)
star("M3")(lambda t: pub.integrity_violations(seed_faults(t)))
star("U3")(lambda t: pub.residue(t, _latest_season(t)))
star("A14")(pub.season_ids)
star("M6")(lambda t: pub.restored_matches(seed_seasons(t)))

# --- operational event jobs (R) -----------------------------------------------------
from statlake.plans.catalog import raw  # noqa: E402
from statlake.sources import testviews as tv  # noqa: E402
from statlake.streaming import events as ev  # noqa: E402

RATE_WINDOW_SECONDS = 86400
RATE_LIMIT = 2
RETENTION_DAYS = 30


@raw("R1")
def _r1(spark, sf_dir):
    accepted, _ = ev.usage_allowlist(tv.usage_events(spark, sf_dir))
    return ev.usage_counts(accepted)


@raw("R1_quarantine")
def _r1q(spark, sf_dir):
    return ev.usage_allowlist(tv.usage_events(spark, sf_dir))[1]


@raw("R2")
def _r2(spark, sf_dir):
    return ev.request_metrics(tv.request_log(spark, sf_dir))


from statlake.streaming import counts as ec  # noqa: E402


def _in_two_runs(df, partials) -> str:
    """The folder of counts after two runs of a stream over ``df``: the second brings the late rows (every 97th)."""
    spark, folder = df.sparkSession, shared_path(df.sparkSession, "stream")
    key = F.col(df.columns[0])
    for late in (False, True):
        df.where((key % 97 == 0) == F.lit(late)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        ec.land_batches(stream, f"{folder}/out", f"{folder}/checkpoint", partials).awaitTermination()
    return f"{folder}/out"


@raw("R1_stream")
def _r1_stream(spark, sf_dir):
    out = _in_two_runs(tv.usage_events(spark, sf_dir), ec.USAGE)
    ec.fold(spark, out, "usage", ec.merge_usage)
    return ec.merge_usage(ec.landed(spark, out, "usage"))


@raw("R1_stream_quarantine")
def _r1_stream_quarantine(spark, sf_dir):
    return ec.landed(spark, _in_two_runs(tv.usage_events(spark, sf_dir), ec.USAGE), "quarantine")


@raw("R2_stream")
def _r2_stream(spark, sf_dir):
    out = _in_two_runs(tv.request_log(spark, sf_dir), ec.REQUESTS)
    return ec.metrics_of_counts(ec.landed(spark, out, "latencies"))


@raw("R3")
def _r3(spark, sf_dir):
    return ev.rate_limit(tv.request_log(spark, sf_dir), RATE_WINDOW_SECONDS, RATE_LIMIT)


@raw("R4")
def _r4(spark, sf_dir):
    r = tv.request_log(spark, sf_dir)
    return r.select("request_id", ev.client_key(F.col("edge_header"), F.col("forwarded_for"), F.col("peer"),
                                                trusted_hops=1, trust_edge=True).alias("client_key"))


@raw("R5")
def _r5(spark, sf_dir):
    objects, pointers = tv.snapshot_listing(spark, sf_dir)
    now = F.lit(tv.listing_now(spark, sf_dir).isoformat(sep=" ")).cast("timestamp_ntz")
    return ev.expired_snapshots(objects, pointers, now, RETENTION_DAYS)


@raw("R6")
def _r6(spark, sf_dir):
    objects, pointers = tv.snapshot_listing(spark, sf_dir)
    now = F.lit(tv.listing_now(spark, sf_dir).isoformat(sep=" ")).cast("timestamp_ntz")
    return ev.snapshot_freshness(objects, pointers, now)

# --- scalar constructs over whole tables (C6, C7, C9, C10, C17, A18) --------------------
from statlake.functions import expr as fx  # noqa: E402

star("C6")(lambda t: t.seasons.select("id", fx.season_start_year("id").alias("start_year"),
                                      fx.season_end_year("id").alias("end_year"),
                                      fx.season_is_valid("id").alias("valid")))
star("C7")(lambda t: t.games.select("id", "game_date", fx.season_label("game_date").alias("season_label")))
star("C9")(lambda t: t.games.select(
    "id", "season", fx.break_end("season").alias("break_end"),
    F.when(F.col("game_date") < fx.break_end("season"), "Pre All-Star").otherwise("Post All-Star").alias("phase")))
star("C10")(lambda t: t.shot_attempts.select("game_id", "event_id", fx.normalized_zone("zone_basic").alias("area"),
                                             fx.points_value().alias("points_value")))
star("C17")(lambda t: t.shot_attempts.select("game_id", "event_id", fx.court_x("loc_x").alias("x"),
                                             fx.court_y("loc_y").alias("y")))
star("A18")(lambda t: seed_faults(t).shot_attempts.groupBy("season", "game_id", "player_id").agg(
    F.count_distinct("team_id").alias("teams")).where(F.col("teams") > 1))
star("W2")(lambda t: season.leaders(t, apply_minimum=False))


@raw("S8")
def _s8(spark, sf_dir):
    """S8 over the driver's own files: SHA-256 of every table file, hashed on the executors."""
    from statlake.sources import files as fs

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    d = fs.file_digests(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names])
    return d.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256")
