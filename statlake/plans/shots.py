"""Shot-chart analytics (Q11-Q20, Q35, Q37, K2) for every subject in one job.

Subjects are exploded per shot (one player row, one team row) so a single
grouped aggregate serves all players and teams; with a subject in the filters
only that subject's rows are produced. League baselines (context without the
subject) are taken from the team rows of the same aggregate when no subject is
given: each shot has exactly one team, so summing team rows is the league. The
baseline and the per-subject shares are windows over the aggregated rows, so
each plan is linear and the shot table is scanned once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlake.functions.expr import (
    THREE_POINT,
    area_sort_key,
    break_end,
    court_x,
    court_y,
    normalized_zone,
    points_value,
    ratio,
    ratio_dec,
)
from statlake.operators.joins import null_safe_join
from statlake.operators.positions import with_positions
from statlake.operators.shot_filters import SUBJECT, ShotFilters, enriched_shots, with_subjects
from statlake.sources.files import write_json_atomic
from statlake.sources.stored import stored
from statlake.sources.tables import Tables

ZONE = ["zone_basic", "zone_area", "zone_range"]
#: What a comparison of two subjects shows of each zone.
COMPARED = {"attempts": "bigint", "makes": "bigint", "fg_pct": "double", "frequency": "double", "points_per_shot": "double"}
EXPORT_COLUMNS = [
    "game_date", "game_id", "event_id", "player_id", "player_name", "team_id", "team_abbr", "opponent_id",
    "opponent_abbr", "season", "period", "minutes_remaining", "seconds_remaining", "action_type", "shot_type",
    "zone_basic", "zone_area", "zone_range", "shot_distance", "loc_x", "loc_y", "shot_made",
]
EXPORT_LIMIT = 20000


def _shot_aggs(dec: bool = False) -> list:
    n = F.count(F.lit(1))
    makes = F.count_if(F.col("shot_made"))
    pts = F.sum(points_value())
    r = ratio_dec if dec else ratio
    return [
        n.alias("attempts"),
        makes.alias("makes"),
        F.coalesce(pts, F.lit(0)).alias("points"),
        r(makes, n, 3).alias("fg_pct"),
        ratio(pts, n, 3).alias("points_per_shot"),
    ]


def subject_shots(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    return with_subjects(enriched_shots(t).where(f.subject()), f)


def league_context(t: Tables, f: ShotFilters = ShotFilters(), by: list[str] | None = None) -> DataFrame:
    """Q16: league fg_pct per season (and ``by``) under the context predicates only; from the stored baseline if there is one."""
    keys = ["season"] + (by or [])
    if t.league is not None:
        return t.league.where(f.context(stored=True)).groupBy(*keys).agg(
            ratio_dec(F.sum("makes"), F.sum("attempts"), 3).alias("league_fg_pct"))
    ctx = enriched_shots(t).where(f.context())
    n = F.count(F.lit(1))
    return ctx.groupBy(*keys).agg(ratio_dec(F.count_if(F.col("shot_made")), n, 3).alias("league_fg_pct"))


def _with_league(agg: DataFrame, t: Tables, f: ShotFilters, by: list[str]) -> DataFrame:
    """Attach the league baseline (context without subject, no ``made`` filter).

    The league is its own grouped aggregate over the stored baseline (without
    one, over the context shots), combined map-side to one row per (season,
    ``by``) and joined back as a small table.
    (A window over the aggregated subject rows would read the shots once, but
    it puts every subject of a season -- or season and zone -- into one task.)
    """
    return null_safe_join(agg, league_context(t, f, by), ["season", *by], "left")


def shot_summary(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q15: attempts, makes, points, fg_pct, points_per_shot per subject, plus the league
    fg_pct and the difference (both null when ``made`` is filtered, as in the product)."""
    agg = subject_shots(t, f).groupBy(*SUBJECT).agg(*_shot_aggs(dec=True))
    if f.made is None:
        out = _with_league(agg, t, f, [])
        diff = (F.col("fg_pct") - F.col("league_fg_pct")).cast("double")
    else:
        out = agg.withColumn("league_fg_pct", F.lit(None).cast("decimal(10,3)"))
        diff = F.lit(None).cast("double")
    return out.select(
        *SUBJECT, "attempts", "makes", "points", F.col("fg_pct").cast("double").alias("fg_pct"), "points_per_shot",
        F.col("league_fg_pct").cast("double").alias("league_fg_pct"), diff.alias("fg_pct_vs_league"),
    )


def league_shot_context(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q16 as a query: one row per season."""
    return league_context(t, f).select("season", F.col("league_fg_pct").cast("double").alias("league_fg_pct"))


#: What a sample shows of a shot beside its place in it.
SAMPLED = ["game_id", "event_id", "player_id", "player_name", "team_id", "team_abbr", "opponent_id", "opponent_abbr", "period",
           "minutes_remaining", "seconds_remaining", "action_type", "shot_type", *ZONE, "shot_distance", "loc_x", "loc_y", "shot_made"]


def sampled_shots(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """The shots that Q17 samples."""
    return enriched_shots(t).where(f.subject()).select("season", *SAMPLED)


def _first_by_key(rows: DataFrame, subject: list[str], k: int) -> DataFrame:
    """``rows`` up to the first three digits of their subject's ``k``-th least ``sample_key``; the heads of all rows are counted."""
    head = F.coalesce(F.conv(F.substring(F.hex("sample_key"), 1, 3), 16, 10).cast("int"), F.lit(-1))
    below = F.sum("count").over(Window.partitionBy(*subject).orderBy("head"))
    heads = rows.groupBy(*subject, head.alias("head")).count().withColumn("below", below)
    last = heads.where(F.col("below") >= k).groupBy(*subject).agg(F.min("head").alias("last"))
    # one row a subject: broadcast, since a sorted join would shuffle the rows that are to be left out
    kept = null_safe_join(rows, F.broadcast(last), subject, "left")
    return kept.where(F.col("last").isNull() | (head <= F.col("last"))).drop("last")


def shot_sample(t: Tables, f: ShotFilters = ShotFilters(), max_points: int = 2500, shots: DataFrame | None = None) -> DataFrame:
    """Q17: per subject the first ``max_points`` attempts by md5(game_id:event_id), and
    ``truncated`` = subject total > max_points.

    ``row_number() <= k + 1`` per subject is planned with a partial
    WindowGroupLimit ahead of the one shuffle, so each task ships at most k + 1
    rows per subject, and a subject's task gets at most k + 1 rows of each; the
    row beyond the sample is the one sign that it is cut, so the shots are read
    once. The id is the first key: it tells rows apart in the first eight bytes
    that a sort compares, where most seasons and types are alike.

    ``shots``: :func:`sampled_shots`, stored. They can be read twice, so the
    key heads of each team are counted first, and of a team's rows only those
    up to the head that holds its (k + 1)-th key are shuffled.
    """
    if max_points < 1:
        raise ValueError("max_points must be positive")
    # 16 bytes, which sort like the 32 digits
    key = F.unhex(F.md5(F.concat(F.col("game_id"), F.lit(":"), F.col("event_id").cast("string"))))
    rows = (sampled_shots(t, f) if shots is None else shots).withColumn("sample_key", key)
    if shots is None or f.has_subject:
        s = with_subjects(rows, f)
    else:
        teams = _first_by_key(rows, ["season", "team_id"], max_points + 1)
        s = rows.withColumns({"subject_type": F.lit("player"), "subject_id": F.col("player_id")}).unionByName(
            teams.withColumns({"subject_type": F.lit("team"), "subject_id": F.col("team_id")}))
    subject = Window.partitionBy("subject_id", "season", "subject_type")
    w = subject.orderBy("sample_key")
    # one row beyond the sample tells whether the subject has more than that
    sample = s.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= max_points + 1)
    sample = sample.withColumn("truncated", F.max("sample_rank").over(subject) > max_points)
    return sample.where(F.col("sample_rank") <= max_points).select(
        *SUBJECT, F.col("sample_rank").cast("bigint").alias("sample_rank"), *SAMPLED, "truncated")


def shot_zones(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q18: per subject and 3-part zone: counts, fg_pct, pps, frequency, league fg_pct, difference."""
    agg = subject_shots(t, f).groupBy(*SUBJECT, *ZONE).agg(*_shot_aggs(dec=True))
    total = F.sum("attempts").over(Window.partitionBy(*SUBJECT))
    out = agg.withColumn("frequency", F.coalesce(ratio(F.col("attempts"), total, 3), F.lit(0.0)))
    if f.made is None:
        out = _with_league(out, t, f, ZONE)
        diff = (F.col("fg_pct") - F.col("league_fg_pct")).cast("double")
    else:
        out = out.withColumn("league_fg_pct", F.lit(None).cast("decimal(10,3)"))
        diff = F.lit(None).cast("double")
    return out.select(
        *SUBJECT, *ZONE, "attempts", "makes", "points", F.col("fg_pct").cast("double").alias("fg_pct"),
        "points_per_shot", "frequency", F.col("league_fg_pct").cast("double").alias("league_fg_pct"),
        diff.alias("fg_pct_vs_league"),
    )


#: The splits of a shot profile, in the order of a shot's ``keys``.
SPLITS = ("zone", "venue", "month", "opponent", "season_phase")


def _split_sums(rows: DataFrame, subject_type: str, counted: str, key: Column, *split: str) -> DataFrame:
    """Sums per subject, season, ``split`` and key, and ``every``, the attempts of all keys beside it."""
    # the id comes first: it tells rows apart in the first eight bytes that a sort compares
    sums = rows.groupBy("subject_id", "season", *split, "key").agg(
        key.alias("k"),
        F.count(counted).alias("attempts"),
        F.count_if(F.col("shot_made")).alias("makes"),
        F.sum("pv").alias("pts"),
        F.count_if(F.col("made3")).alias("made3"),
    )
    every = F.sum("attempts").over(Window.partitionBy("subject_id", "season", *split))
    return sums.withColumn("every", every).withColumn("subject_type", F.lit(subject_type))


def shot_profile(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q19: five splits (zone, venue, month, opponent, season_phase), the shots read once.

    A shot carries its five keys as text -- the area or opponent name, the
    month as yyyymm, 0/1 flags for venue and phase -- and the labels and sort
    keys (each a function of its key) are derived after the aggregation. Shots
    are dealt by player and season once. Hardly two shots of a task share a
    player's key, so nothing is gained by adding up players before that; after
    it each split is a sorted aggregate of its own over the same exchange, so a
    task holds a shot once and never five times. Teams are few: their splits
    are added up where the shots lie.
    """
    pre = F.coalesce(F.col("game_date") < break_end("season"), F.lit(False))
    keys = F.array(
        normalized_zone("zone_basic"),
        (F.col("venue") == "Home").cast("int").cast("string"),
        (F.year("game_date") * 100 + F.month("game_date")).cast("string"),
        F.col("opponent_name"),
        pre.cast("int").cast("string"),
    )
    base = enriched_shots(t).where(f.subject()).select(
        "season", "player_id", "team_id", "shot_made",
        (F.col("shot_made") & (F.col("shot_type") == THREE_POINT)).alias("made3"),
        points_value().alias("pv"), keys.alias("keys"),
    )
    parts = []
    if f.team_id is None:
        base = base.repartition("player_id", "season")
        # every reader takes all columns of the exchange (a shot always has a team: counting that counts the shots), so one serves all
        for d in range(len(SPLITS)):
            shots = base.select("season", F.col("player_id").alias("subject_id"), "team_id", "shot_made", "made3", "pv",
                                F.col("keys")[d].alias("key"))
            # a text aggregate is a sorted one (the greatest key is the key): no hash map, and its order is also the window's
            parts.append(_split_sums(shots, "player", "team_id", F.max("key")).withColumn("d", F.lit(d)))
    if f.player_id is None:
        splits = F.array(*[F.struct(F.lit(d).alias("d"), F.col("keys")[d].alias("key")) for d in range(len(SPLITS))])
        shots = base.select("season", F.col("team_id").alias("subject_id"), "player_id", "shot_made", "made3", "pv", F.inline(splits))
        parts.append(_split_sums(shots, "team", "player_id", F.col("key"), "d"))
    agg = reduce(DataFrame.unionByName, parts)
    d, k, flag = F.col("d"), F.col("k"), F.col("k") == "1"
    ym = F.when(d == 2, k).cast("int")
    month = F.make_date((ym / 100).cast("int"), ym % 100, F.lit(1))
    dimension = F.when(d == 0, SPLITS[0]).when(d == 1, SPLITS[1]).when(d == 2, SPLITS[2]).when(d == 3, SPLITS[3]).otherwise(SPLITS[4])
    label = (F.when(d == 0, k).when(d == 1, F.when(flag, "Home").otherwise("Away"))
             .when(d == 2, F.date_format(month, "MMM yyyy")).when(d == 3, k)
             .otherwise(F.when(flag, "Pre All-Star").otherwise("Post All-Star")))
    sort_key = (F.when(d == 0, area_sort_key(k)).when(d == 1, F.when(flag, "1").otherwise("2"))
                .when(d == 2, F.date_format(month, "yyyy-MM")).when(d == 3, k)
                .otherwise(F.when(flag, "1").otherwise("2")))
    n, makes = F.col("attempts"), F.col("makes")
    return agg.select(
        *SUBJECT, dimension.alias("dimension"), label.alias("label"), sort_key.alias("sort_key"), "attempts", "makes",
        F.coalesce(F.col("pts"), F.lit(0)).alias("points"),
        ratio(makes, n, 3).alias("fg_pct"),
        ratio(n, F.col("every"), 3).alias("frequency"),
        ratio(F.col("pts"), n, 3).alias("points_per_shot"),
        ratio(makes * 2 + F.col("made3"), n * 2, 3).alias("efg_pct"),
    )


def best_lowest_area(profile: DataFrame) -> DataFrame:
    """Q20: guarded arg-max / arg-min of points per shot among the zone rows of Q19.

    Eligible zones have >= max(10, round_half_even(2% of the subject's zone
    attempts)); the lowest is reported only with more than one eligible zone;
    ties go to the first zone in (sort_key, label) order; null pps counts as 0.
    """
    z = profile.where(F.col("dimension") == "zone")
    subject = Window.partitionBy(*SUBJECT)
    total = F.sum("attempts").over(subject)
    minimum = F.greatest(F.lit(10).cast("decimal(20,0)"),
                         F.bround(total.cast("decimal(20,0)") * F.lit(0.02).cast("decimal(3,2)"), 0))
    e = z.withColumn("minimum_attempts", minimum.cast("bigint")).where(F.col("attempts") >= F.col("minimum_attempts"))
    pps = F.coalesce(F.col("points_per_shot"), F.lit(0.0))
    e = (
        e.withColumn("eligible", F.count(F.lit(1)).over(subject))
        .withColumn("hi", F.row_number().over(subject.orderBy(pps.desc(), "sort_key", "label")))
        .withColumn("lo", F.row_number().over(subject.orderBy(pps.asc(), "sort_key", "label")))
    )
    return e.groupBy(*SUBJECT).agg(
        F.first("minimum_attempts").alias("minimum_attempts"),
        F.first("eligible").alias("eligible_zones"),
        F.max(F.when(F.col("hi") == 1, F.col("label"))).alias("best_area"),
        F.max(F.when(F.col("hi") == 1, F.col("points_per_shot"))).alias("best_points_per_shot"),
        F.max(F.when((F.col("lo") == 1) & (F.col("eligible") > 1), F.col("label"))).alias("lowest_area"),
        F.max(F.when((F.col("lo") == 1) & (F.col("eligible") > 1), F.col("points_per_shot"))).alias("lowest_points_per_shot"),
    )


def shot_heatmap(sample: DataFrame) -> DataFrame:
    """Q35 (A19): bin a subject's shots into 32-unit court cells (all attempts, or a Q17 sample).

    radius = 7 + 18*sqrt(n/max), opacity = 0.18 + 0.55*n/max, max per subject
    (taken over the binned cells, so the window sees at most ~270 rows).
    """
    cells = sample.select(
        *SUBJECT,
        F.floor(court_x("loc_x") / 32).cast("int").alias("cell_col"),
        F.floor(court_y("loc_y") / 32).cast("int").alias("cell_row"),
    ).groupBy(*SUBJECT, "cell_col", "cell_row").agg(F.count(F.lit(1)).alias("attempts"))
    mx = F.greatest(F.max("attempts").over(Window.partitionBy(*SUBJECT)), F.lit(1))
    share = F.col("attempts").cast("double") / mx.cast("double")
    return cells.select(
        *SUBJECT, "cell_col", "cell_row", "attempts",
        (F.col("cell_col") * 32 + 16).alias("cx"), (F.col("cell_row") * 32 + 16).alias("cy"),
        (F.lit(7.0) + F.lit(18.0) * F.sqrt(share)).alias("radius"),
        (F.lit(0.18) + F.lit(0.55) * share).alias("opacity"),
    )


def shot_compare(zones: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q37 (J18): align two subjects' zone tables on the union of their zone keys.

    ``pairs`` has (season, a_type, a_id, b_type, b_id). Each side is joined to
    its subject's zone rows, then a full outer join on (pair, zone) keeps zones
    that only one subject has.
    """
    pair_keys = ["season", "a_type", "a_id", "b_type", "b_id"]

    def side(prefix: str) -> DataFrame:
        z = zones.select(
            "season", F.col("subject_type").alias(f"{prefix}_type"), F.col("subject_id").alias(f"{prefix}_id"),
            *ZONE, *[F.col(c).alias(f"{prefix}_{c}") for c in COMPARED],
        )
        return pairs.join(z, ["season", f"{prefix}_type", f"{prefix}_id"])

    return side("a").join(side("b"), pair_keys + ZONE, "full")


def player_team_pairs(t: Tables) -> DataFrame:
    """Pairs for Q37: every player against each team they shot for in a season."""
    return t.shot_attempts.select(
        "season", F.lit("player").alias("a_type"), F.col("player_id").alias("a_id"),
        F.lit("team").alias("b_type"), F.col("team_id").alias("b_id"),
    ).distinct()


def _zone_stats(counts: DataFrame, subject: str, *more: Column) -> DataFrame:
    """Zone rows of one kind of subject from counts per (season, player, team, zone), and further aggregates."""
    sums = counts.groupBy("season", F.col(subject).alias("subject_id"), *ZONE).agg(
        *[F.sum(c).alias(c) for c in ("attempts", "makes", "points")], *more)
    total = F.sum("attempts").over(Window.partitionBy("season", "subject_id"))
    n = F.col("attempts")
    return sums.withColumns({"fg_pct": ratio(F.col("makes"), n, 3), "frequency": F.coalesce(ratio(n, total, 3), F.lit(0.0)),
                             "points_per_shot": ratio(F.col("points"), n, 3)})


def _zone_key() -> Column:
    """One text that tells zones apart; null where a part is null (such a zone matches nothing)."""
    sized = [F.concat(F.length(z).cast("string"), F.lit(":"), F.col(z)) for z in ZONE]
    return F.concat(*sized)


def _zone_list(zones: DataFrame, subject: str, name: str, *more: Column) -> DataFrame:
    """One row per season and subject with its zones as the list ``name`` and their keys as ``name``_keys."""
    rows = zones.withColumn("key", _zone_key()).groupBy("season", F.col("subject_id").alias(subject)).agg(
        F.collect_list(F.struct("key", *ZONE, *COMPARED)).alias(name), *more)
    return rows.withColumn(f"{name}_keys", F.col(name)["key"])


def _aligned(pairs: DataFrame) -> DataFrame:
    """Pairs with their zone lists ``a`` and ``b``, on the union of their zones (a null part matches nothing), as a full join gives them.

    A row is made for every zone of ``b`` and for those of ``a`` that ``b``
    lacks (``i``: which); the former then find theirs in ``a`` by its key.
    """
    zone = lambda at: [at[z].alias(z) for z in ZONE]
    none = [F.lit(None).cast(kind).alias(f"b_{c}") for c, kind in COMPARED.items()]
    lacks = F.filter(F.transform("a", lambda x, i: F.struct(x["key"].alias("key"), (i + 1).cast("bigint").alias("i"), *zone(x), *none)),
                     lambda x: x["key"].isNull() | ~F.array_contains(F.col("b_keys"), x["key"]))
    # a column of its own, and one list after the other: Spark generates code for both generators then, and copies no list
    lists = pairs.withColumn("lacks", lacks).select("season", "a_id", "b_id", "a", "a_keys", F.explode(F.array("b_rows", "lacks")).alias("rows"))
    of_a = F.get("a", F.coalesce("i", F.array_position("a_keys", F.col("key")), F.lit(0)).cast("int") - 1)
    rows = lists.select("season", "a_id", "b_id", "a", "a_keys", F.inline("rows")).withColumn("of_a", of_a)
    return rows.select("season", "a_id", "b_id", *ZONE, *[F.col("of_a")[c].alias(f"a_{c}") for c in COMPARED], *[f"b_{c}" for c in COMPARED])


def player_team_comparison(t: Tables) -> DataFrame:
    """Q37 for every player against each team they shot for in a season.

    The shots are counted once per (season, player, team, zone) and stored. The
    counts are dealt by player once: a player's zones, as a list, and their
    teams come from there, and a team's zones are a list broadcast to them (one
    row per season and team), so the result, some 20 rows a pair, is made where
    the player's row lies and never shuffled.
    """
    counts = stored(enriched_shots(t).groupBy("season", "player_id", "team_id", *ZONE).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("shot_made")).alias("makes"), F.sum(points_value()).alias("points")), "zone-counts")
    of_players = _zone_stats(counts.repartition("season", "player_id"), "player_id", F.collect_set("team_id").alias("teams"))
    players = _zone_list(of_players, "a_id", "a", F.array_distinct(F.flatten(F.collect_list("teams"))).alias("teams"))
    teams = _zone_list(_zone_stats(counts, "team_id"), "b_id", "b")
    b_rows = F.transform("b", lambda y: F.struct(y["key"].alias("key"), F.lit(None).cast("bigint").alias("i"), *[y[z].alias(z) for z in ZONE],
                                                 *[y[c].alias(f"b_{c}") for c in COMPARED]))
    teams = teams.select("season", "b_id", "b_keys", b_rows.alias("b_rows"))
    pairs = players.select("season", "a_id", "a", "a_keys", F.explode("teams").alias("b_id")).join(F.broadcast(teams), ["season", "b_id"])
    both = [f"{prefix}_{c}" for prefix in "ab" for c in COMPARED]
    return _aligned(pairs).select("season", F.lit("player").alias("a_type"), "a_id", F.lit("team").alias("b_type"), "b_id", *ZONE, *both)


def shot_players(t: Tables) -> DataFrame:
    """Q11: per season, players having attempts (EXISTS -> semi join on (season, player))."""
    having = t.shot_attempts.select("season", F.col("player_id").alias("id")).distinct()
    return t.players.join(having, "id").select("season", "id", "full_name", "first_name", "last_name", "is_active")


def shot_action_types(t: Tables) -> DataFrame:
    """Q12: distinct action types per season."""
    return t.shot_attempts.select("season", "action_type").distinct()


def shot_games(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q13: per subject, the games where it has attempts, with both team names."""
    s = with_subjects(t.shot_attempts.where(f.subject()) if f.has_subject else t.shot_attempts, f)
    keys = s.select("subject_type", "subject_id", "game_id").distinct()
    ht = t.teams.select(F.col("id").alias("home_team_id"), F.col("full_name").alias("home_team"))
    at = t.teams.select(F.col("id").alias("away_team_id"), F.col("full_name").alias("away_team"))
    g = t.games.withColumnRenamed("id", "game_id").join(ht, "home_team_id").join(at, "away_team_id")
    if f.season is not None:
        g = g.where(F.col("season") == f.season)
    return keys.join(g, "game_id").select(
        "season", "subject_type", "subject_id", "game_id", "game_date", "home_team_id", "away_team_id",
        "home_score", "away_score", "home_team", "away_team",
    )


def shot_export_rows(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q14/K2 rows: the 22 export columns for every matching attempt."""
    return enriched_shots(t).where(f.subject()).select(*EXPORT_COLUMNS)


EXPORT_ORDER = ["game_date", "game_id", "event_id"]


def export_shots(t: Tables, f: ShotFilters, path: str, max_rows: int | None = None) -> list[dict]:
    """K2: the matching attempts as CSV part files in order, with ``_parts.json`` beside them.

    The rows are range-partitioned and sorted, so any number of tasks write
    them, and part after part they are in order. The list of parts, also
    returned, gives each file's rows, the rows before it and its first and
    last key; it is read from the written files. More than ``max_rows`` rows
    are refused (counted with a limit, so the check never scans past it).
    """
    spark = t.shot_attempts.sparkSession
    rows = shot_export_rows(t, f)
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise OverflowError(f"more than {max_rows} rows to export")
    rows.repartitionByRange(*EXPORT_ORDER).sortWithinPartitions(*EXPORT_ORDER).write.mode("overwrite").option("header", True).csv(path)
    text = ", ".join(f"{c} {'int' if c == 'event_id' else 'string'}" for c in EXPORT_COLUMNS)
    written = spark.read.option("header", True).schema(text).csv(path)
    parts = (written.groupBy(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"))
             .agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*EXPORT_ORDER)).alias("first"), F.max(F.struct(*EXPORT_ORDER)).alias("last"))
             .orderBy("first").collect())  # one row a file
    listed, before = [], 0
    for p in parts:
        listed.append({"file": p["file"], "rows": p["rows"], "offset": before, "first": list(p["first"]), "last": list(p["last"])})
        before += p["rows"]
    write_json_atomic(spark, f"{path.rstrip('/')}/_parts.json", {"parts": listed, "rows": before, "order": EXPORT_ORDER})
    return listed


def export_shots_csv(t: Tables, f: ShotFilters, path: str) -> int:
    """K2 in the product's form: one subject, at most EXPORT_LIMIT rows (header even when empty); the number of rows."""
    f.require_subject()
    return sum(p["rows"] for p in export_shots(t, f, path, EXPORT_LIMIT))


def export_positions(t: Tables, f: ShotFilters = ShotFilters()) -> DataFrame:
    """Q14 in order: the export rows with ``position`` over all parts (and ``total``).

    The rows are stored before they are sorted: a file of columns takes a
    quarter of the disk of the exchanges behind it, which are gone by the time
    the sort deals the rows out, and the sort's sampling runs no join again.
    """
    return with_positions(stored(shot_export_rows(t, f), "export-rows"), [F.col(c) for c in EXPORT_ORDER], "export")
