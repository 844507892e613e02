"""Season analytics over the star schema: standings, summaries, averages, leaders.

Every function computes the answer for *all* teams/players/seasons in one job
(grouped by the subject keys); the per-subject form of the product is a filter
on the result, which Catalyst pushes below the aggregation where it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statlake.functions.expr import STAT_CATEGORIES, avg_round, efg, ratio
from statlake.operators.legs import team_legs, with_recency
from statlake.sources.tables import Tables


def _won(team: str = "team_score", opp: str = "opponent_score") -> F.Column:
    return F.col(team) > F.col(opp)


def _lost(team: str = "team_score", opp: str = "opponent_score") -> F.Column:
    return F.col(team) < F.col(opp)


def standings(t: Tables, season: str | None = None) -> DataFrame:
    """Q29: wins, losses, win_pct = W/(W+L) (0 when none); tied games count neither."""
    legs = team_legs(t.games.where(F.col("season") == season) if season else t.games)
    agg = legs.groupBy("season", "team_id").agg(
        F.count_if(_won()).alias("wins"), F.count_if(_lost()).alias("losses")
    )
    teams = t.teams.select(F.col("id").alias("team_id"), F.col("full_name").alias("team_name"), "abbreviation")
    return agg.join(teams, "team_id").select(
        "team_id", "team_name", "abbreviation", "season", "wins", "losses",
        F.coalesce(ratio(F.col("wins"), F.col("wins") + F.col("losses"), 3), F.lit(0.0)).alias("win_pct"),
    )


def standings_in_order(t: Tables) -> DataFrame:
    """Q29 with each team's ``position`` in its season (wins, then fewer losses, name, id)."""
    order = Window.partitionBy("season").orderBy(F.col("wins").desc(), "losses", "team_name", "team_id")
    return standings(t).withColumn("position", F.row_number().over(order).cast("bigint"))


def standings_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("wins").desc(), F.col("losses").asc(), "team_name", "team_id")


def team_standings_view(t: Tables) -> DataFrame:
    """Q30 vw_team_standings: as Q29 for every season, but win_pct = W/COUNT(*)."""
    legs = team_legs(t.games)
    agg = legs.groupBy("season", "team_id").agg(
        F.count_if(_won()).alias("wins"), F.count_if(_lost()).alias("losses"), F.count(F.lit(1)).alias("n")
    )
    teams = t.teams.select(F.col("id").alias("team_id"), F.col("full_name").alias("team_name"), "abbreviation")
    return agg.join(teams, "team_id").select(
        "team_id", "team_name", "abbreviation", "season", "wins", "losses",
        ratio(F.col("wins"), F.col("n"), 3).alias("win_pct"),
    )


def team_season_summary(t: Tables) -> DataFrame:
    """Q5 for every (season, team): record, splits, last-10, per-game and shooting rates.

    Plan: games -> two legs (explode) -> join own box-score row (game_id,
    team_id) and the other team's row (same game, team_id <>) -> left join the
    last-10 flag (group-limited top-k of the legs) -> one grouped aggregate.
    """
    legs = team_legs(t.games)
    tgs = t.team_game_stats
    own = tgs.select("game_id", "team_id", "points", "rebounds", "assists", "steals", "blocks",
                     "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")
    other = tgs.select("game_id", F.col("team_id").alias("other_team_id"), F.col("points").alias("opp_points"))
    j = legs.join(own, ["game_id", "team_id"]).join(other, "game_id").where(F.col("other_team_id") != F.col("team_id"))
    # last 10: a group-limited top-k of the legs (partial top-k before the shuffle, so no
    # window holds a team-season's games), at most 10 keys per team-season, joined back as a flag
    recent = (with_recency(legs).where(F.col("recency") <= 10)
              .select("game_id", "team_id", F.lit(True).alias("recent")))
    j = j.join(recent, ["game_id", "team_id"], "left")
    won, lost, home, last10 = _won(), _lost(), F.col("is_home"), F.col("recent").isNotNull()
    n = F.count(F.lit(1))
    return j.groupBy("season", "team_id").agg(
        n.alias("games_played"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        ratio(F.count_if(won), n, 3).alias("win_pct"),
        F.count_if(home & won).alias("home_wins"),
        F.count_if(home & lost).alias("home_losses"),
        F.count_if(~home & won).alias("away_wins"),
        F.count_if(~home & lost).alias("away_losses"),
        avg_round("points").alias("ppg"),
        avg_round("opp_points").alias("opponent_ppg"),
        avg_round(F.col("team_score") - F.col("opponent_score")).alias("point_diff"),
        F.count_if(last10 & won).alias("last_10_wins"),
        F.count_if(last10 & lost).alias("last_10_losses"),
        avg_round("rebounds").alias("rpg"),
        avg_round("assists").alias("apg"),
        avg_round("steals").alias("spg"),
        avg_round("blocks").alias("bpg"),
        ratio(F.sum("fgm"), F.sum("fga")).alias("fg_pct"),
        ratio(F.sum("fg3m"), F.sum("fg3a")).alias("fg3_pct"),
        ratio(F.sum("ftm"), F.sum("fta")).alias("ft_pct"),
        efg(F.sum("fgm"), F.sum("fg3m"), F.sum("fga")).alias("efg_pct"),
    )


def _player_rates(played: DataFrame, keys: list[str]) -> DataFrame:
    return played.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games_played"),
        avg_round("minutes").alias("mpg"),
        avg_round("points").alias("ppg"),
        avg_round("rebounds").alias("rpg"),
        avg_round("assists").alias("apg"),
        avg_round("steals").alias("spg"),
        avg_round("blocks").alias("bpg"),
        ratio(F.sum("fgm"), F.sum("fga")).alias("fg_pct"),
        ratio(F.sum("fg3m"), F.sum("fg3a")).alias("fg3_pct"),
        ratio(F.sum("ftm"), F.sum("fta")).alias("ft_pct"),
    )


def _played_with_dates(t: Tables) -> DataFrame:
    """Non-DNP player rows with their game's date and whether the game and the team exist.

    Left joins: a row without a game (or team) keeps its stats but cannot be
    anyone's latest appearance. ``games`` and ``teams`` are dimensions keyed by
    their primary key, so the joins never multiply rows.
    """
    played = t.player_game_stats.where(F.col("minutes").isNotNull())
    g = t.games.select(F.col("id").alias("game_id"), "game_date", F.lit(True).alias("has_game"))
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("row_team_abbr"))
    return played.join(g, "game_id", "left").join(tm, "team_id", "left")


def _latest_team_agg(require_team: bool) -> F.Column:
    """W4 inside the same aggregate: (team_id, team_abbr) of the latest appearance.

    Latest = greatest (game_date, game_id) among rows whose game exists; a null
    date sorts lowest (DESC NULLS LAST). Rows without a game get a null ordering,
    which ``max_by`` skips. ``require_team`` also skips rows whose team is not in
    ``teams`` (the team join sits inside the latest-row pick); otherwise the
    latest row is picked first and an unknown team yields a null abbreviation.
    """
    eligible = F.col("has_game").isNotNull()
    if require_team:
        eligible = eligible & F.col("row_team_abbr").isNotNull()
    return F.max_by(F.struct(F.col("team_id"), F.col("row_team_abbr").alias("team_abbr")),
                    F.when(eligible, F.struct("game_date", "game_id"))).alias("latest")


def _player_season_averages(t: Tables, require_team: bool) -> DataFrame:
    # dealt first: the latest team makes it a sorted aggregate, and a player's few games lie in many parts, so adding up
    # before the exchange would sort every row twice and save none
    rows = _played_with_dates(t).repartition("player_id", "season")
    rates = rows.groupBy("player_id", "season").agg(
        F.count(F.lit(1)).alias("games_played"),
        avg_round("minutes").alias("mpg"),
        avg_round("points").alias("ppg"),
        avg_round("rebounds").alias("rpg"),
        avg_round("assists").alias("apg"),
        avg_round("steals").alias("spg"),
        avg_round("blocks").alias("bpg"),
        ratio(F.sum("fgm"), F.sum("fga")).alias("fg_pct"),
        ratio(F.sum("fg3m"), F.sum("fg3a")).alias("fg3_pct"),
        ratio(F.sum("ftm"), F.sum("fta")).alias("ft_pct"),
        _latest_team_agg(require_team),
    ).where(F.col("latest.team_abbr").isNotNull())
    players = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    return (
        rates.join(players, "player_id")
        .select("player_id", "player_name", "season", F.col("latest.team_id").alias("team_id"),
                F.col("latest.team_abbr").alias("team_abbr"), "games_played", "mpg", "ppg",
                "rpg", "apg", "spg", "bpg", "fg_pct", "fg3_pct", "ft_pct")
    )


def player_season_averages(t: Tables) -> DataFrame:
    """Q9 for every (player, season): averages over all teams, labelled with the latest team.

    Averages and the latest team come from one grouped aggregate over the
    player rows joined to their game dates and team labels (one scan, one
    shuffle; both dimensions are keyed lookups).
    """
    return _player_season_averages(t, require_team=True)


def player_season_averages_view(t: Tables) -> DataFrame:
    """Q31 vw_player_season_averages: latest appearance first, then its team (no team_id column)."""
    return _player_season_averages(t, require_team=False).select(
        "player_id", "player_name", "season", "team_abbr", "games_played", "ppg", "rpg", "apg", "spg", "bpg",
        "fg_pct", "fg3_pct", "ft_pct", "mpg",
    )


def team_players(t: Tables, limit: int = 15) -> DataFrame:
    """Q6: per (season, team) the top ``limit`` players by ppg (that team's games only, DNP excluded)."""
    played = t.player_game_stats.where(F.col("minutes").isNotNull())
    rates = played.groupBy("season", "team_id", "player_id").agg(
        F.count(F.lit(1)).alias("games_played"),
        avg_round("minutes").alias("mpg"),
        avg_round("points").alias("ppg"),
        avg_round("rebounds").alias("rpg"),
        avg_round("assists").alias("apg"),
        avg_round("steals").alias("spg"),
        avg_round("blocks").alias("bpg"),
    )
    players = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    w = Window.partitionBy("season", "team_id").orderBy(
        F.col("ppg").desc(), F.col("games_played").desc(), "player_name", "player_id")
    return (
        rates.join(players, "player_id")
        .withColumn("position", F.row_number().over(w).cast("bigint"))
        .where(F.col("position") <= limit)
        .select("season", "team_id", "position", "player_id", "player_name", "games_played", "mpg", "ppg",
                "rpg", "apg", "spg", "bpg")
    )


def minimum_games(t: Tables) -> DataFrame:
    """Per season, CEIL(MAX(team games) * 0.7) (exact decimal 0.7)."""
    per_team = t.team_game_stats.groupBy("season", "team_id").agg(F.count(F.lit(1)).alias("gp"))
    return per_team.groupBy("season").agg(
        F.ceil(F.max("gp").cast("decimal(20,0)") * F.lit(0.7).cast("decimal(2,1)")).cast("bigint").alias("minimum_games")
    )


def leaders(t: Tables, stats: tuple[str, ...] = STAT_CATEGORIES, limit: int = 10,
            apply_minimum: bool = True) -> DataFrame:
    """Q28 for every season and stat in one pass.

    The five stat columns are unpivoted into (stat, v) rows, so a single
    grouped aggregate computes every category; RANK is taken before the
    per-(season, stat) top-``limit`` cut. Seasons without team rows get
    minimum_games 0 (COALESCE in the product).

    ``apply_minimum=False`` ranks every player (the W2 construct: RANK with
    gaps taken before the top-``limit`` cut) without the games threshold.
    """
    # one aggregate per (season, player) with every category's sum and count and the
    # latest team, then the small aggregated rows are unpivoted into (stat, value)
    rows = _played_with_dates(t)
    per = rows.groupBy("season", "player_id").agg(
        F.count(F.lit(1)).alias("games_played"),
        *[F.sum(s).alias(f"sum_{s}") for s in stats], *[F.count(s).alias(f"n_{s}") for s in stats],
        _latest_team_agg(require_team=True),
    ).where(F.col("latest.team_abbr").isNotNull())
    per_player = per.select(
        "season", "player_id", "games_played", F.col("latest.team_abbr").alias("team_abbr"),
        F.inline(F.array(*[F.struct(
            F.lit(s).alias("stat"),
            F.round(F.col(f"sum_{s}").cast("decimal(24,4)") / F.nullif(F.col(f"n_{s}"), F.lit(0)).cast("decimal(20,0)"), 1)
            .cast("double").alias("value")) for s in stats])),
    )
    mg = minimum_games(t)
    eligible = per_player.join(mg, "season", "left").withColumn(
        "minimum_games", F.coalesce(F.col("minimum_games"), F.lit(0)) if apply_minimum else F.lit(0).cast("bigint"))
    eligible = eligible.where(F.col("games_played") >= F.col("minimum_games"))
    players = t.players.select(F.col("id").alias("player_id"), F.col("full_name").alias("player_name"))
    j = eligible.join(players, "player_id")
    # top-``limit`` by position first (a group limit: partial top-k before the shuffle, so a
    # (season, stat) never ships all its players to one task); RANK is then taken over the
    # kept rows: every row ranked above a kept row has a smaller position, so it is kept too
    part = Window.partitionBy("season", "stat")
    top = j.withColumn(
        "position",
        F.row_number().over(part.orderBy(F.col("value").desc(), F.col("games_played").desc(), "player_name", "player_id")).cast("bigint"),
    ).where(F.col("position") <= limit)
    ranked = top.withColumn("rank", F.rank().over(part.orderBy(F.col("value").desc())))
    return ranked.select(
        "stat", "season", "minimum_games", "position", F.col("rank").cast("bigint").alias("rank"), "player_id",
        "player_name", "team_abbr", "games_played", "value",
    )


def game_summary_view(t: Tables) -> DataFrame:
    """Q32 vw_game_summary: names, abbreviations, scores; winner = away on ties."""
    ht = t.teams.select(F.col("id").alias("home_team_id"), F.col("full_name").alias("home_team"), F.col("abbreviation").alias("home_abbr"))
    at = t.teams.select(F.col("id").alias("away_team_id"), F.col("full_name").alias("away_team"), F.col("abbreviation").alias("away_abbr"))
    g = t.games.join(ht, "home_team_id").join(at, "away_team_id")
    return g.select(
        F.col("id").alias("game_id"), "game_date", "season", "home_team", "home_abbr", "home_score",
        "away_team", "away_abbr", "away_score",
        F.when(F.col("home_score") > F.col("away_score"), F.col("home_abbr")).otherwise(F.col("away_abbr")).alias("winner"),
    )


def team_season_stats_view(t: Tables) -> DataFrame:
    """Q33 vw_team_season_stats: per-game averages; fg% and 3p% scaled x100 to 1 decimal."""
    teams = t.teams.select(F.col("id").alias("team_id"), F.col("full_name").alias("team_name"), "abbreviation")
    agg = t.team_game_stats.groupBy("team_id", "season").agg(
        F.count(F.lit(1)).alias("games_played"),
        avg_round("points").alias("ppg"),
        avg_round("rebounds").alias("rpg"),
        avg_round("assists").alias("apg"),
        ratio(F.sum("fgm") * 100, F.sum("fga"), 1).alias("fg_pct"),
        ratio(F.sum("fg3m") * 100, F.sum("fg3a"), 1).alias("fg3_pct"),
    )
    return agg.join(teams, "team_id").select(
        "team_id", "team_name", "abbreviation", "season", "games_played", "ppg", "rpg", "apg", "fg_pct", "fg3_pct")


def season_metadata(t: Tables) -> DataFrame:
    """Q34: recomputed season metadata (games, distinct players incl. DNP rows)."""
    from statlake.functions.expr import season_end_year, season_start_year

    g = t.games.groupBy("season").agg(F.count(F.lit(1)).alias("games_count"))
    p = t.player_game_stats.groupBy("season").agg(F.count_distinct("player_id").alias("players_count"))
    return g.join(p, "season", "left").select(
        F.col("season").alias("id"),
        season_start_year("season").alias("start_year"),
        season_end_year("season").alias("end_year"),
        "games_count",
        F.coalesce(F.col("players_count"), F.lit(0)).alias("players_count"),
    )


def head_to_head(t: Tables) -> DataFrame:
    """Q22 head-to-head for every pair of teams that met, keyed by (first=lower id, second)."""
    g = t.games.select(
        "season", "home_team_id", "away_team_id", "home_score", "away_score",
        F.least("home_team_id", "away_team_id").alias("first_team_id"),
        F.greatest("home_team_id", "away_team_id").alias("second_team_id"),
    )
    first_home = F.col("home_team_id") == F.col("first_team_id")
    first_score = F.when(first_home, F.col("home_score")).otherwise(F.col("away_score"))
    second_score = F.when(first_home, F.col("away_score")).otherwise(F.col("home_score"))
    return g.groupBy("season", "first_team_id", "second_team_id").agg(
        F.count(F.lit(1)).alias("games_played"),
        F.count_if(first_score > second_score).alias("first_team_wins"),
        F.count_if(second_score > first_score).alias("second_team_wins"),
        F.coalesce(avg_round(first_score), F.lit(0.0)).alias("first_team_ppg"),
        F.coalesce(avg_round(second_score), F.lit(0.0)).alias("second_team_ppg"),
    )


def compare_teams(t: Tables, first_id: int, second_id: int, season: str) -> DataFrame:
    """Q22 point form: the two teams' Q5 rows, each with its side of the head-to-head.

    Head-to-head comes from the legs where the opponent is the other team, so
    both rows are produced by equi-joins on team_id (no pairing of rows).
    """
    if first_id == second_id:
        raise ValueError("Provide exactly two distinct team IDs")
    ts = t.for_season(season)
    summary = team_season_summary(ts).where(F.col("team_id").isin(first_id, second_id))
    legs = team_legs(ts.games).where(
        ((F.col("team_id") == first_id) & (F.col("opponent_id") == second_id))
        | ((F.col("team_id") == second_id) & (F.col("opponent_id") == first_id))
    )
    h2h = legs.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("h2h_games_played"),
        F.count_if(_won()).alias("h2h_wins"),
        avg_round("team_score").alias("h2h_ppg"),
    )
    return (
        summary.join(h2h, "team_id", "left")
        .fillna({"h2h_games_played": 0, "h2h_wins": 0, "h2h_ppg": 0.0})
        .withColumn("position", F.when(F.col("team_id") == first_id, 1).otherwise(2))
    )


def compare_players(t: Tables, first_id: int, second_id: int, season: str) -> DataFrame:
    """Q21: both players' Q9 rows for one season, in input order; both must have stats."""
    if first_id == second_id:
        raise ValueError("Provide exactly two distinct player IDs")
    avgs = player_season_averages(t.for_season(season))
    return (
        avgs.where(F.col("player_id").isin(first_id, second_id))
        .withColumn("position", F.when(F.col("player_id") == first_id, 1).otherwise(2))
    )
