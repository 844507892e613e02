"""The star schema as one bundle of DataFrames, and its Parquet layout."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlake import schemas


@dataclass(frozen=True)
class Tables:
    seasons: DataFrame
    teams: DataFrame
    players: DataFrame
    games: DataFrame
    team_game_stats: DataFrame
    player_game_stats: DataFrame
    shot_attempts: DataFrame
    #: The stored league baseline (see plans/league.py), where there is one.
    league: DataFrame | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        """The star schema's tables by name."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "league"}

    def register(self, prefix: str = "") -> "Tables":
        """Expose every table as a temp view (``prefix`` + name) for SQL users."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)
        return self

    def for_season(self, season: str | None) -> "Tables":
        """Season-scoped view of the facts: a partition filter, pruned at the scan."""
        if season is None:
            return self
        pred = F.col("season") == season
        return Tables(
            seasons=self.seasons.where(F.col("id") == season),
            teams=self.teams,
            players=self.players,
            games=self.games.where(pred),
            team_game_stats=self.team_game_stats.where(pred),
            player_game_stats=self.player_game_stats.where(pred),
            shot_attempts=self.shot_attempts.where(pred),
            league=None if self.league is None else self.league.where(pred),
        )


def read_tables(spark: SparkSession, root: str) -> Tables:
    """Read a published dataset version: one Parquet directory per table.

    Fact tables are partitioned by ``season`` so season predicates prune
    directories, and the fixed schemas skip inference over many files.
    """
    frames = {}
    for name, schema in schemas.TABLES.items():
        path = f"{root.rstrip('/')}/{name}"
        df = spark.read.schema(schema).option("basePath", path).parquet(path)
        frames[name] = df.select(*schema.fieldNames())
    return Tables(**frames)


def write_tables(tables: Tables, root: str, mode: str = "errorifexists") -> None:
    """Write a dataset version; facts partitioned by season, clustered by team.

    Sorting within partitions by (team_id, player_id) keeps Parquet min/max
    statistics tight, so subject filters skip row groups.
    """
    for name, df in tables.as_dict().items():
        schema = schemas.TABLES[name]
        out = df.select(*schema.fieldNames())
        writer_df = out
        if name in schemas.PARTITIONED_BY_SEASON:
            sort_cols = [c for c in ("team_id", "home_team_id", "player_id", "game_id", "id") if c in schema.fieldNames()]
            # Range partitioning on (season, team, ...) splits a large season over
            # many tasks (no single-task season) and keeps each file's keys contiguous.
            writer_df = out.repartitionByRange("season", *sort_cols).sortWithinPartitions("season", *sort_cols)
            writer_df.write.mode(mode).partitionBy("season").parquet(f"{root.rstrip('/')}/{name}")
        else:
            writer_df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


#: Tables that meet by game, and their column of the game's id.
GAME_COLUMN = {"games": "id", "team_game_stats": "game_id", "player_game_stats": "game_id", "shot_attempts": "game_id"}


def save_bucketed(tables: Tables, prefix: str, buckets: int, root: str | None = None) -> None:
    """Save a version as catalog tables ``<prefix>_<table>``, games and facts bucketed and sorted by game.

    Rules and cross-checks join and group by game; over this layout they do so
    without an exchange. With joins on (game, team) or (game, player) that
    needs :func:`join_by_bucket`. The tables lie under ``root``, by default in
    the session's warehouse; either must be shared.
    """
    for name, df in tables.as_dict().items():
        writer = df.select(*schemas.TABLES[name].fieldNames())
        if name in GAME_COLUMN:
            game = GAME_COLUMN[name]
            writer = writer.repartition(buckets, game).write.bucketBy(buckets, game).sortBy(game)
        else:
            writer = writer.write
        writer = writer if root is None else writer.option("path", f"{root.rstrip('/')}/{name}")
        writer.format("parquet").mode("errorifexists").saveAsTable(f"{prefix}_{name}")


def read_bucketed(spark: SparkSession, prefix: str) -> Tables:
    return Tables(**{name: spark.table(f"{prefix}_{name}") for name in schemas.TABLES})


def join_by_bucket(spark: SparkSession) -> None:
    """Let joins on a game and more keys use tables that are bucketed by the game alone."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
