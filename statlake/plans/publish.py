"""Season replacement and publication (K4-K8, M1-M7): write-audit-publish of dataset versions.

A dataset store is a folder of immutable table parts and a sequence of manifests::

    <root>/data/<fact>/season=<season>/version=<version>/...   parquet
    <root>/data/<table>/version=<version>/...                  dimensions, seasons
    <root>/manifests/<sequence>.json                           which parts make up a version

A replacement writes the parts of one season (and the small dimension and
seasons tables) under a new version name, verifies what was written, and then
creates the next manifest, which names the new parts and every other part of
the manifest it started from. Parts of other seasons are neither read as a
whole nor written. Manifests are created only if absent: of two publishers that
started from the same version one gets the next number, the other is refused
(:class:`StaleVersionError`). A failure or a killed job leaves unreferenced
parts and the previous version current; readers never see a partial version.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from statlake import schemas
from statlake.functions.expr import season_end_year, season_start_year
from statlake.plans import browse, quality, season as season_q
from statlake.plans.league import CONTEXT, ZONE, league_counts
from statlake.sources import files
from statlake.sources.stored import shuffles_removed
from statlake.sources.tables import Tables

FACTS = ("games", "team_game_stats", "player_game_stats", "shot_attempts")


class SeasonLifecycleError(RuntimeError):
    pass


class StaleVersionError(SeasonLifecycleError):
    """Another version was published since this one's base was read."""


# --- table mutations (K4-K7) ----------------------------------------------------------
def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K4: INSERT ... ON CONFLICT (key) DO UPDATE as anti join + union."""
    return base.join(new.select(*key), key, "left_anti").unionByName(new.select(*base.columns))


def prune_not_in(base: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    """K5: delete rows whose key is absent from ``keep`` (semi join)."""
    return base.join(keep.select(*key).distinct(), key, "left_semi")


def delete_season(t: Tables, season: str, confirm: bool = False) -> Tables:
    """K6: remove a season child-to-parent (facts, then the season row); needs confirm=True."""
    if not confirm:
        raise SeasonLifecycleError("delete_season requires confirm=True")
    keep = ~F.col("season").eqNullSafe(season)  # rows without a season belong to no season and stay
    return Tables(seasons=t.seasons.where(~F.col("id").eqNullSafe(season)), teams=t.teams, players=t.players,
                  **{n: getattr(t, n).where(keep) for n in FACTS})


def delete_season_by_game(t: Tables, season: str) -> Tables:
    """K7: drop fact rows of the season and rows whose game belongs to the season's games."""
    season_games = t.games.where(F.col("season") == season).select(F.col("id").alias("game_id"))
    out = {"games": t.games.where(~F.col("season").eqNullSafe(F.lit(season)))}
    for n in ("team_game_stats", "player_game_stats", "shot_attempts"):
        df = getattr(t, n).where(~F.col("season").eqNullSafe(F.lit(season)))
        out[n] = df.join(season_games, "game_id", "left_anti")
    return Tables(seasons=t.seasons.where(F.col("id") != season), teams=t.teams, players=t.players, **out)


def season_row(t: Tables, season: str, manifest_sha256: str | None, manifest_generated_at: dt.datetime | None) -> DataFrame:
    """Q34 + provenance: the season's metadata row recomputed from the tables."""
    meta = season_q.season_metadata(t).where(F.col("id") == season)
    shots = t.shot_attempts.where(F.col("season") == season).agg(F.count(F.lit(1)).alias("shot_attempts_count"))
    now = F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    status = "passed" if manifest_sha256 else "untracked"
    gen_utc = manifest_generated_at.astimezone(dt.UTC).replace(tzinfo=None) if manifest_generated_at and \
        manifest_generated_at.tzinfo else manifest_generated_at
    gen = F.lit(gen_utc.isoformat(sep=" ") if gen_utc else None).cast("timestamp_ntz")
    return meta.withColumn("k", F.lit(1)).join(shots.withColumn("k", F.lit(1)), "k").select(
        "id", season_start_year(F.col("id")).alias("start_year"), season_end_year(F.col("id")).alias("end_year"),
        F.col("games_count").cast("int"), F.col("players_count").cast("int"), now.alias("loaded_at"),
        F.col("shot_attempts_count").cast("bigint"), gen.alias("manifest_generated_at"),
        (now if manifest_sha256 else F.lit(None).cast("timestamp_ntz")).alias("verified_at"),
        F.lit(status).alias("verification_status"), F.lit(manifest_sha256).cast("string").alias("manifest_sha256"))


# --- manifests (M1, M2) ---------------------------------------------------------------
def build_manifest(spark: SparkSession, clean_root: str, season: str, report: dict,
                   corrections: list[dict] | None = None) -> dict:
    """M1: per-file sha256 and row counts of the six clean files; needs a passing report."""
    if report.get("status") != "passed":
        raise SeasonLifecycleError("A passing official verification report is required")
    paths = files.dataset_paths(clean_root, season)
    data = files.load_dataset(spark, clean_root, season)
    counts = {name: df.count() for name, df in data.items()}
    digests = {r["name"]: r.sha256 for r in files.table_digests(spark, paths).collect()}  # one row a table
    entries = [{"name": name, "path": p, "sha256": digests[name], "rows": counts[name]} for name, p in paths.items()]
    return {"schema_version": 3, "season": season, "season_type": "Regular Season",
            "generated_at": dt.datetime.now(dt.UTC).isoformat(), "files": entries,
            "counts": counts, "verification": {"status": report["status"], "mismatch_count": report.get("mismatch_count", 0)},
            "shot_corrections": corrections or []}


def verify_manifest(spark: SparkSession, clean_root: str, season: str, manifest: dict) -> dict[str, DataFrame]:
    """M2: scope, file set, digests before and after reading, and row counts."""
    if manifest.get("season") != season:
        raise SeasonLifecycleError("Manifest is for another season")
    paths = files.dataset_paths(clean_root, season)
    listed = {e["name"]: e for e in manifest.get("files", [])}
    if set(listed) != set(paths):
        raise SeasonLifecycleError("Manifest file set does not match the dataset")

    expected = spark.createDataFrame([(name, e["sha256"]) for name, e in listed.items()], "name string, expected string")

    def check_digests() -> None:
        found = files.table_digests(spark, paths).join(expected, "name", "full")
        wrong = [r["name"] for r in found.where(~F.col("sha256").eqNullSafe(F.col("expected"))).select("name").orderBy("name").collect()]
        if wrong:
            raise SeasonLifecycleError("digest differs from the manifest: " + ", ".join(wrong))

    check_digests()
    data = files.load_dataset(spark, clean_root, season)
    for name, df in data.items():
        if df.count() != listed[name]["rows"]:
            raise SeasonLifecycleError(f"{name} row count does not match the manifest")
    check_digests()  # files must not change while they are read
    return data


# --- verification of written tables (M3) ----------------------------------------------
def integrity_violations(t: Tables) -> DataFrame:
    """Per season, games failing the integrity predicate (id length, two team rows,
    team rows of this game's teams/season with consistent flags and points, player rows
    of this game's teams/season)."""
    g = t.games.select(F.col("id").alias("game_id"), F.col("season").alias("g_season"), "home_team_id", "away_team_id",
                       "home_score", "away_score")
    once = g.distinct()  # copies of a game row must not multiply its team rows
    tgs = t.team_game_stats.join(once, "game_id")
    any_home = tgs.groupBy("game_id").agg(F.max(F.col("is_home").cast("int")).alias("has_home"))
    part = (F.col("team_id") == F.col("home_team_id")) | (F.col("team_id") == F.col("away_team_id"))
    expected_pts = F.when(F.col("team_id") == F.col("home_team_id"), F.col("home_score")).otherwise(F.col("away_score"))
    tbad = tgs.join(any_home, "game_id").withColumn(
        "bad", (F.col("season") != F.col("g_season")) | ~part
        | ((F.col("is_home") != (F.col("team_id") == F.col("home_team_id"))) & (F.col("has_home") == 1))
        | (F.col("points") != expected_pts))
    tcount = tbad.groupBy("game_id").agg(F.count(F.lit(1)).alias("n_team_rows"), F.count_if("bad").alias("team_bad"))
    pbad = t.player_game_stats.join(once, "game_id").where(
        (F.col("season") != F.col("g_season")) | ~part).select("game_id").distinct().withColumn("player_bad", F.lit(1))
    j = g.join(tcount, "game_id", "left").join(pbad, "game_id", "left")
    bad = ((F.length("game_id") != 10) | ~F.coalesce(F.col("n_team_rows") == 2, F.lit(False))
           | (F.coalesce(F.col("team_bad"), F.lit(0)) > 0) | F.col("player_bad").isNotNull())
    return j.where(bad).groupBy(F.col("g_season").alias("season")).agg(F.count(F.lit(1)).alias("violations"))


def residue(t: Tables, season: str) -> DataFrame:
    """Fact rows of any other season (UNION ALL of the four season columns)."""
    seasons = reduce(DataFrame.unionByName, [getattr(t, n).select("season") for n in FACTS])
    return seasons.where(~F.col("season").eqNullSafe(F.lit(season))).agg(F.count(F.lit(1)).alias("violations"))


def season_ids(t: Tables) -> DataFrame:
    """array_agg(id ORDER BY id) of the seasons table."""
    return t.seasons.agg(F.array_sort(F.collect_list("id")).alias("season_ids"))


def verify_written(t: Tables, season: str, expected_counts: dict[str, int], expected_players: int,
                   manifest_sha256: str | None, single_season: bool) -> None:
    """M3: counts equal the manifest, integrity predicate holds, metadata tuple equal,
    and with ``single_season`` no other season, no stale rows. ``expected_counts``: what
    the writing tasks counted; the written tables are counted from their Parquet footers."""
    s = t.for_season(season)
    counts = {n: getattr(s, n).count() for n in FACTS}
    for n, c in counts.items():
        if c != expected_counts[n]:
            raise SeasonLifecycleError(f"Written {n} count {c} does not match manifest {expected_counts[n]}")
    if integrity_violations(s).limit(1).count():
        raise SeasonLifecycleError("Integrity verification failed for the written version")
    meta = t.seasons.where(F.col("id") == season).collect()
    status = "passed" if manifest_sha256 else "untracked"
    if len(meta) != 1 or (meta[0].games_count, meta[0].players_count, meta[0].shot_attempts_count,
                          meta[0].verification_status, meta[0].manifest_sha256) != (
            expected_counts["games"], expected_players, expected_counts["shot_attempts"], status, manifest_sha256):
        raise SeasonLifecycleError("Season metadata does not match the validated dataset")
    if single_season:
        ids = season_ids(t).first().season_ids
        if list(ids) != [season]:
            raise SeasonLifecycleError("Single-season replacement left other seasons")
        if residue(t, season).first().violations:
            raise SeasonLifecycleError("Single-season replacement left non-target data rows")
        for n in ("teams", "players"):
            if getattr(t, n).count() != expected_counts[n]:
                raise SeasonLifecycleError(f"Single-season replacement left stale shared {n} rows")


# --- the store (K8) --------------------------------------------------------------------
#: Tables of a store that are kept by season: the facts and the league baseline.
BY_SEASON = (*FACTS, "league")
_SORT = ("team_id", "home_team_id", "player_id", "game_id", "id")
_NO_SEASON = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of rows without a season


@dataclass
class DatasetStore:
    spark: SparkSession
    root: str

    # --- manifests
    def sequences(self) -> list[int]:
        names = files.list_names(self.spark, f"{self.root}/manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest_path(self, sequence: int) -> str:
        return f"{self.root}/manifests/{sequence:012d}.json"

    def manifest(self, sequence: int | None = None) -> dict | None:
        """The manifest of that number, or the current (highest) one; None for an empty store."""
        if sequence is None:
            known = self.sequences()
            if not known:
                return None
            sequence = known[-1]
        return json.loads(files.read_text(self.spark, self._manifest_path(sequence)))

    def current_version(self) -> str | None:
        m = self.manifest()
        return None if m is None else m["version"]

    def publish(self, manifest: dict) -> None:
        """Make ``manifest`` the version after its base, unless there is one already (compare and set)."""
        if not files.create_if_absent(self.spark, self._manifest_path(manifest["sequence"]), json.dumps(manifest, sort_keys=True, indent=1) + "\n"):
            raise StaleVersionError(f"another version was published after {manifest['base']}")

    # --- tables
    def read(self, version: str | None = None) -> Tables | None:
        """The tables of the current version, or of the version of that name."""
        if version is None:
            m = self.manifest()
            return None if m is None else self.tables(m)
        for sequence in reversed(self.sequences()):
            m = self.manifest(sequence)
            if m["version"] == version:
                return self.tables(m)
        raise KeyError(version)

    def part(self, table: str, season: str | None, version: str) -> str:
        """The folder of one part."""
        folder = f"season={_NO_SEASON if season is None else season}/" if table in BY_SEASON else ""
        return f"{self.root}/data/{table}/{folder}version={version}"

    def tables(self, manifest: dict) -> Tables:
        league = [self.part("league", s, v) for s, v in manifest["parts"]["league"].items()]
        return replace(self._staged(manifest["parts"]), league=self._read("league", league, None))

    def _staged(self, parts: dict) -> Tables:
        """The tables that ``parts`` names, without the baseline."""
        frames = {}
        for name, schema in schemas.TABLES.items():
            of = parts[name]
            paths = [self.part(name, s, v) for s, v in of.items()] if name in BY_SEASON else [self.part(name, None, of)]
            frames[name] = self._read(name, paths, schema)
        return Tables(**frames)

    def _read(self, table: str, paths: list[str], schema) -> DataFrame:
        if schema is None:  # the baseline's columns have the types of the tables it is counted from
            schema = league_counts(Tables(**{n: self.spark.createDataFrame([], s) for n, s in schemas.TABLES.items()})).schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{table}")
        return reader.parquet(*paths).select(*schema.fieldNames())

    # --- writing
    def _write(self, df: DataFrame, table: str, season: str | None, version: str) -> int:
        """Write one part; its rows as counted by the writing tasks. A row of another season fails the write."""
        sort = [c for c in _SORT if c in df.columns]
        if table in BY_SEASON:
            df = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
        # above the sort: the sampling for the ranges runs what lies below twice
        seen = Observation()
        wrong = ~F.col("season").eqNullSafe(F.lit(season)) if table in BY_SEASON else F.lit(False)
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("wrong"))
        if table in BY_SEASON:
            df = df.drop("season")  # the folder has it
        with shuffles_removed(self.spark):
            df.write.parquet(self.part(table, season, version))
        counted = seen.get
        if counted["wrong"]:
            raise SeasonLifecycleError(f"{counted['wrong']} {table} rows are not of season {season}")
        return int(counted["rows"])

    def _new_version(self) -> str:
        return dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]

    def import_tables(self, t: Tables) -> str:
        """Publish a whole multi-season dataset as it is, as the version after the current one."""
        base, version = self.manifest(), self._new_version()
        parts: dict = {}
        for name, df in t.as_dict().items():
            if name not in BY_SEASON:
                self._write(df.select(*schemas.TABLES[name].fieldNames()), name, None, version)
                parts[name] = version
            else:
                parts[name] = self._import_seasons(df, name, version)
        # the baseline is counted from the parts just written: the shots are made once
        parts["league"] = self._import_seasons(league_counts(self._staged(parts)), "league", version)
        self.publish(self._next(base, version, parts))
        return version

    def _import_seasons(self, df: DataFrame, name: str, version: str) -> dict[str, str]:
        """Write a table of all seasons; its parts."""
        sort = ["season", *(c for c in _SORT if c in df.columns)]
        ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("version", F.lit(version))
        # appended under one folder a season; only this version's folders are listed afterwards
        with shuffles_removed(self.spark):
            ranged.write.mode("append").partitionBy("season", "version").parquet(f"{self.root}/data/{name}")
        seasons = [n.removeprefix("season=") for n in files.list_names(self.spark, f"{self.root}/data/{name}") if n.startswith("season=")]
        return {s: version for s in seasons if files.exists(self.spark, self.part(name, s, version))}

    def _next(self, base: dict | None, version: str, parts: dict) -> dict:
        before = 0 if base is None else base["sequence"]
        return {"sequence": before + 1, "base": before, "version": version, "parts": parts}

    def _strays(self, base: Tables, season: str) -> dict[str, list[str | None]]:
        """Seasons, by table, that hold fact rows of the season's games under another season (K7 drops them too)."""
        games = base.games.where(F.col("season") == season).select(F.col("id").alias("game_id")).distinct()
        found = {}
        for n in FACTS[1:]:
            other = getattr(base, n).where(~F.col("season").eqNullSafe(F.lit(season))).select("game_id", "season")
            found[n] = [r.season for r in other.join(games, "game_id", "left_semi").select("season").distinct().collect()]  # seasons at most
        return found

    def replace_season(self, new: Tables, season: str, *, single_season: bool = False,
                       manifest_sha256: str | None = None, manifest_generated_at: dt.datetime | None = None,
                       verify=None) -> str:
        """K8: write and verify the season's parts and publish the next version.

        Only the season's own parts are written, and those of another season
        that holds rows of its games. The current version stays readable until
        the manifest is created, and stays current on any failure. If another
        version was published meanwhile, this one is refused.
        """
        manifest = self.manifest()
        empty = Tables(**{n: self.spark.createDataFrame([], s) for n, s in schemas.TABLES.items()})
        base = empty if manifest is None else self.tables(manifest)
        version = self._new_version()
        parts = {n: {} if single_season or manifest is None else dict(manifest["parts"][n]) for n in BY_SEASON}
        known = manifest is not None and not single_season and season in manifest["parts"]["games"]
        for table, seasons in (self._strays(base, season) if known else {}).items():
            games = base.games.where(F.col("season") == season).select(F.col("id").alias("game_id"))
            for other in seasons:
                kept = getattr(base, table).where(F.col("season").eqNullSafe(F.lit(other))).join(games, "game_id", "left_anti")
                self._write(kept.select(*schemas.TABLES[table].fieldNames()), table, other, version)
                parts[table][_NO_SEASON if other is None else other] = version
        expected = {}
        for n in FACTS:
            expected[n] = self._write(getattr(new, n).select(*schemas.TABLES[n].fieldNames()), n, season, version)
            parts[n][season] = version
        for n in ("teams", "players"):
            rows = upsert(getattr(base, n), getattr(new, n), ["id"])
            rows = prune_not_in(rows, getattr(new, n), ["id"]) if single_season else rows
            count = self._write(rows.select(*schemas.TABLES[n].fieldNames()), n, None, version)
            expected[n] = getattr(new, n).count() if single_season else count
            parts[n] = version
        # what follows is read from the parts just written: the season's metadata and its league baseline
        staged = Tables(seasons=base.seasons, **{
            n: self._read(n, [self.part(n, season if n in BY_SEASON else None, version)], schemas.TABLES[n]) for n in ("teams", "players", *FACTS)})
        others = base.seasons.limit(0) if single_season else base.seasons.where(F.col("id") != season)
        meta = season_row(staged, season, manifest_sha256, manifest_generated_at)
        self._write(others.unionByName(meta).select(*schemas.SEASONS.fieldNames()), "seasons", None, version)
        self._write(league_counts(staged).select(*CONTEXT, *ZONE, "attempts", "makes"), "league", season, version)
        parts |= {"seasons": version, "league": parts["league"] | {season: version}}
        following = self._next(manifest, version, parts)
        written = self.tables(following)
        players_count = written.for_season(season).player_game_stats.select("player_id").distinct().count()
        verify_written(written, season, expected, players_count, manifest_sha256, single_season)
        if verify == "quality":
            quality.run_quality_checks(written.for_season(season))
        elif callable(verify):
            verify(written)
        self.publish(following)
        return version


def staged_gate(staged: DataFrame, expected: dict) -> None:
    """M4: the staged deployment serves the same digest, passed status, and games/shots counts."""
    row = staged.first()
    if row is None or row.manifest_sha256 != expected["manifest_sha256"] or row.verification_status != "passed" \
            or row.games != expected["games"] or row.shot_attempts != expected["shot_attempts"]:
        raise SeasonLifecycleError("Staged dataset does not match the promoted manifest")


def read_back(t: Tables, season: str) -> None:
    """M5: after publishing: ready, passed, season listed, a game of the dataset served,
    box score rows present, standings cover the teams with games, leaders well formed."""
    s = t.for_season(season)
    ready = browse.readiness(s).where(F.col("season") == season).first()
    if ready is None or ready.status != "ready":
        raise SeasonLifecycleError("Published dataset is not ready")
    game = s.games.select("id").limit(1).first()
    if game is None:
        raise SeasonLifecycleError("Published dataset has no games")
    if browse.boxscore_players(s).where(F.col("game_id") == game.id).limit(1).count() == 0:
        raise SeasonLifecycleError("Box score of a published game is empty")
    standing_teams = season_q.standings(s).select("team_id")
    playing = s.games.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    if standing_teams.exceptAll(playing).limit(1).count() or playing.join(
            t.teams.select(F.col("id").alias("team_id")), "team_id", "left_semi").exceptAll(standing_teams).limit(1).count():
        raise SeasonLifecycleError("Standings do not cover the teams with games")
    bad_leaders = season_q.leaders(s).where(F.col("rank") < 1).limit(1).count()
    if bad_leaders:
        raise SeasonLifecycleError("Leaders are malformed")


def restored_matches(t: Tables) -> DataFrame:
    """M6: one row per season: passed, recorded counts equal live ones and non-zero, digest present."""
    r = browse.readiness(t).join(t.seasons.select(F.col("id").alias("season"), "manifest_sha256"), "season")
    ok = (F.col("status") == "ready") & (F.col("live_games") > 0) & (F.col("live_shots") > 0) \
        & F.col("manifest_sha256").isNotNull()
    return r.select("season", ok.alias("matches"))


def live_contract(status: DataFrame, ready: DataFrame, games_total: DataFrame, expected: dict) -> list[str]:
    """M7: readiness, status and expected counts agree (one row per season on each side)."""
    problems = []
    s, r, g = status.first(), ready.first(), games_total.first()
    if r is None or r.status != "ready":
        problems.append("dataset is not ready")
    if s is None or s.verification_status != "passed":
        problems.append("dataset is not verified")
    if s is not None and (s.games, s.shot_attempts) != (expected.get("games"), expected.get("shot_attempts")):
        problems.append("dataset counts differ from the expected counts")
    if g is None or s is None or g.total != s.games:
        problems.append("games listing total differs from the dataset count")
    return problems
