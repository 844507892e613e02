"""Season promotion end to end: clean files -> verified version -> published pointer.

    verify_manifest (M2)  digests before/after reading, file set, row counts
    contract rules (V)    every violation collected, fail closed
    cross-check (G)       local totals against the official feed, report validated (G6)
    replace_season (K8)   build next version, write, verify (M3) + quality checks (D27), publish
    read_back (M5)        the published version answers the product's reads

Each step raises before anything is published; a failure leaves the current
version in place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from statlake.operators import crosscheck as cc
from statlake.operators import rules
from statlake.plans import publish, quality


def promote_season(spark: SparkSession, clean_root: str, store_root: str, season: str, manifest: dict,
                   report: dict, official_teams: DataFrame, official_players: DataFrame, provider: str,
                   single_season: bool = False, expected_teams: int = 30) -> str:
    rules.validate_season_name(season)
    hashes = {e["name"]: e["sha256"] for e in manifest["files"]}
    cc.validate_report(report, season, hashes, provider)  # cheap document checks first
    raw = publish.verify_manifest(spark, clean_root, season, manifest)
    rules.validate_dataset(raw, season)
    typed = rules.typed(raw)
    findings = cc.crosscheck(typed, official_teams, official_players)
    if findings.where("issue <> 'difference'").limit(1).count():
        raise cc.OfficialVerificationError("official aggregates disagree beyond tolerance")
    store = publish.DatasetStore(spark, store_root)
    generated = dt.datetime.fromisoformat(manifest["generated_at"])
    sha = manifest.get("sha256") or publish_digest(manifest)
    version = store.replace_season(
        typed, season, single_season=single_season, manifest_sha256=sha, manifest_generated_at=generated,
        verify=lambda written: quality.run_quality_checks(written.for_season(season), expected_teams))
    publish.read_back(store.read(version), season)
    return version


def publish_digest(manifest: dict) -> str:
    """SHA-256 of the manifest document (sorted keys), recorded with the season."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode("utf-8")).hexdigest()
