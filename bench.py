"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The star schema is first derived from the driver tables and published as
Parquet (facts partitioned by season) in a fresh scratch folder, as a
production dataset version would be; each query then reads that version and
is timed to a full materialisation (``noop`` sink, nothing collected): the
median of $BENCH_REPEATS (default 3) runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dataclasses import replace  # noqa: E402

from statlake.operators import rules  # noqa: E402
from statlake.plans import quality, season, shots  # noqa: E402
from statlake.plans.league import league_counts  # noqa: E402
from statlake.session import local_session  # noqa: E402
from statlake.sources.seeded import core_roster  # noqa: E402
from statlake.sources.tables import read_tables, write_tables  # noqa: E402
from statlake.sources.testviews import derive  # noqa: E402

HEADLINE = {
    "Q5_team_season_summary": season.team_season_summary,
    "Q9_player_season_averages": season.player_season_averages,
    "Q18_shot_zones": shots.shot_zones,
    "Q19_shot_profile": shots.shot_profile,
    "Q28_leaders": season.leaders,
    "Q29_standings": season.standings,
    "D24_shots_reconcile": quality.d24_shots_reconcile,
    "V_contract": lambda t: rules.violation_counts(rules.contract_report(rules.as_text(t))),
    "D27_quality_report": quality.quality_report,
}


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(2 * cpus, 8), app="statlake-bench")
    root = tempfile.mkdtemp(prefix="statlake-bench-")
    t0 = time.time()
    write_tables(derive(spark, sf_dir), f"{root}/v1")
    build = time.time() - t0  # of the first version
    tables = read_tables(spark, f"{root}/v1")
    league_counts(tables).write.partitionBy("season").parquet(f"{root}/league")  # as a published version brings it
    tables = replace(tables, league=spark.read.schema(league_counts(tables).schema).parquet(f"{root}/league"))
    # the leaders' games threshold is met only by regular players: theirs is a version of its own
    write_tables(core_roster(tables), f"{root}/v2")
    versions = {"Q28_leaders": read_tables(spark, f"{root}/v2")}
    times = {}
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    for name, fn in HEADLINE.items():
        given = versions.get(name, tables)
        _run(fn(given))  # warm-up: JIT, file listing, broadcast of small dims
        runs = []
        for _ in range(repeats):
            t = time.time()
            _run(fn(given))
            runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "build_sec": round(build, 3), "sf": float(sf) if sf else sf_dir, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
