"""Ledger of landed sources, result sets read by several tasks, substring index."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from statlake.functions.expr import contains_ci
from statlake.operators.substring import SubstringIndex
from statlake.sources import ledger as lg
from statlake.sources import resultset
from statlake.sources.resultset_split import read_resultset_split


def _folder():
    return tempfile.mkdtemp(prefix="statlake-test-")


def _feed(spark, rows):
    return spark.createDataFrame(rows, "source string, k long, v string")


def _batches(led):
    return {r.source: r.batch for r in led.latest().collect()}


def test_ledger_lands_absent_and_changed_sources(spark):
    led = lg.LandingLedger(spark, _folder())
    first = [("a", 1, "x"), ("a", 1, "x"), ("b", 2, None), (None, 3, "z")]
    led.land(_feed(spark, first))
    assert _batches(led) == {"a": 1, "b": 1, None: 1}
    led.land(_feed(spark, [("a", 9, "other"), ("c", 4, "")]))  # a is kept
    assert _batches(led) == {"a": 1, "b": 1, None: 1, "c": 2}
    # one copy less of a row is another source; an unchanged one and a null source are kept
    led.land(_feed(spark, [("a", 1, "x"), ("b", 2, None), (None, 3, "z")]), take=lg.CHANGED)
    assert _batches(led) == {"a": 3, "b": 1, None: 1, "c": 2}
    assert sorted(map(tuple, led.rows().select("source", "k", "v").collect()), key=repr) == sorted(
        [("a", 1, "x"), ("b", 2, None), (None, 3, "z"), ("c", 4, "")], key=repr)
    led.land(_feed(spark, []), take=lg.ALL)  # nothing to land: no commit
    assert _batches(led) == {"a": 3, "b": 1, None: 1, "c": 2}
    left = led.pending(spark.createDataFrame([("a",), ("d",)], "source string"))
    assert [r.source for r in left.collect()] == ["d"]


def test_ledger_resumes_after_a_failed_slice(spark):
    led = lg.LandingLedger(spark, _folder())
    names = [f"s{i}" for i in range(12)]
    feed = _feed(spark, [(n, i, n) for i, n in enumerate(names)])
    cut = {r.source: r.slice for r in feed.select("source", F.pmod(F.xxhash64("source"), F.lit(3)).alias("slice")).collect()}
    assert set(cut.values()) == {0, 1, 2}
    bad = feed.withColumn("v", F.when(F.pmod(F.xxhash64("source"), F.lit(3)) == 1, F.raise_error(F.lit("provider down"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="provider down"):
        led.land(bad, slices=3)
    assert set(_batches(led)) == {n for n in names if cut[n] == 0}
    led.land(feed, slices=3)
    after = _batches(led)
    assert set(after) == set(names) and all((after[n] == 1) == (cut[n] == 0) for n in names)
    assert led.rows().count() == len(names)


def test_ledger_refuses_a_stale_landing(spark, monkeypatch):
    root = _folder()
    led = lg.LandingLedger(spark, root)
    led.land(_feed(spark, [("a", 1, "x")]))
    stale = lg.LandingLedger(spark, root)
    monkeypatch.setattr(stale, "_batches", lambda: {})  # read before the first commit
    with pytest.raises(lg.StaleLedgerError):
        stale.land(_feed(spark, [("a", 2, "y")]))
    assert [(r.source, r.k) for r in led.rows().collect()] == [("a", 1)]


ODD = ["plain", "a ] b", "[[", 'quote " ] " end', "back\\slash ]\\", "", "é ] 漢字 ]", None, 1.50, -7, True, "line\nbreak ]", "{ } ] {"]


def _documents(folder):
    docs = {}
    for d in range(3):
        rows = [[f"id-{d}-{i}", ODD[(i + d) % len(ODD)], i, ODD[(i * 5 + 1) % len(ODD)]] for i in range(40 + d)]
        if d == 2:
            rows[3][1] = ["nested", ["deep ]"], {"k": "]"}]
        docs[f"team-{d}.json"] = {"resource": "log [x]", "parameters": {"Team": d, "note": "{ ] ["}, "resultSets": [
            {"name": "first [", "headers": ["ID", "A ] B", "N", "C"], "rowSet": rows},
            {"name": "none", "headers": ["X"], "rowSet": []},
            {"rowSet": [[d, "]"], [d + 1, None]], "name": "last ]", "headers": ["Y", "Z"]}]}
    docs["empty.json"] = {"resultSets": []}
    for i, (name, doc) in enumerate(docs.items()):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            json.dump(doc, f, ensure_ascii=i % 2 == 0, indent=None if i % 2 else 1)


def _cell(v):  # a nested cell is JSON text; only the plain reader keeps its blanks
    return json.dumps(json.loads(v)) if v and v.startswith("[") and "nested" in v else v


def _rows(df):
    return sorted((r.source_file, r.row_number, tuple(sorted((k, _cell(v)) for k, v in r.row.items()))) for r in df.collect())


@pytest.mark.parametrize("block", [97, 1 << 20])
def test_split_result_sets_equal_the_plain_reader(spark, block):
    folder = _folder()
    _documents(folder)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for index in (0, 1, 2, 3):
            plain = _rows(resultset.read_resultset(spark, folder, index)) if index < 3 else []
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            if block == 97:
                assert spark.read.option("lineSep", "]").text(folder).rdd.getNumPartitions() > 20
            assert _rows(read_resultset_split(spark, folder, index)) == plain
            for k, v in before.items():
                spark.conf.set(k, v)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


NAMES = ["100% Bolt", "under_score", "back\\slash", "ÉCLAIR Nut", "bolt", "Bo", "", None, "bolt", "aaa", "x y z", "nut 漢字"]
TERMS = ["%", "_", "\\", "BOLT", "bo", "é", "", "aaaa", "aa", "ut 漢", "nothing here", "t", "0% b"]


def test_substring_index_equals_the_scan(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    index = SubstringIndex(spark, _folder() + "/index", buckets=8).build(rows, "name")
    expected = {t: sorted(r.id for r in rows.where(contains_ci(F.col("name"), t)).collect()) for t in TERMS}
    for t in TERMS:
        assert sorted(r.id for r in index.search(rows, "name", t).collect()) == expected[t], t
    many = spark.createDataFrame([(t,) for t in [*TERMS, "bo", None]], "term string")
    found = sorted((r.term, r.id) for r in index.search_all(rows, "name", many).collect())
    assert found == sorted((t, i) for t in TERMS for i in expected[t])


def test_substring_search_reads_one_bucket(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("player "), F.col("id").cast("string")).alias("name"))
    index = SubstringIndex(spark, _folder() + "/index").build(rows, "name")
    hit = index.search(rows, "name", "yer 1234")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan, plan
    assert [r.id for r in hit.collect()] == [1234]
