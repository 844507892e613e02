"""Quality rules, mixing, packing, classifier, chat, URL filter, archives, search and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from scripts.oracle_check import TABLES, rows_of
from statlake.llm import chat, classifier, mixing, packing, quality, search, simhash, suffix_dedup, url_filter, warc
from statlake.llm.common import scratch, table
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i: i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "é", "\n", "\n", "# ", "x y a b c d e f g ", "\x1c", " "]) for _ in range(rng.randint(0, 40)))
        assert quality.base_counts(t.encode()) == brute_counts(t)


def test_quality_rules(spark, docs_of):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 400))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])) for i in range(700)]
    junk = [(1000 + i, " ".join(rng.choice(vocabulary) + "%%%" for _ in range(60)), "en", "a") for i in range(10)]
    rows = {r.doc_id: r for r in quality.quality_rules(docs_of(clean + junk + [(2000, "too short")])).collect()}
    assert sum(rows[i].kept for i, *_ in clean) >= 698 and not any(rows[i].kept for i, *_ in junk)
    assert rows[2000].base_failed and rows[2000].distance is None
    kept = quality.keep_good(docs_of(clean + junk + clean[:1]))
    assert kept.columns == docs_of([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in rows if rows[i].kept] + [0])
    odd = quality.quality_rules(docs_of(ODD)).collect()
    assert len(odd) == len(ODD) and sorted((r.doc_id, *r[1:6]) for r in odd if r.doc_id) == sorted((r[0], *brute_counts(r[1])) for r in ODD if r[0])
    assert quality.quality_rules(docs_of([])).count() == 0 and quality.keep_good(docs_of([])).count() == 0


def test_quality_rules_find_outliers_that_are_alike(docs_of):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(40, 400))]
    clean = [(i, " ".join(text())) for i in range(700)]
    junk = [(1000 + i, " ".join(w + "%" * (j % 2) for j, w in enumerate(text()))) for i in range(300)]  # 0.5 symbols a word
    rows = {r.doc_id: r.kept for r in quality.quality_rules(docs_of(clean + junk)).collect()}
    assert not any(rows[i] for i, _ in junk) and sum(rows[i] for i, _ in clean) >= 698


def test_mixing(docs_of):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), "en", rng.choice("aaaaaaaaabbc")) for i in range(1500)]
    docs = docs_of(rows)
    draws = mixing.mixed_draws(docs, max_repeats=2.0).collect()
    tokens = {s: sum(r[1].count("w") for r in rows if r[3] == s) for s in "abc"}
    drawn = Counter()
    for r in draws:
        drawn[r.source] += r.n_tokens
    assert all((r.source, r.doc_id) for r in draws) and {r.doc_id for r in draws} == set(range(1500))
    weights = {r.source: r.weight for r in draws}
    assert abs(sum(weights.values()) - 1) < 1e-9
    use = {s: drawn[s] / tokens[s] for s in "abc"}
    assert abs(use["a"] - 1) < 1e-9 and abs(use["c"] - 2) < 0.15 and use["a"] <= use["b"] <= use["c"]
    for s in "abc":  # each quota is met by the shortest prefix of the permutation
        assert abs(drawn[s] / sum(drawn.values()) - weights[s]) < 0.01
    assert Counter(r.doc_id for r in mixing.mix(docs, 2.0).collect()) == Counter(r.doc_id for r in draws)
    exact = {(r["pass"], r.block, r.position, r.source) for r in draws}
    assert len(exact) == len(draws)
    flat = mixing.mixed_draws(docs, max_repeats=None, target_entropy=math.log(3) - 1e-4)
    w = {r.source: r.weight for r in flat.select("source", "weight").distinct().collect()}
    assert abs(-sum(x * math.log(x) for x in w.values()) - math.log(3)) < 1e-3
    small = mixing.mixed_draws(docs, max_repeats=None, budget_tokens=0.5 * sum(tokens.values())).collect()
    assert abs(sum(r.n_tokens for r in small) / sum(tokens.values()) - 0.5) < 0.02 and len({r.doc_id for r in small}) == len(small)
    odd = mixing.mix(docs_of(ODD), 1.0)
    assert odd.count() >= len(ODD) and odd.columns == docs.columns
    assert mixing.mixed_draws(docs_of([])).count() == 0 and mixing.mix(docs_of([])).count() == 0


def test_mixing_plan_has_no_python(docs_of):
    plan = mixing.mixed_draws(docs_of(ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_best_fit():
    bins, offsets, caps = packing.best_fit([60, 50, 40, 30, 20], [64, 128], 8)
    used = Counter()
    for b, o, s in zip(bins, offsets, [60, 50, 40, 30, 20]):
        assert used[b] == o
        used[b] += s
    assert all(used[b] <= caps[b] for b in used) and sum(caps) == 256
    assert packing.best_fit([10], [16, 64, 128], 8)[2] == [16]  # downsized to its contents
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 512) for _ in range(3000)), reverse=True)
    bins, _, caps = packing.best_fit(sizes, [128, 256, 512])
    fill = Counter()
    for b, s in zip(bins, sizes):
        fill[b] += s
    assert all(fill[b] <= caps[b] for b in fill) and sum(caps) <= 1.02 * sum(sizes)


def test_packing_keeps_every_token(docs_of):
    rows = ODD + [(100 + i, "t " * (i * 37 % 900)) for i in range(300)]
    got = packing.pack(docs_of(rows), capacities=(64, 256), shard_pieces=100).collect()
    per = Counter()
    for r in got:
        per[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t, *_ in rows:
        want[i] += brute_counts(t)[0]
    assert per == want
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.n_tokens))
        else:
            assert r.bin_id is None
    for (_, cap), items in bins.items():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= cap and (cap == 64 or at > 64)
    assert len({b for b, _ in bins}) == len(bins)
    assert packing.pack(docs_of([])).count() == 0


def test_classifier_learns_and_holds_out(spark, docs_of):
    import zlib
    rng = random.Random(7)
    good, bad = "the cat sat on a mat and then went home".split(), "BUY!! NOW!! $$$ WIN!! CASH!! FREE!!".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(5, 60)))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(401, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs_of(rows + ODD[1:3] + ODD[-1:]), labels).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    assert np.mean([by[i].predicted == i % 2 for i in range(10, 600)]) > 0.98
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = classifier.classify(docs_of(rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert classifier.classify(docs_of([]), labels).count() == 0


def test_classifier_features_do_not_depend_on_batches():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 50))).encode() for _ in range(50)]
    weight = np.random.default_rng(0).normal(size=classifier.KINDS << classifier.BUCKET_BITS).astype(np.float32)
    together = classifier.score(texts, weight, 0.1)
    assert together.tolist() == [classifier.score([t], weight, 0.1)[0] for t in texts]
    words = list(classifier.features([b"ab cd", b"", b"ab", b" xy ab ab"]))[3]
    first, last = words[1], words[2]
    assert (last - first).tolist() == [2, 0, 1, 3] and words[0][0] == words[0][first[2]] == words[0][last[3] - 1]


def duck(tables):
    import duckdb
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con


def compare(sdf, con, sql):
    cols = sorted(sdf.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows_of([r.asDict() for r in sdf.collect()], cols) == rows_of([dict(zip(names, r)) for r in cur.fetchall()], cols)


CONVERSATIONS = [(1, 0, "system", "be\\l [x] <s> \\"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] \n <s>[user] é漢"), (2, 0, "assistant", "first"),
                 (2, 1, None, "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 1, "assistant", "late"), (4, 0, "user", "early"), (None, 0, "[user]", "\\b"),
                 (5, 0, "system", "only"), (6, 0, "user", ""), (6, 1, "assistant", "")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "x") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, valid string")
    compare(chat.conversation_digests(chat.with_probe(rows)), duck({"conversations": rows.toPandas().astype({"conv_id": "Int64"})}), chat.ORACLE_SQL)
    out = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    assert [out[i].valid for i in (1, 2, 3, 4, 5, 6)] == [True, False, False, True, False, True]
    r = out[1]
    assert "".join(s.text for s in r.segments) == r.formatted and r.formatted.count("</s>") == 3
    assert [chat.TEMPLATE.open not in s.text[1:] for s in r.segments]
    (span,) = r.loss_spans
    assert [s.text for s in r.segments if s.loss] == [r.formatted[span.start: span.start + span.length]]
    back = {x.conv_id: [tuple(t) for t in x.turns] for x in chat.read_back(chat.format_conversations(rows)).collect()}
    assert back[1] == [("system", "be\\l [x] <s> \\"), ("user", ""), ("assistant", "</s>[INST] \n <s>[user] é漢")] and back[None] == [("[user]", "\\b")]
    assert chat.format_conversations(rows.limit(0)).count() == 0
    plan = chat.conversation_digests(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://A.Example.com/en/x?q#f", "https://www.example.com/en/", "https://m.www.example.com/en/y",
        "http://badexample.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://x.net/fr", "http://x.org?a=/com/", "http://a#b", "://net/es/", "a://b://com/", "http://x.com/\n?z"]


def test_url_filter(spark):
    rows = [(i, u, "h", "clash") for i, u in enumerate(URLS + URLS[:8])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = url_filter.judge_urls(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")
    compare(got, duck({"pages": pages.drop("rule").toPandas()}), url_filter.ORACLE_SQL)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, [(None, "block")])).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = [f"site{i}.example/p{i}/" for i in range(3000)]
    rules = spark.createDataFrame([(x, "block") for x in listed], "rule string, rule_verdict string")
    words = url_filter.bloom_filter(rules, len(listed))
    hashed = lambda xs: np.array([r[0] for r in spark.createDataFrame([(x,) for x in xs], "k string").selectExpr("xxhash64(k)").collect()], np.int64)
    assert url_filter._possible(words, hashed(listed)).all()
    assert url_filter._possible(words, hashed([f"other{i}.example/" for i in range(3000)])).mean() < 0.02
    pages = spark.createDataFrame([(i, f"http://a.{x}z") for i, x in enumerate(listed[:50])], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.withColumnRenamed("rule_verdict", "verdict")).collect()} == {"block"}


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (5, "u", big), (3, None, big), (5, "v", big), (None, "n", big), (7, "s", "small"), (8, "s", "small"), (9, "e", None), (10, "e", ""), (11, "o", big + "!")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    root = scratch(spark, "warc-test")
    manifest = warc.write_warc(pages, root, roll_bytes=500).collect()
    assert sum(m.records for m in manifest) == len(rows) and len(manifest) > 2
    got = sorted(map(tuple, warc.read_warc(spark, root).drop("url").collect()), key=repr)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = html == big and i != 5
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=repr)
    again = warc.write_warc(pages, scratch(spark, "warc-test"), roll_bytes=500).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, manifest))  # the same bytes each time
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_warc_reader_refuses_changed_files(spark):
    from pyarrow import fs
    root = scratch(spark, "warc-test")
    name = warc.write_warc(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), root).first()["name"]
    files, base = fs.FileSystem.from_uri(root)
    with files.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(warc.record(1, "u", b"other", None, "2024-01-01"))
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_warc(spark, root).collect()


def brute_search(rows, queries, k):
    bags = [(i, Counter((t or "").encode().lower().split())) for i, t in rows]
    n, length = len(bags), [sum(b.values()) for _, b in bags]
    mean = sum(length) / max(1, n) or 1.0
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in queries:
        scores = []
        for (i, b), dl in zip(bags, length):
            s = sum(c * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * dl / mean))
                    for w, c in Counter((text or "").encode().lower().split()).items() if w in b)
            if s > 0:
                scores.append((-round(s, 9), i if i is not None else 1 << 63))
        out += [(q, r + 1, i if i < 1 << 63 else None, round(-s, 6)) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_search_is_exact(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (None, rows[3][1]), (502, None), (503, "")]
    monkeypatch.setattr(search, "SHARD_TOKENS", 700)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    docs = docs_of(rows)
    queries = [(i, t) for i, t in rows if i is not None and i % 50 == 0] + [(7000, "W1 w1 nosuchword"), (7001, ""), (7002, None)]
    got = search.bm25_search(docs, spark.createDataFrame(queries, "query_id long, text string"), 5).collect()
    assert sorted([(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got], key=repr) == brute_search(rows, queries, 5)
    assert search.bm25_search(docs_of([]), search.stated_queries(docs)).count() == 0
    assert search.bm25_search(docs, search.stated_queries(docs_of([]))).count() == 0
    # blocks whose bound is under the bar are not read, and the result stays the same
    blob = search.build_index(docs).first()["blob"]
    shard = search.Shard(bytes(blob), 30.0)
    terms, counts = search.term_counts(rows[3][1].encode())
    ids, scores = shard.search(terms, counts.astype(float), 3, -math.inf)
    again, _ = shard.search(terms, counts.astype(float), 3, scores.min() - 1e-8)
    assert sorted(ids) == sorted(again)


@pytest.mark.parametrize("name", ["op6_chat_format", "op7_url_filter", "op9_warc"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])


def test_queries_match_brute_force(spark):
    docs = table(spark, SF, "documents").toPandas()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    q = entry.queries()
    from tests.llm.test_dedup import brute_dedup, brute_fingerprint, brute_roots
    fps = [brute_fingerprint(t) for _, t in rows]
    least = {}
    for (i, _), r in zip(rows, roots := brute_roots(fps)):
        least[r] = min(least.get(r, i), i)
    want = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots)]
    assert sorted(map(tuple, q["op1_simhash"](spark, SF).collect())) == sorted(want)
    assert sorted(map(tuple, q["op5_suffix_dedup"](spark, SF).collect())) == sorted(brute_dedup(rows))
    rules = {r.doc_id: r for r in q["op8_quality_rules"](spark, SF).collect()}
    for i, t in rows:
        c = brute_counts(t)
        assert tuple(rules[i])[1:6] == c and rules[i].base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (rules[i].base_failed and rules[i].kept)
    found = q["op10_bm25_search"](spark, SF).collect()
    assert sorted([(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in found], key=repr) == brute_search(rows, [r for r in rows if r[0] % 50 == 0], 10)


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "temperature_mixing", "best_fit_packing"]
    before, good = docs, {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted(ids(kept)) == sorted(good) and kept.columns == before.columns
    single = corpus_pipeline.simhash_near_dedup(spark, kept, SF)
    assert sorted(ids(single)) == sorted({r.component_id for r in simhash.simhash_groups(kept).collect()})
    cut = corpus_pipeline.suffix_array_dedup(spark, single, SF)
    sizes = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.suffix_dedup(single).collect()}
    assert {r.doc_id: len(r.text.encode()) for r in cut.collect()}.keys() <= sizes.keys() and cut.columns == before.columns
    mixed = corpus_pipeline.temperature_mixing(spark, cut, SF)
    assert set(ids(mixed)) == set(ids(cut)) and max(Counter(ids(mixed)).values()) <= 2 and mixed.columns == before.columns
    total = sum(r.n_tokens for r in corpus_pipeline.run(spark, SF).collect())
    assert total == mixed.select(packing.word_count("text").alias("n")).agg({"n": "sum"}).first()[0]
