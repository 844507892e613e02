"""Whole queries and the pipeline against plain versions: quality verdicts, mixing, packing, classifier steps, stages."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statlake.llm import chat, classifier, mixing, packing, quality, queries, search, simhash
from statlake.llm.common import table
from tests.llm.conftest import ODD
from tests.llm.test_corpus import brute_counts, brute_search
from tests.llm.test_dedup import brute_dedup, brute_fingerprint, brute_roots

SF = "/root/testdata/sf0.001"


# --- quality rules: the verdicts


def plain_features(c):
    n = max(c[0], 1)
    return [math.log1p(c[0]), math.log1p(c[1] / n), c[2] / n, math.log1p(c[3]), c[4] / n]


def distances(x, mean, inverse):
    return np.maximum(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), 0)


def moments(x):
    mean = x.mean(axis=0)
    return mean, x.T @ x / len(x) - np.outer(mean, mean)


def plain_starts(x):
    floors, k = np.array(quality.FLOORS), x.shape[1]
    mean, cov = moments(x)
    out = [(mean, cov + np.diag(floors))]
    width = np.sqrt(floors) / 32
    bins = np.floor(x / width).astype(int)
    middle = lambda v: sorted(v)[(len(v) - 1) // 2]
    mid = np.array([middle(bins[:, i]) for i in range(k)])
    dev = np.array([middle(abs(bins[:, i] - mid[i])) for i in range(k)])
    med, scale = (mid + 0.5) * width, np.sqrt((1.4826 * width * dev) ** 2 + floors)
    z = (x - med) / scale
    for kind in (1, 2, 3):
        shape = np.eye(k)
        if kind > 1:
            m, c = moments(np.tanh(z) if kind == 2 else z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None])
            c = c + (np.outer(m, m) if kind == 3 else 0)
            spread = np.sqrt(np.maximum(np.diag(c), 0))
            held = np.ix_(spread > 1e-9, spread > 1e-9)
            shape[held] = c[held] / np.outer(spread, spread)[held]
        out.append((med, (shape + 1e-6 * np.eye(k)) * np.outer(scale, scale)))
    return out


def plain_mcd(groups, steps=12):
    """(mean, cov) per group: all groups step until none of them moves."""
    half, reweight = quality._consistency(0.5), quality._consistency(0.975)
    floors = np.diag(quality.FLOORS)
    now = {g: plain_starts(x) for g, x in groups.items()}
    det = lambda c: np.linalg.slogdet(c)[1]
    for step in range(steps):
        moved, after = False, {}
        for g, x in groups.items():
            after[g] = []
            for mean, cov in now[g]:
                bins = np.floor(np.log2(distances(x, mean, np.linalg.inv(cov)) + 1e-6) * 16)
                last = np.sort(bins)[math.ceil(0.5 * len(x)) - 1]
                m, c = moments(x[bins <= last])
                after[g].append((m, half * c + floors))
                moved |= det(cov) - det(after[g][-1][1]) > 1e-3
        now = after
        if step and not moved:
            break
    out = {}
    for g, x in groups.items():
        mean, cov = min(now[g], key=lambda e: round(det(e[1]), 12))
        m, c = moments(x[distances(x, mean, np.linalg.inv(cov)) <= quality.REWEIGHT])
        out[g] = (m, reweight * c + floors)
    return out


def plain_kept(docs):
    """Verdict of each (text, lang, source)."""
    counts = [brute_counts(t) for t, _, _ in docs]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    groups = defaultdict(list)
    for (_, lang, source), c, f in zip(docs, counts, failed):
        if not f:
            for g in ((lang, source), (lang,), ()):
                groups[g].append(plain_features(c))
    groups = {g: np.array(x) for g, x in groups.items()}
    fitted = plain_mcd(groups)
    out = []
    for (_, lang, source), c, f in zip(docs, counts, failed):
        if f:
            out.append(False)
            continue
        w, up = (len(groups[g]) / (len(groups[g]) + 50) for g in ((lang, source), (lang,)))
        mean, cov = (w * own + (1 - w) * (up * above + (1 - up) * top) for own, above, top in
                     zip(fitted[lang, source], fitted[lang,], fitted[()]))
        out.append(bool(distances(np.array([plain_features(c)]), mean, np.linalg.inv(cov))[0] <= quality.CUTOFF))
    return out


def test_verdicts_of_the_whole_query(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()
    got = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, SF).collect()}
    want = dict(zip([r.doc_id for r in rows], plain_kept([r[1:] for r in rows])))
    assert got == want and 0 < sum(want.values()) < len(want)


def test_small_groups_have_the_least_determinant(spark):
    """Every half of 11 rows is tried; the verdicts on clear outliers are those of the best half."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    half, reweight, floors = quality._consistency(0.5), quality._consistency(0.975), np.diag(quality.FLOORS)
    for g in range(6):
        x = rng.normal(size=(11, 5)) * np.sqrt(quality.FLOORS) * 2
        x[:3] += rng.choice([-1, 1], (3, 5)) * np.sqrt(quality.FLOORS) * 40
        halves = [moments(x[list(s)]) for s in itertools.combinations(range(11), 6)]
        mean, cov = min(halves, key=lambda e: np.linalg.slogdet(half * e[1] + floors)[1])
        m, c = moments(x[distances(x, mean, np.linalg.inv(half * cov + floors)) <= quality.REWEIGHT])
        want[g] = (distances(x, m, np.linalg.inv(reweight * c + floors)) <= quality.CUTOFF).tolist()
        rows += [(str(g), *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in quality._FEATURES))
    for r in quality.minimum_covariance_determinant(df, 6).collect():
        x = np.array([v[1:] for v in rows if v[0] == r.grp])
        assert (distances(x, np.array(r["mean"]), np.linalg.inv(np.array(r["cov"]).reshape(5, 5))) <= quality.CUTOFF).tolist() == want[int(r.grp)]
        assert 1 <= r.steps <= quality.STEPS


def test_estimates_are_alike_however_they_reach_the_rows(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    docs = docs_of([(i, " ".join(rng.choice("ab cde f ghij klm nopq".split()) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 90))),
                     rng.choice(["en", "de"]), rng.choice(["a", "b"])) for i in range(120)])
    verdicts = lambda: sorted((r.doc_id, r.kept, round(r.distance, 6)) for r in quality.quality_rules(docs).collect())
    sent = verdicts()
    monkeypatch.setattr(quality, "SENT_ESTIMATES", 0)
    assert verdicts() == sent


# --- SimHash stage, chat, search: repeated ids


def test_no_text_is_lost_where_an_id_repeats(docs_of):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 500)) for _ in range(120))
    a, b, c = text(), text(), text()
    near = b + " tail"
    rows = [(5, a), (5, b), (3, near), (7, c), (7, c), (None, text()), (None, c), (8, a + " x")]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(fps)
    least = {}
    for (i, t), f, r in zip(rows, fps, roots):
        key = (1 << 63 if i is None else i, f)
        least[r] = min(least.get(r, (key, t)), (key, t))
    kept = simhash.keep_one_per_group(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in least.values())


def test_given_conversation_with_the_probes_id_is_replaced(spark):
    rows = spark.createDataFrame([(-1, 0, "user", "mine"), (1, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.conversation_digests(chat.with_probe(rows)).collect()}
    assert got == {-1: 2, 1: 1, None: 1}


def test_repeated_queries_are_one_and_texts_of_one_id_apart(spark, docs_of):
    rows = [(i, f"w{i % 7} w{i % 3} w{i}") for i in range(60)]
    asked = [(50, rows[50][1]), (50, rows[50][1]), (50, rows[10][1]), (0, rows[0][1])]
    got = search.bm25_search(docs_of(rows), spark.createDataFrame(asked, "query_id long, text string"), 5).collect()
    want = brute_search(rows, sorted(set(asked)), 5)
    assert sorted([(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got], key=repr) == want
    assert len({(r.query_id, r.query_key) for r in got}) == 3


def test_block_max_wand_skips_blocks(docs_of, monkeypatch):
    """With the final bar blocks are skipped, and the best documents stay the same."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(30))) for i in range(600)] + [(700, "rare rare w1 w2")]
    shard = search.Shard(bytes(search.build_index(docs_of(rows).coalesce(1)).first()["blob"]), 30.0)
    terms, counts = search.term_counts(b"rare w1 w2 w3")
    weights = counts * np.array([1.0, 1.0, 1.0, 1.0])
    ids, scores = shard.search(terms, weights, 5, -math.inf)
    read = []
    plain = np.bincount
    monkeypatch.setattr(search.np, "bincount", lambda *args: read.append(args[2]) or plain(*args))
    again, _ = shard.search(terms, weights, 5, scores[-1])
    scored = sum(read[2:]) // search.BLOCK_DOCS  # after the two bounds of all blocks
    assert sorted(again) == sorted(ids) and 0 < scored < shard.blocks / 2


# --- mixing, packing, classifier


def test_mixing_draws_the_shortest_prefix_of_every_pass(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "source", packing.word_count("text").alias("n"), *[
        mixing._order(F.lit(p), F.col("doc_id")).alias(f"p{p}") for p in (1, 2, 3)]).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.n
    share = {s: t / sum(tokens.values()) for s, t in tokens.items()}
    ratio = max(share.values()) / min(share.values())
    power = max(0.0, 1 - math.log(2) / math.log(ratio)) if ratio > 1 else 0.0
    scarce = max(v ** (1 - power) for v in share.values())
    want = Counter()
    for s in tokens:
        quota = share[s] ** power * sum(tokens.values()) * scarce
        full = int(quota / tokens[s] + 1e-6)
        own = [r for r in rows if r.source == s]
        want.update({(r.doc_id, p): 1 for r in own for p in range(1, full + 1)})
        rest, run = quota - full * tokens[s], 0
        if rest >= 1e-6 * tokens[s]:
            for r in sorted(own, key=lambda r: r[f"p{full + 1}"]):
                if run >= rest * (1 - 1e-6):
                    break
                want[r.doc_id, full + 1] += 1
                run += r.n
    got = queries.op2_mixing(spark, SF).collect()
    assert Counter((r.doc_id, r["pass"]) for r in got) == want
    blocks = defaultdict(list)
    for r in got:
        blocks[r.source, r["pass"], r.block].append(r.position)
    assert all(sorted(b) == list(range(1, len(b) + 1)) for b in blocks.values())


def plain_best_fit(sizes, capacities, bin_cost):
    """Best fit by looking at every bin."""
    bins, place = [], []  # bin: [room, time of its last change, used]
    for i, size in enumerate(sizes):
        fitting = [b for b in range(len(bins)) if bins[b][0] >= size]
        if fitting:
            b = min(fitting, key=lambda b: (bins[b][0], -bins[b][1]))
        else:
            free, left = sum(b[0] for b in bins), sum(sizes[i + 1:])
            price = min((c + bin_cost) / c for c in capacities)
            cost = {c: c + bin_cost - price * min(c - size, max(0, min(sum(s for s in sizes if s <= c - size), left) - free))
                    for c in capacities if c >= size}
            bins.append([min(cost, key=lambda c: (cost[c], c)), i, 0])
            b = len(bins) - 1
        place.append((b, bins[b][2]))
        bins[b] = [bins[b][0] - size, i, bins[b][2] + size]
    return [(b, at, min(c for c in capacities if c >= bins[b][2])) for b, at in place]


def test_packing_of_the_whole_query(spark):
    got = [r for r in queries.op3_packing(spark, SF).collect() if r.n_tokens]
    shards = defaultdict(list)
    for r in got:
        shards[r.bin_id >> 32].append(r)
    for shard, rows in shards.items():
        rows.sort(key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        want = plain_best_fit([r.n_tokens for r in rows], sorted(packing.CAPACITIES), packing.BIN_COST)
        assert [(r.bin_id - (shard << 32), r.offset, r.capacity) for r in rows] == want
    docs = {r.doc_id: brute_counts(r.text)[0] for r in table(spark, SF, "documents").collect()}
    per = defaultdict(list)
    for r in got:
        per[r.doc_id].append((r.start, r.n_tokens))
    for doc, n in docs.items():
        assert sorted(per.get(doc, [])) == [(at, min(4096, n - at)) for at in range(0, n, 4096)]


def test_bins_do_not_depend_on_the_layout(docs_of):
    docs = docs_of([(i % 200, "t " * (i * 37 % 900)) for i in range(400)])
    packed = [sorted(map(tuple, packing.pack(d, shard_pieces=50).collect())) for d in (docs.repartition(3), docs.repartition(7, "text"))]
    assert packed[0] == packed[1]


def test_classifier_steps_follow_the_gradient():
    rng = np.random.default_rng(5)
    share, vectors = rng.random(6), rng.normal(size=(6, 4))
    output, bias = rng.normal(size=(2, 4)), rng.normal(size=2)
    for y in (0, 1):
        loss, *grads = classifier.gradient(share, vectors, output, bias, y)
        for array, grad in zip((vectors, output, bias), grads):
            for at in np.ndindex(array.shape):
                moved = array.copy()
                moved[at] += 1e-6
                args = [moved if a is array else a for a in (vectors, output, bias)]
                assert abs((classifier.gradient(share, *args, y)[0] - loss) / 1e-6 - grad[at]) < 1e-4


def test_subwords_stay_inside_a_word():
    """Every n-gram lies in one word with its border marks; equal ones share a bucket."""
    for n, (bucket, first, last) in zip(classifier.GRAMS, classifier.features([b"ab c\tabd  ab"])):
        text = b"ab c abd  ab"
        want = [text[i: i + n] for i in range(len(text) - n + 1) if b" " not in text[i + 1: i + n - 1] and text[i: i + n] != b"  "]
        got = bucket[first[0]: last[0]].tolist()
        assert len(got) == len(want) and len(set(got)) == len(set(want))


# --- the pipeline


def pieces(rows):
    return sorted(((r.doc_id, r.piece, r.start, r.n_tokens) for r in rows), key=repr)


def plain_pipeline(docs):
    """(doc_id, text, source) rows that reach packing, from (doc_id, text, lang, source), and how often, stage by stage."""
    kept = [d for d, k in zip(docs, plain_kept([d[1:] for d in docs])) if k]
    fps = [brute_fingerprint(d[1]) for d in kept]
    groups = {}
    for d, f, r in zip(kept, fps, brute_roots(fps)):
        groups.setdefault(r, []).append((1 << 63 if d[0] is None else d[0], f, d))
    single = [min(g, key=lambda x: x[:2])[2] for g in groups.values()]
    return single


@pytest.mark.parametrize("stages", [2])
def test_first_stages_against_plain_versions(spark, docs_of, stages):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()] + [(*r, None, None)[:4] for r in ODD]
    docs = docs_of(rows)
    for _, stage in corpus_pipeline.STAGES[:stages]:
        docs = stage(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(
        ((d[0], d[1]) for d in plain_pipeline([(*r, "en", "a")[:4] if len(r) < 4 else r for r in rows])), key=repr)


def test_pipeline_of_odd_clashing_and_empty_tables(spark, docs_of, tmp_path):
    """Odd rows, columns named like those that the stages use, and no rows: run() returns pieces of what the stages keep."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = ODD + [(100 + i, " ".join(word() for _ in range(rng.randint(25, 60))), rng.choice(["en", None]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [rows[-1], (None, rows[-2][1], "en", "a")]
    clash = docs_of(rows).withColumns({c: F.lit("x") for c in ("id", "fp", "root", "again", "grp", "pass", "piece", "mix_key", "kept", "distance")})
    for name, df in (("odd", clash), ("none", clash.limit(0))):
        (tmp_path / name).mkdir()
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if name == "none":
            assert not got
            continue
        texts = Counter(r.doc_id for r in got if r.piece == 0)
        assert texts and set(texts) <= {r[0] for r in rows} and sum(r.n_tokens for r in got) > 0
        kept = plain_kept([(*r, "en", "a")[1:4] if len(r) < 4 else r[1:4] for r in rows])
        assert set(texts) <= {r[0] for r, k in zip(rows, kept) if k}
