"""SimHash groups and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from statlake.llm import deep_shallow, simhash, suffix_dedup
from statlake.llm.components import connected_components
from tests.llm.conftest import ODD


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i: i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, distance=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    texts = ["", " ", "A", "a B", "Äb c d", *(" ".join(rng.choice("ab cd Ef É 漢".split()) for _ in range(rng.randint(3, 60))) for _ in range(40))]
    for t in texts:
        assert simhash.simhash(t.encode()) == brute_fingerprint(t)
    long = "x y z " * 40_000
    assert simhash.simhash(long.encode()) == simhash.simhash(("x y z " * 40_000).upper().encode())


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_have_the_components_of_all_close_pairs(spark, distance):
    rng = random.Random(distance)
    fps = [0, 1, (1 << 64) - 1, 1 << 63]
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            flips = 0
            for _ in range(rng.randint(0, 5)):
                flips ^= 1 << rng.randrange(64)
            base ^= flips
            fps.append(base)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, rows_at_once=50)
    pairs = [(r.hi, r.lo) for r in links.collect()]
    assert all(hi > lo and bin((hi ^ lo) & ((1 << 64) - 1)).count("1") <= distance for hi, lo in pairs) and len(pairs) == len(set(pairs))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_roots(fps, distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_long_chain_and_hub(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(1, 30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 99 for i in range(1, 30)}
    assert connected_components(spark.createDataFrame([], "hi long, lo long")).count() == 0


def test_groups_of_odd_rows(docs_of):
    rows = simhash.simhash_groups(docs_of(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[5] == [("0" * 16, 2)] and by[4] == 2 * [(by[1][0][0], 1)]
    assert sorted(c for _, c in by[None]) == [1, 2]
    kept = simhash.keep_one_per_group(docs_of(ODD))
    assert kept.columns == docs_of(ODD).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7]
    assert simhash.simhash_groups(docs_of([])).count() == 0 and simhash.keep_one_per_group(docs_of([])).count() == 0
    only = simhash.keep_one_per_group(docs_of([(None, "a b c d"), (None, "a b c d"), (None, "")])).collect()
    assert sorted(r.text for r in only) == ["", "a b c d"]


def brute_dedup(rows, length=50):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p: p + length]
            first[w] = min(first.get(w, 1 << 63), i if i is not None else (1 << 63) - 1)
    for i, t in rows:
        b, me = (t or "").encode(), i if i is not None else (1 << 63) - 1
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p: p + length]] < me:
                mark[p: p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        runs = sum(1 for p in range(len(b)) if mark[p] and (p == 0 or not mark[p - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_is_exact(docs_of, seed, monkeypatch):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdeé "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 140))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts.append(rng.choice([p, p[cut:], p[:cut], "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))]))
        rows.append((rng.choice([i, i, i, i // 2, None]), "".join(parts)))
    rows += [(1000, "z" * 500), (1001, "z" * 700), (1002, "z" * 49), (1003, None), (1004, "")]
    if seed == 2:
        monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 100)
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 64)
    got = suffix_dedup.suffix_dedup(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_dedup(rows), key=repr)


def shared_passage(n):
    """``n`` documents with one passage between texts of their own."""
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    passage = word(400)
    return [(i, word(120) + passage + word(120)) for i in range(n)] + [(n, "-=" * 300), (n + 1, word(9) + "-=" * 200), (n + 1, "z" * 300)]


def largest_group(rows, hot):
    """Most different segments that one group of a bucket gets."""
    bucket, blob = suffix_dedup._deal([(i, 0, 0, t.encode()) for i, t in rows], 50, 16, hot)
    count = {}
    for b, x in zip(bucket, blob):
        _, segments, _, _ = suffix_dedup._unpack(x)
        for low in segments["low"].tolist():
            count[b, low] = count.get((b, low), 0) + 1
    return max(count.values())


def test_a_shared_passage_does_not_make_one_large_group(docs_of):
    rows = [r for r in shared_passage(400) if r[0] < 400]
    hot = suffix_dedup.hot_minimizers(docs_of(rows), 50, 100)
    assert 1 <= len(hot) <= 4
    assert largest_group(rows, suffix_dedup._NONE) > 300 and largest_group(rows, hot) < 100
    assert len(suffix_dedup.hot_minimizers(docs_of(rows))) == 0 == len(suffix_dedup.hot_minimizers(docs_of([]), 50, 1))


@pytest.mark.parametrize("block", [1500, 12 << 20])
def test_windows_of_hot_minimizers_are_decided_alike(docs_of, block, monkeypatch):
    rows = shared_passage(40)
    every = np.unique(np.concatenate([suffix_dedup.window_hashes(np.frombuffer(t.encode(), np.uint8), 50) for _, t in rows]))
    want = sorted(brute_dedup(rows))
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    for hot in (every, every[::2]):
        monkeypatch.setattr(suffix_dedup, "hot_minimizers", lambda *_, hot=hot: hot)
        assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs_of(rows)).collect())) == want


def test_suffix_dedup_of_odd_and_empty_tables(docs_of):
    got = suffix_dedup.suffix_dedup(docs_of(ODD)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_dedup([r[:2] for r in ODD]), key=repr)
    assert suffix_dedup.suffix_dedup(docs_of([])).count() == 0
    base = "Eine längere Passage mit Umlauten, die zweimal vorkommt: äöü und noch etwas mehr."
    docs = docs_of([(1, base), (2, base), (3, "Vorn. " + base + " Hinten."), (4, None), (5, "")])
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {1, 3, 4, 5} and rows[1].text == base and rows[3].text == "Vorn.  Hinten." and rows[3].n_chars == 14


def test_equal_suffixes_and_blind_trie():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"ab") for _ in range(400)) + b"q" * 80
    text = np.frombuffer(raw + bytes(8), np.uint8)
    start = np.arange(420)
    group = start % 2
    got = {tuple(sorted(x)) for x in deep_shallow.equal_suffixes(text, start, group, 30)}
    want = {}
    for s in range(420):
        want.setdefault((s % 2, raw[s: s + 30]), []).append(s)
    assert got == {tuple(v) for v in want.values() if len(v) > 1}
    trie, strings = deep_shallow.BlindTrie(), [bytes(rng.choice(b"xyz") for _ in range(5)) for _ in range(300)]
    for i, s in enumerate(strings):
        trie.insert(s, i)
    assert [strings[x[0]] for x in trie.leaves()] == sorted(set(strings)) and sum(map(len, trie.leaves())) == 300
