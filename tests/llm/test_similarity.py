"""Near duplicates, decontamination and top-k against brute force."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, setsketch, top_k
from quillspark.llm.common import Scratch
from quillspark.llm.components import component_roots
from quillspark.llm.near_duplicates import near_duplicates


def texts(rng: random.Random) -> list[tuple[int | None, str | None]]:
    words = [f"w{i}" for i in range(400)]
    out, n = [], 0
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 12, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((n, rng.choice([" ", "\n", "  "]).join(copy).upper() if n % 3 else " ".join(copy)))
            n += 1
    return out + [(n, ""), (n + 1, None), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (None, "one"), (n + 5, "é ü " * 3000)]


def brute(rows, k: int, percent: int) -> dict:
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = texts(random.Random(k))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x")).repartition(3)
    got = near_duplicates(df, words=k, percent=80).collect()
    want = brute(rows, k, 80)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


def test_near_duplicates_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(7, "a b c")] * 3 + [(7, "quite other words here")], "doc_id long, text string")
    assert {(r.component_id, r.kept) for r in near_duplicates(same).collect()} == {(7, True)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(3, 3), (None, 4)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = component_roots(spark.createDataFrame(edges, "a long, b long").where("a is not null"), Scratch(spark, "t")).collect()
    assert {r.node: r.root for r in got} == {x: r for x, r in root.items() if r != x and (x != 4 or r != 4)}


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 1500
        both = round(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        regs = setsketch.registers(np.concatenate([a, b]), np.array([0, n]))
        union = setsketch.registers(np.unique(np.concatenate([a, b])), np.array([0]))
        assert (setsketch.merge(regs[0], regs[1]) == union[0]).all()
        above, below = np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()])
        assert abs(setsketch.likely_jaccard(above, below, np.array([n]), np.array([n]))[0] - share) < 0.1
    long = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    assert (setsketch.minima(long, np.array([0]))[0] == np.minimum(setsketch.minima(long[:70_000], np.array([0]))[0], setsketch.minima(long[70_000:], np.array([0]))[0])).all()


@pytest.mark.parametrize("both,own", [(8, 1), (80, 10), (800, 100)])
def test_pairs_at_the_threshold_are_found(both, own):
    """Pairs of similarity 0.8 share a key and are not cut by the likelihood: none of so many is lost."""
    rng, n = np.random.default_rng(both), 6000 if both < 800 else 1500
    least, lost = setsketch.least_estimate(0.8), 0
    for _ in range(n // 500):
        sets = rng.integers(0, 1 << 63, (500, both + 2 * own), dtype=np.uint64)
        flat = np.concatenate([np.concatenate([s[: both + own], s[:both], s[both + own :]]) for s in sets])
        regs = setsketch.registers(flat, np.arange(1000) * (both + own))
        a, b = regs[::2], regs[1::2]
        shares = (setsketch.band_keys(a) == setsketch.band_keys(b)).any(1)
        size = np.full(500, both + own)
        likely = setsketch.likely_jaccard((a > b).sum(1), (a < b).sum(1), size, size)
        lost += int((~shares | (likely < least)).sum())
    assert lost == 0


def windows(text: str | None, n: int = 10):
    w = decontaminate.words_of((text or "").encode())
    return [tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))] if w else []


@pytest.mark.parametrize("values,depth", [(3, 1), (3, 4), (1, 50), (2, 1000), (500, 7)])
def test_suffix_order(values, depth):
    rng = np.random.default_rng(depth)
    for n in (0, 1, 2, 300):
        ids = rng.integers(0, values, n)
        order = decontaminate.suffix_order(ids, depth).tolist()
        assert sorted(order) == list(range(n))
        heads = [(*ids[p : p + depth].tolist(), *[0] * (p + depth - n)) for p in order]
        assert heads == sorted(heads)


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (60, 50), (1 << 20, 7)])
def test_decontamination(spark, block, shard):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, ""), (51, None), (None, "v1 v2 v3"), (None, "v4 v4"), (3, "zz yy xx"), (60, "a " * 30), (61, "b a " * 9)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = items[rng.randrange(12)][1].upper().split()
        docs.append((i, "-".join(w)))
    docs += [(60, None), (61, "ZZ, yy; XX!"), (61, "ZZ, yy; XX!"), (62, "é" * 9), (63, "a " * 200), (64, "b a " * 50 + "v1 v2 v3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("own"))
    got = decontaminate.find_overlaps(df, bench, block_bytes=block, shard_words=shard).collect()
    assert len(got) == len(docs)
    by_text, whole = {}, []
    for name, t in items:
        name = None if name is None else str(name)
        whole.append((name, decontaminate.words_of((t or "").encode())))
        for w in windows(t):
            by_text.setdefault(w, set()).add(name)
    for r in got:
        w = decontaminate.words_of((r.text or "").encode())
        hit, names = set(), set()
        for g, found in by_text.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    names |= found
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(names, key=lambda n: (n is None, n or "")))
        longest = 0
        for _, x in whole:
            for j in range(len(x)):
                for i in range(len(w)):
                    n = 0
                    while j + n < len(x) and i + n < len(w) and x[j + n] == w[i + n]:
                        n += 1
                    longest = max(longest, n if n >= min(10, len(x)) else 0)
        assert (r.longest.words if r.longest else 0) == longest
        if longest:
            mine = w[r.longest.doc_word : r.longest.doc_word + longest]
            assert any(name == r.longest.item_id and x[r.longest.item_word : r.longest.item_word + longest] == mine for name, x in whole)
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench, block_bytes=block).collect()} == {r.doc_id for r in got if not r.n_hit}
    digests = {r.doc_id: r for r in decontaminate.overlap_digests(df, bench, block_bytes=block).collect()}
    assert all((digests[r.doc_id].n_items, digests[r.doc_id].items_sha256) == (len(r["items"]), hashlib.sha256(",".join(n for n in r["items"] if n).encode()).hexdigest()) for r in got)


def test_decontamination_of_repetitive_texts():
    began = time.time()
    tests = decontaminate.Tests([("a", b"again " * 400), ("b", b"x y " * 200)], 10)
    n_words, n_hit, _, items, longest = decontaminate._judged([b"again " * 300_000, b"x y " * 150_000], tests, 1 << 20)
    assert n_words == n_hit == [300_000, 300_000] and items == [["a"], ["b"]] and [x["words"] for x in longest] == [400, 400]
    assert time.time() - began < 30


def test_decontamination_without_items(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.overlap_digests(df, spark.createDataFrame([], "item_id long, text string")).first().n_hit == 0
    assert decontaminate.overlap_digests(df.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("k,block", [(3, 4096), (10, 2)])
def test_top_k(spark, k, block):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)).round(1)
    vectors[50:60] = vectors[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (1000, [float("nan")] * 8), (1100, [None] * 8), (1200, [float("inf")] * 8), (1300, [1.0])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=k, scale=16, query_block=block, range_rows=90).collect()
    whole = np.floor(16 * np.float32(vectors).astype(np.float64)).astype(int)
    want = set()
    for q in range(0, 400, 100):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:k]
        want |= {(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 9, size=(120, 4)).astype(float)
    ids = [0, 0, 0, 7, 7, *range(100, 215)]
    vectors[1] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, score string")
    got = top_k.top_k(df.repartition(5), F.col("vec_id") % 7 == 0, k=5, scale=1).collect()
    want = []
    for q in range(120):
        if ids[q] % 7 == 0:
            best = sorted((-int(vectors[q] @ vectors[c]), ids[c]) for c in range(120) if c != q)[:5]
            want += [(ids[q], r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_of_few(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(one, F.col("vec_id") == 0, scale=1).collect()] == [(0, 1, 1, 0)]
    assert top_k.top_k(one.where("false"), F.lit(True)).count() == 0
