"""The n-gram join against brute force, with large blocks cut to tiles."""

import random
import re

import numpy as np
import pytest

from plumbline.llm import fingerprint, ngram_join


def brute(texts, size, num, den):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (t or "").encode()))
        sets[i] = {b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({b" ".join(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = rng.choice(texts)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind < 0.7:
            text = " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(40))])
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 6, 20, 90])))
        texts.append((i, text))
    return texts + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "É LONE Word"), (n + 4, "É lone word"), (n + 5, "x " * 3000)]


@pytest.mark.parametrize(("size", "num", "den", "chunk"), [(3, 90, 100, 400_000), (5, 80, 100, 200)])
def test_join_equals_brute_force(spark, size, num, den, chunk):
    texts = corpus(size)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, size, num, den, chunk).collect()}
    assert got == brute(texts, size, num, den)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_similar_sets_share_postings(num, den):
    """The argument of the candidates, on random pairs around the threshold."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 160))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if len(y) and den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y)):
            met += 1
            (a, most_a), (b, most_b) = ngram_join.postings(x, num, den), ngram_join.postings(y, num, den)
            assert len(np.intersect1d(a, b)) >= max(most_a, most_b)
            assert 1 <= most_a <= len(a) <= len(x)
    assert met > 300


def test_hot_postings_lose_no_link(spark):
    """A third of all rows near copies of each other, a passage in most of the others, and one key with a third of the rows."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base, passage = rng.sample(words, 80), rng.sample(words, 60)
    texts = []
    for i in range(240):
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif i % 3 == 1:
            w = passage + rng.sample(words, rng.randrange(0, 40))
        else:
            w = rng.sample(words, rng.randrange(1, 90))
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for size, num, chunk in ((3, 90, 400_000), (5, 80, 3000)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, size, num, 100, chunk).collect()}
        assert got == brute(texts, size, num, 100)


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, "x", 4), (2, "a b c d e f", 5, 6, "y", 8), (3, "other words stand here now", 9, 0, "z", 2), (3, "third", 9, 0, "z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, again int, Other string, node int")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.gone) for r in kept.collect()) == [(1, 1), (3, 9)]


def test_odd_rows(spark):
    long = "a b c d e f g h"
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (None, long, 0), (3, long, 0), (4, "q r s t u v", 0), (4, long, 0)], "doc_id long, text string, block int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df, 3, 90, 100).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (3, 1), (4, 1), (4, 1)]
    assert ngram_join.jaccard_components(df.where("false"), 3, 90, 100).count() == 0
    kept = ngram_join.keep_one(df, 3, 90, 100)
    assert kept.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1]


def test_merge():
    found, times = ngram_join.merge([np.array([0, 2, 5]), np.array([2, 5]), np.array([5])])
    assert (found.tolist(), times.tolist()) == ([0, 2, 5], [1, 2, 3])
    assert ngram_join.merge([np.arange(600)] * 2)[1].tolist() == [2] * 600
    assert ngram_join.merge([])[0].tolist() == []


def test_minhash_near_duplicates(spark):
    texts = corpus(9)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts, 5, 80, 100)
    got = {r.doc_id: r.component_id for r in fingerprint.near_duplicates(df).collect()}
    linked = [i for i in want if want[i][2]]
    assert sum(got[i] == want[i][1] for i in linked) >= 0.97 * len(linked)
    assert all(got[i] == i for i in want if not want[i][2])


def test_a_tile_without_its_second_chunk_has_no_links(spark):
    text = "a b c d e f g h i j"
    tiles = [(1, 0, 0, 0, second, 0, node, 1, text) for second in (0, 1) for node in (1, 2)]
    rows = spark.createDataFrame(tiles, "block long, g1 int, c1 int, g2 int, c2 int, side int, node long, copies long, text string")
    assert sorted(r.links for r in ngram_join.search_tiles(rows, 5, 80, 100).collect()) == [0, 0, 1, 1]
