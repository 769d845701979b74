"""The n-gram join against all pairs, and its parts."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.components import components
from orrery.llm.near_duplicates import Join, keep_one, near_duplicates
from orrery.llm.ngram_trie import Forest, Threshold, Trie, linked_forest


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({("", *w)} if w else set()))
    return out


def brute(ids, texts, n, num, den):
    sets, forest = sets_of(texts, n), Forest(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                forest.join(i, j)
    least = defaultdict(lambda: 1 << 62)
    for k, i in enumerate(ids):
        least[forest.find(k)] = min(least[forest.find(k)], i)
    return {i: (len(sets[k]), least[forest.find(k)] if sets[k] else i) for k, i in enumerate(ids)}


def corpus(seed, families=8, size=12, passage=True):
    """Families of near copies at all distances around the threshold, a passage shared by many, copies and edges."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(6, 150))]
        for _ in range(size):
            made = list(base)
            for _ in range(r.randint(0, max(1, len(made) // 18))):
                made[r.randrange(len(made))] = word()
            at = r.randrange(len(made))
            texts.append(" ".join(made[:at] + (common if passage and r.random() < 0.5 else []) + made[at:]))
    texts += r.choices(texts, k=10) + ["", None, "  \n", "one", "One", "ONE two", "one two three", "É a b c d", "é a b c d", "x " * 3000]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,hot,group,counted,n,num", [(1, 128, 1024, None, 4, 85), (2, 4, 8, 0.25, 4, 85), (5, 3, 3, None, 5, 80), (3, 2, 4, 0.1, 5, 80), (4, 6, 5, 0.9, 3, 60)])
def test_join_equals_all_pairs(spark, seed, hot, group, counted, n, num):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, Join(n, num, 100, counted, hot, group, group)).collect()}
    assert got == brute(ids, texts, n, num, 100)


def test_join_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == [] and keep_one(none).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other text of six words here"), (3, long), (4, long + " end")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 2), (3, 29_996, 3), (4, 29_997, 3)]


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x", None), (3, "a b c d e f g", "y", 1), (3, "a b c d e f g", "y", 1), (9, None, "z", 2), (8, "", "z", 3), (7, "p q r s t u v", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, head int")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.digest) for r in kept.collect()) == [(3, "y"), (7, "z"), (8, "z"), (9, "z")]


@given(st.lists(st.sets(st.integers(0, 40), max_size=30), max_size=25), st.integers(50, 100))
@settings(max_examples=200, deadline=None)
def test_trie_finds_all(raw, num):
    limit = Threshold(num, 100)
    sets = [np.array(sorted(s), np.uint64) for s in raw if s]
    trie, labels = Trie(sets, limit), np.arange(len(sets))
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))
    for k, s in enumerate(sets):
        assert set(trie.linked(s, k, labels, k).tolist()) == {j for j in range(k) if similar(s, sets[j])}
    half = len(sets) // 2
    met = {(a, b) for a, b in linked_forest(sets[:half], limit, sets[half:])}
    assert all(a < half <= b and similar(sets[a], sets[b]) for a, b in met)
    assert {b for _, b in met} >= {k for k in range(half, len(sets)) if sum(similar(sets[k], sets[j]) for j in range(half)) and not any(b == k for _, b in met)}
    one, two = Forest(len(sets)), Forest(len(sets))
    for a, b in linked_forest(sets, limit):
        one.join(a, b)
    for k, s in enumerate(sets):
        for j in range(k):
            if 100 * len(np.intersect1d(s, sets[j])) >= num * len(np.union1d(s, sets[j])):
                two.join(j, k)
    assert [one.find(k) for k in range(len(sets))] == [two.find(k) for k in range(len(sets))]


def test_trie_of_many_levels():
    limit = Threshold(90, 100)
    sets = [np.arange(k + 1, dtype=np.uint64) for k in range(300)]
    links = linked_forest(sets, limit)
    forest = Forest(300)
    for a, b in links:
        forest.join(a, b)
    # Sets of k and k + 1 elements are similar from 10 k >= 9 (k + 1) on.
    assert [forest.find(k) for k in range(300)] == [k if k < 8 else 8 for k in range(300)]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)]
    forest = Forest(161)
    for a, b in edges:
        forest.join(a, b)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: forest.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_long_paths(spark):
    r = random.Random(7)
    edges = []
    for start in (0, 10_000):
        path = list(range(start, start + 3000))
        r.shuffle(path)
        edges += list(zip(path, path[1:], strict=False))
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {start + i: start for start in (0, 10_000) for i in range(3000)}
