import random

import numpy as np
import pytest

from clearcharge.llm import near_dup
from clearcharge.llm.graph import components
from clearcharge.llm.near_dup import near_duplicates


def plain(texts, n):
    """Sizes and components by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def changed(text, share, seed):
    r = random.Random(seed)
    words = text.split()
    return " ".join("swap" + str(r.random())[2:7] if r.random() < share else w for w in words)


@pytest.fixture
def corpus(prose):
    base = [prose(n, s) for s, n in enumerate([3, 1, 40, 200, 200, 900])]
    near = [changed(base[3], share, s) for s, share in enumerate([0.01, 0.02, 0.03, 0.05, 0.05, 0.06, 0.2] * 4)]
    chain = [base[5]]
    for s in range(8):
        chain.append(changed(chain[-1], 0.03, 100 + s))
    shared = [base[4] + " " + prose(200, 50 + s) for s in range(30)]
    return [None, "", "  \t\n", *base, *base, base[2].upper(), *near, *chain, *shared, prose(20_000, 77), prose(20_000, 77)]


@pytest.mark.parametrize("words", [2, 5])
def test_components_are_those_of_all_pairs(spark, documents, corpus, words):
    got = near_duplicates(documents(corpus), words=words).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(corpus, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_are_compared_block_by_block(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    got = near_duplicates(documents(corpus), words=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(corpus, 2)


def test_repeated_rows_and_no_rows(spark, documents, prose):
    twice = documents([prose(50, 1), prose(50, 1), "else"])
    got = near_duplicates(twice.union(twice)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert near_duplicates(documents([])).count() == 0


def test_sketch_estimate_is_close(prose):
    for share in (0.0, 0.02, 0.05):
        a, b = (near_dup.shingles(t.encode(), 2) for t in (prose(2_000, 5) + str(5), changed(prose(2_000, 5), share, 9)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (near_dup.odd_sketch(near_dup.minhash(s)) for s in (a, b))
        assert abs(near_dup.estimate(int(np.bitwise_count(x ^ y).sum())) - true) < 0.12


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(5, 3), (3, 5), (3, 3), (9, 5), (None, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "t").collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 5: 3, 9: 3}
