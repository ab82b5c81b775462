import math
import random

import pytest
from pyspark.sql import functions as F

from clearcharge.llm import vector_search
from clearcharge.llm.vector_search import exact_top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k=5):
    whole = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(256 * x) for x in v]
    out = []
    for q in sorted(i for i in whole if i % 5 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
        out += [(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("leaf", [4, 128])
def test_same_as_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(vector_search, "LEAF", leaf)
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 16)
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.5, r.uniform(-1, 1)]) for _ in range(6)], 0) for i in range(200)]
    rows += [(200 + i, rows[0][1], 0) for i in range(60)]  # a third alike: ties go to the smaller id
    rows += [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [math.nan] * 6, 0), (303, [math.inf] * 6, 0), (305, [1.0, 2.0], 0), (310, [0.5, 2.0], 0), (315, [], 0), (None, [1.0] * 6, 0), (405, [-1e6] * 6, 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    floats = [(r.vec_id, r.embedding, 0) for r in table.collect()]
    got = exact_top_k(table, F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain(floats))


def test_scores_beyond_exact_doubles(spark):
    rows = [(i, [float(2**21 + i * 4), float(-(2**22)), 1.0 / 256 * (i % 3)], 0) for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = exact_top_k(table, F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain([(r.vec_id, r.embedding, 0) for r in table.collect()]))


def test_no_vectors(spark):
    assert exact_top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).count() == 0
