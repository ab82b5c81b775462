import math

import numpy as np
import pytest

from clearcharge.llm.whitening import bidiagonalise, deviations, whitened

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, x string"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v if v is None else [None if c is None else float(c) for c in v], 7, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, wanted=16):
    """id -> (x, deviation), and variances, components, trace by an ordinary eigendecomposition of the covariance."""
    kept = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    distinct = sorted(set(map(tuple, kept.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[a - s / n for a, s in zip(r, sums)] for r in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    return kept, n, sums, values[order], vectors[:, order], values.sum()


@pytest.mark.parametrize("dims", [1, 5, 24])
def test_equals_an_eigendecomposition(spark, dims):
    rng = np.random.default_rng(dims)
    raw = (rng.standard_normal((300, dims)) * np.linspace(3, 0.5, dims)).tolist()
    vectors = [*raw, *raw[:40], None, [None] * dims, [float("nan")] * dims, [float("inf")] * dims]
    kept, n, sums, values, components, trace = plain(vectors)
    rows = whitened(table(spark, vectors).repartition(7)).collect()
    k = min(dims, 16)
    assert len(rows) == k * len(kept) and {r.vec_id for r in rows} == set(kept)
    got = np.zeros((len(vectors), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(kept[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
    want = np.array([[a - s / n for a, s in zip(kept[i], sums)] for i in sorted(kept)]) @ components / np.sqrt(values)
    for j in range(k):
        mine = got[sorted(kept), j]
        assert min(np.abs(mine - want[:, j]).max(), np.abs(mine + want[:, j]).max()) < 1e-7


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(3)
    few = rng.integers(-3, 4, (200, 3)) @ rng.integers(-2, 3, (3, 20))
    vectors = [*few.tolist(), *few.tolist()]
    kept, n, sums, values, _, trace = plain(vectors)
    rows = whitened(table(spark, vectors)).collect()
    assert {r.component for r in rows} == {1, 2, 3} and len(rows) == 3 * len(vectors)
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9) for r in rows)


def test_equal_variances(spark):
    """Four directions of exactly the same variance; a start in one of them must not hide the others."""
    vectors = [[s * (i == j) for i in range(4)] for j in range(4) for s in (2.0, -2.0)]
    rows = whitened(table(spark, vectors)).collect()
    assert {r.component for r in rows} == {1, 2, 3, 4}
    assert all(r.explained == pytest.approx(0.25) and r.identity_error < 1e-9 for r in rows)


@pytest.mark.parametrize("span", [1.0, 1e-3, 1e-6])
def test_bidiagonal_values_over_wide_ranges(span):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 40)) * np.geomspace(1, span, 40)
    x -= x.mean(axis=0)

    def products(z):
        u = x @ z
        return x.T @ u, float(u @ u)

    values, vectors = bidiagonalise(products, 40, 16, 0.0, 5).singular()
    _, want, right = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values[:16], want[:16], rtol=1e-9)
    assert np.allclose(np.abs(np.sum(vectors[:, :16] * right[:16].T, axis=0)), 1, atol=1e-9)
    stopped, _ = bidiagonalise(products, 40, 3, 1e-9, 5).singular()
    assert np.allclose(stopped[:3], want[:3], rtol=1e-6)


def test_other_lengths_missing_ids_and_nothing_to_fit(spark):
    rng = np.random.default_rng(8)
    vectors = [*rng.standard_normal((30, 3)).tolist(), [1.0], [1.0, 2.0], []]
    ids = [None if i % 10 == 0 else i // 2 for i in range(len(vectors))]
    rows = whitened(table(spark, vectors, ids)).collect()
    assert len(rows) == 3 * 30 and sum(r.vec_id is None for r in rows) == 9
    for nothing in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]]):
        assert whitened(table(spark, nothing)).collect() == []


def test_large_entries(spark):
    rows = whitened(table(spark, [[3e38, 0.0], [-3e38, 0.0], [0.0, 1.0]])).collect()
    assert {r.deviation for r in rows} == {None, *[r.deviation for r in rows if r.vec_id == 2]}
    assert deviations(np.array([[1 << 50], [0]]), 2, [1 << 50]) == [None, None]
    assert deviations(np.array([[1 << 31], [0]]), 1, [5]) == [((1 << 31) - 5) ** 2, 25]
