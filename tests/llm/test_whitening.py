"""Whitening by contour integration against a dense eigensolver on exact sums."""

import math

import numpy as np
import pytest

from flowlens.llm import queries, whitening as wh

SF = "/root/testdata/sf0.001"


def whole(rows):
    return np.array([[math.floor(1024 * float(np.float64(c))) + 100_000 for c in v] for v in rows], object)


def expected(rows):
    x = whole(rows)
    n, s = len(x), x.sum(axis=0)
    y = np.array([[(n * c - t) for c, t in zip(r, s)] for r in x], object)
    z = np.array(y / n, float)
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, (y * y).sum(axis=1), z, values, vectors, np.trace(v)


def matrix_of(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


def test_query_equals_dense_solver(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, z, values, vectors, trace = expected([r.embedding for r in data])
    got = queries.op11_feast_whitening(spark, SF).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    place = {r.vec_id: i for i, r in enumerate(data)}
    by = {}
    for r in got:
        assert r.deviation == deviation[place[r.vec_id]]
        by.setdefault(r.component, {})[place[r.vec_id]] = (r.whitened, r.explained)
    for c in range(1, 9):
        mine = np.array([by[c][i][0] for i in range(n)])
        want = z @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-8
        assert by[c][0][1] == pytest.approx(values[c - 1] / trace, rel=1e-10)


@pytest.mark.parametrize(
    "values",
    [
        range(1, 65), [100 - 0.001 * i for i in range(40)], [5.0] * 3 + [4.0] * 9 + [1.0] * 20, [1e6, 1, 1, 1e-3, *[1e-8] * 20], [3.0, 2.0], [7.0], [2.0] * 50, [10.0 ** -i for i in range(14)],
        [1000, *np.linspace(10, 11, 63)], [8, 7, 6, 5, 4, 3, 2, 1.0000001, 1.0, *[0.5] * 30],
    ],
)
def test_leading_pairs(values):
    values = sorted(map(float, values), reverse=True)
    a = matrix_of(values)
    a = (a + a.T) / 2
    got, vectors = wh.leading(a, 8)
    k = min(8, sum(v > 1e-12 * sum(values) for v in values))
    assert len(got) == k and np.allclose(got, values[:k], rtol=1e-10, atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-10 * values[0]


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        exact = np.linalg.eigvalsh(a)
        for shift in rng.standard_normal(20) * 3:
            assert wh.count_above(a, shift) == int((exact > shift).sum())
    # no usable diagonal pivot
    assert wh.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and wh.count_above(np.zeros((3, 3)), 0.0) == 0


def test_contour_keeps_what_lies_inside():
    values = np.array([9.0, 8.0, 5.0, 4.9, 1.0, 0.5])
    part = wh.project(np.diag(values), 4.0, 6.0, np.eye(6))
    assert np.allclose(np.diag(part), [0, 0, 1, 1, 0, 0], atol=1e-3)


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    good = [(int(i), [float(np.float32(c)) for c in rng.standard_normal(5) * (1, 2, 3, 4, 5)]) for i in range(40)]
    good += [good[0], (None, good[1][1])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0]), (106, [1e30] * 5)]
    schema = "vec_id long, embedding array<float>, whitened string, N int"
    df = spark.createDataFrame([(*r, "mine", 1) for r in good + bad], schema)
    n, deviation, z, values, vectors, trace = expected([r[1] for r in good])
    got = wh.whiten(df).collect()
    assert len(got) == 5 * n and {r.n for r in got} == {n} and sum(r.vec_id is None for r in got) == 5 and sum(r.vec_id == 0 for r in got) == 10
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert max(r.identity_error for r in got) < 1e-9 and sum(r.explained for r in got if r.vec_id is None) == pytest.approx(1.0)
    assert wh.whiten(df.where("vec_id > 99 and vec_id <> 105")).count() == 0
    assert wh.whiten(df.where("false")).count() == 0
    assert wh.whiten(df.where("vec_id = 3")).count() == 0  # one vector has no variance
    assert wh.whiten(spark.createDataFrame([(i, [4e6 * (i % 3)] * 2, "x", 1) for i in range(4)], schema)).count() == 4
