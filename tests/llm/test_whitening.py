import math
import random

import numpy as np
import pytest

from graphloom.llm import registry, whitening


def plain(vectors):
    x = [[math.floor(1024 * float(np.float64(np.float32(c)))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[n * r[k] - s[k] for k in range(d)] for r in x], dtype=object)
    deviation = [int(sum(v * v for v in r)) for r in y]
    c = y.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, deviation, c, e[::-1], u[:, ::-1]


def vectors(rng, n, d):
    mix = [[rng.gauss(0, 1) / (1 + k) for k in range(d)] for _ in range(d)]
    return [[sum(a * b for a, b in zip(z, row, strict=True)) + 3 for row in mix] for z in ([rng.gauss(0, 1) for _ in range(d)] for _ in range(n))]


@pytest.mark.parametrize("n,d,fan,entries", [(300, 16, 16, 1 << 18), (200, 9, 2, 40), (5, 12, 2, 1 << 18), (60, 1, 16, 1 << 18)])
def test_against_the_covariance(spark, tmp_path, monkeypatch, n, d, fan, entries):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
    own = vectors(random.Random(n), n, d)
    rows = [(k, v, 1) for k, v in enumerate(own)] + [(None, own[0], None), (0, own[1], 2)]
    bad = [(900, None, 1), (901, [1.0] * (d - 1) + [None], 1), (902, [float("nan")] * d, 1), (903, [float("inf")] * d, 1), (904, [1e30] * d, 1), (905, [1.0] * (d + 1), 1), (906, [], 1)]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.op13_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    m, deviation, c, e, u = plain([r[1] for r in rows])
    k = min(8, d, m - 2 if m - 2 < d else d)  # two rows repeat others; centring takes one direction
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == m * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {m}
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9
    key = lambda d: (-1 if d is None else d)
    assert sorted({(key(r.vec_id), r.deviation) for r in got}) == sorted({(key(v[0]), x) for v, x in zip(rows, deviation, strict=True)})
    for j in range(k):
        assert all(abs(r.explained / (e[j] / e.sum()) - 1) < 1e-8 for r in got if r.component == j + 1)
        z = c @ u[:, j] / math.sqrt(e[j])
        mine = sorted((r.deviation, r.whitened) for r in got if r.component == j + 1)
        theirs = sorted(zip(deviation, z, strict=True))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, theirs, strict=True)))
        assert all(a[0] == b[0] and abs(sign * a[1] - b[1]) < 1e-6 for a, b in zip(mine, theirs, strict=True))


def test_jacobi_is_accurate_where_the_covariance_is_not():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(7, 7)))[0]
    true = np.array([1e3, 10, 1, 1e-3, 1e-6, 1e-8, 1e-10])
    found, axes = whitening.jacobi(np.linalg.qr(np.random.default_rng(2).normal(size=(7, 7)))[0] @ np.diag(true) @ q.T)
    assert np.allclose(found[:5], true[:5], rtol=1e-6) and np.allclose(axes @ axes.T, np.eye(7), atol=1e-13)
    assert np.allclose(np.abs((axes @ q).diagonal())[:4], 1, atol=1e-8)


def test_no_variance_no_rows_and_large_numbers(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    assert whitening.whiten(df([]), ["vec_id"]).count() == 0
    assert whitening.whiten(df([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b")]), ["vec_id"]).count() == 0
    assert whitening.whiten(df([(1, [], "a"), (2, None, "b")]), ["vec_id"]).count() == 0
    got = whitening.whiten(df([(1, [4e12, 0.0], "a"), (2, [-4e12, 0.0], "b"), (3, [0.0, 0.0], "c")]), ["component", "vec_id"])
    assert got.columns[:3] == ["component", "vec_id", "component"]
    rows = sorted(got.collect(), key=lambda r: r.vec_id)
    assert [r.deviation for r in rows] == [None, None, 0] and abs(rows[0].whitened + rows[1].whitened) < 1e-9 and abs(abs(rows[0].whitened) - 1.5**0.5) < 1e-12
