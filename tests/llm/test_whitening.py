"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from assayer.llm import whitening
from assayer.llm.queries import queries


def brute(vectors, k=16):
    x = (np.floor(64 * np.asarray(vectors, dtype=np.float64)) + 1000000).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - sums]
    return n, deviation, ((n * x - sums) / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 0.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, n double").repartition(5)


@pytest.mark.parametrize("width,block", [(24, 48), (40, 18), (80, 24)])
def test_equals_the_whole_covariance(spark, width, block):
    rnd = np.random.default_rng(width)
    vectors = (rnd.standard_normal((400, width)) * np.linspace(3, 0.4, width)).astype(np.float32)
    vectors[50:90] = vectors[3]
    got = {r.id: r for r in whitening.whiten(table(spark, vectors.tolist()), block=block).collect()}
    n, deviation, white, explained = brute(vectors)
    assert len(got) == 400 and all(got[i].n == n == 360 and int(got[i].deviation) == deviation[i] for i in got)
    mine = np.array([got[i].whitened for i in range(400)])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-7
    assert np.abs(np.array(got[0].explained) / explained - 1).max() < 1e-9
    assert got[0].identity_error < 1e-9


def test_flat_spectra_and_ties():
    for values in ([1.0] * 60, [5.0] * 20 + [1.0] * 40, np.linspace(1.02, 1, 60), 0.5 ** np.arange(60.0), [1.0, 1.0, *[1e-9] * 58]):
        u = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))[0]
        v = (u * values) @ u.T
        e, q = whitening.subspace(lambda b: v @ b, 60, 16, 20, float(np.sum(values)))
        assert np.allclose(e, np.sort(values)[::-1][:16], rtol=1e-9, atol=1e-14)
        assert np.abs(q.T @ q - np.eye(16)).max() < 1e-12 and np.abs(v @ q - q * e).max() < 1e-10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [2.0, -1.5]), (1, [1.0, 2.0]), (6, []), (7, [4.0]), (8, [4.0]), (9, [0.25, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted((r.id or 0, r.n, len(r.whitened)) for r in got) == [(0, 3, 2), (1, 3, 2), (1, 3, 2), (6, 1, 0), (7, 1, 0), (8, 1, 0), (9, 3, 2)]
    assert whitening.whiten(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="out of range"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        whitening.whiten(df, most_widths=2)


def test_exact_sums():
    rnd = np.random.default_rng(4)
    for size in (10, 1 << 30, 1 << 45, 1 << 61):
        d = rnd.integers(-size, size, (20, 7))
        assert whitening.sum_of_squares(d) == [sum(int(v) ** 2 for v in row) for row in d]
    x, sums, n = rnd.integers(0, 1 << 46, (5, 3)), rnd.integers(0, 1 << 60, 3), 1 << 30
    assert (whitening.from_mean(x, n, sums) == [[int(a) * n - int(s) for a, s in zip(row, sums)] for row in x]).all()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries()["op12_whitening"](spark, folder).toPandas().sort_values(["vec_id", "component"])
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, white, explained = brute(np.stack(vectors.embedding))
    mine = rows.whitened.to_numpy().reshape(len(vectors), 16)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-6 and (rows.n == n).all()
    assert rows.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == deviation
    assert np.abs(rows.explained.to_numpy()[:16] / explained - 1).max() < 1e-9 and rows.identity_error.max() < 1e-9
