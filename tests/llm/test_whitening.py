import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors):
    """Whole numbers and the covariance's eigenvectors by a dense solver."""
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors], np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    c = listed - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, values[::-1], basis[:, ::-1]


def check(rows, got, components=4):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x, n, sums, values, basis = exact([v for _, v in kept])
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == k * len(kept)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    wanted = (x - sums / n) @ basis[:, :k] / np.sqrt(values[:k])
    signs = [0.0] * k
    for (i, _), own, w in zip(kept, x, wanted):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums))
        for j in range(k):
            for r in by[i][j + 1]:
                assert r.n == n and (r.deviation == deviation or len(by[i][j + 1]) > 1)
                assert abs(r.explained - values[j] / values.sum()) <= 1e-9 * r.explained and r.identity_error < 1e-9
            if len(by[i][j + 1]) == 1 and abs(w[j]) > 1e-6:
                signs[j] = signs[j] or np.sign(w[j] * by[i][j + 1][0].whitened)
                assert abs(by[i][j + 1][0].whitened - signs[j] * w[j]) < 1e-9


def made(n, width, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in v], 0) for i, v in enumerate((rng.standard_normal((n, width)) * np.linspace(2, 0.5, width) + 3).astype(np.float32))]


def test_dense_solver_agrees(spark):
    rows = made(300, 24)
    rows += [(1000 + k, rows[0][1], 1) for k in range(50)] + [(2000, None, 0), (2001, [None] + rows[1][1][1:], 0), (2002, [float("nan")] * 24, 0), (2003, [float("inf")] * 24, 0)]
    check(rows, W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_few_vectors(spark):
    for rows in (made(3, 24), made(2, 1), made(40, 3)):
        check(rows, W.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    same = [(i, [1.0, 2.0], 0) for i in range(9)]
    assert W.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).count() == 0


def test_shorter_vectors_and_clashing_columns(spark):
    rows = made(60, 8)
    short = [(i, v[: 8 - i % 3], 0) for i, v, _ in rows]
    df = spark.createDataFrame(short, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("x", "n", "component", "whitened")))
    filled = [(i, v + [0.0] * (8 - len(v)), 0) for i, v, _ in short]
    check(filled, W.whiten(df).collect())


def test_null_ids_and_ties(spark):
    rows = made(50, 6)
    odd = [(None, v, 0) for _, v, _ in rows[:5]] + [(7, v, 0) for _, v, _ in rows[5:9]] + rows[9:]
    got = W.whiten(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == 4 * 50 and sum(r.vec_id is None for r in got) == 20 and sum(r.vec_id == 7 for r in got) >= 16


def test_close_eigenvalues(spark):
    """A flat spectrum of many dimensions, with one pair that is equal by construction."""
    rng = np.random.default_rng(5)
    half = rng.standard_normal((150, 40))
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(np.vstack([half, -half]))]
    x = np.unique(exact([v for _, v, _ in rows])[0], axis=0)
    listed = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    model = W.fit(listed)
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    assert np.abs(v @ model.vectors - model.vectors * model.values).max() < 1e-10 * model.values[0]
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12)
    assert 0 < model.passes < 200 and model.error < 1e-10


def test_exact_sums_beyond_64_bits(spark):
    big = 3.0e16
    rows = [(0, [big, 1.0], 0), (1, [-big, 2.0], 0), (2, [1.5, 1e30], 0)]
    got = {(r.vec_id, r.component): r for r in W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.deviation is None for r in got.values()) and all(np.isfinite(r.whitened) for r in got.values())
    x = np.array([[2**53, -7], [5, 3]], np.int64)
    n, sums = 2, [2**53 + 5, -4]
    assert W.deviations(x, n, sums) == [v if v < 2**63 else None for v in (sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x)]
    assert W.deviations(np.array([[300, -7]]), 10, [100, 5]) == [2900**2 + 75**2]


def test_large_mean(spark):
    """A mean that is large beside the spread costs no digits."""
    rows = [(i, [c + 30_000.0 for c in v], 0) for i, v, _ in made(200, 10, 3)]
    check(rows, W.whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_query(spark, tmp_path):
    from stanzaline.llm import queries

    rows = made(120, 16, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(rows, got.collect())


@pytest.mark.parametrize("width", [1, 2, 5])
def test_filter_keeps_the_wanted(width):
    """The Chebyshev filter is one at its top and small below its cut."""
    values = np.linspace(0.1, 1.0, 10)
    apply = lambda q: values[:, None] * q
    q = np.ones((10, width))
    out = W._filtered(apply, q, apply(q), 1.0, 0.5)
    assert np.allclose(out[-1], 1.0) and np.abs(out[:4]).max() < 0.01
