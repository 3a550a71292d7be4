import numpy as np
import pytest

from gleanery.llm import whitening


def exact(x, k):
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)[:k]
    return z, e[order], u[:, order], np.trace(z.T @ z / n)


def integers(c):
    return np.floor(64 * np.asarray(c, np.float64)).astype(np.int64) + 1_000_000


def check(rows, vectors, k):
    ids = [i for i, _ in vectors]
    x = integers([v for _, v in vectors])
    z, e, u, trace = exact(x, k)
    assert len(rows) == len(ids) * k
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows)
    ours = np.array([[by[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    theirs = z @ u / np.sqrt(e)
    assert np.allclose(np.abs(ours), np.abs(theirs), atol=1e-6)
    assert np.allclose(np.sign((ours * theirs).sum(0)) * ours, theirs, atol=1e-6)
    w = np.array([by[ids[0], j + 1]["explained"] for j in range(k)])
    assert np.allclose(w, e / trace, rtol=1e-9)
    for i, row in zip(ids, x, strict=True):
        r = by[i, 1]
        assert r["n"] == len(ids) and r["deviation"] == sum(int(len(ids) * a - b) ** 2 for a, b in zip(row.tolist(), x.sum(0).tolist(), strict=True))
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    assert all(r["residual"] <= 1e-13 * e[0] * 1.01 for r in rows)


def test_query(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, sf).collect(), vectors, 32)


def test_wide_vectors_take_many_steps(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(400, 200)) * np.linspace(0.2, 3, 200) @ np.linalg.qr(rng.normal(size=(200, 200)))[0]).astype(np.float32)
    vectors = [(i, r.tolist()) for i, r in enumerate(v)]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"), components=5).collect()
    check(rows, vectors, 5)


@pytest.mark.parametrize("d", [50, 120, 400])
def test_lobpcg_certifies(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    v = a @ a.T + np.eye(d)
    e, u, norms = whitening.lobpcg(lambda b: v @ b, d, 10)
    w = np.sort(np.linalg.eigvalsh(v))[::-1][:10]
    assert np.allclose(e, w, rtol=1e-12) and (norms <= 1e-13 * w[0]).all() and np.allclose(u.T @ u, np.eye(10), atol=1e-12)


def test_repeated_eigenvalues_and_low_rank():
    v = np.diag([5.0] * 6 + [1.0] * 6 + [0.0] * 60)
    e, u, _ = whitening.lobpcg(lambda b: v @ b, 72, 10)
    assert np.allclose(e, [5] * 6 + [1] * 4, atol=1e-12)
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: v @ b + np.random.default_rng().normal(size=b.shape), 72, 10, steps=5)


def test_who_takes_part(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [-2.0, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (9, [0.0, 0.0]), (10, [0.3, -4.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, component string")
    out = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in out) == sorted((i is None, i or 0, c) for i in (1, 1, None, 9, 10) for c in (1, 2))
    assert {r["n"] for r in out} == {5} and abs(sum(r["explained"] for r in out if r["vec_id"] == 9) - 1) < 1e-12


def test_empty_equal_and_degenerate(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)], schema)).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 6 and abs(line[0]["explained"] - 1) < 1e-12


def test_sums_of_squares_over_long_raise(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 1e8]) for i in range(4)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="deviation"):
        whitening.whiten(df).collect()
