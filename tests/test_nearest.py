import numpy as np
import pytest

from gleanery.operators import memory, vectors


@pytest.mark.parametrize("held", [1 << 21, 60])
@pytest.mark.parametrize("named", [False, True])
def test_nearest_of_slices_equal_a_sort(held, named, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", held)
    deal = np.random.default_rng(1)
    q, m, k = 7, 400, 5
    far, ids = np.round(deal.random((q, m)), 2), deal.permutation(m)
    ids = np.array([f"v{i:03}" for i in ids], object) if named else ids
    for open_ in (np.ones((q, m), bool), deal.random((q, m)) < 0.5):
        best = vectors._Nearest(q, k)
        for at in range(0, m, 37):
            best.add(far[:, at : at + 37], ids[at : at + 37], open_[:, at : at + 37])
        best.settle()
        for i in range(q):
            assert list(zip(best.far[best.row == i], best.ids[best.row == i])) == sorted((far[i, j], ids[j]) for j in range(m) if open_[i, j])[:k]


def test_slices_hold_few_distances(spark, monkeypatch):
    deal = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, deal.normal(size=4).tolist(), i % 3 if i % 50 else None) for i in range(700)], "id bigint, embedding array<double>, scope int")
    v = rows.withColumnRenamed("id", "vec_id")
    asked = v.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, vectors.exact(asked, v, 9).collect()))
    monkeypatch.setattr(vectors, "HELD", 500)
    sizes = spark.sparkContext.accumulator(0)
    count = vectors._distances

    def counted(a, b, digits):
        assert len(a) * len(b) <= 500
        sizes.add(1)
        return count(a, b, digits)

    monkeypatch.setattr(vectors, "_distances", counted)
    assert sorted(map(tuple, vectors.exact(asked, v, 9).collect())) == whole
    # a query meets the memories of its scope alone, and none where it has no scope
    got = {(r["scope"], r["query_id"], r["id"], r["similarity"]) for r in memory.semantic_search(rows, asked.withColumnRenamed("embedding", "q"), 0.3, 5).collect()}
    held, want = [tuple(r) for r in rows.collect()], set()
    for q, x, s in held:
        if q % 7 == 0 and s is not None:
            near = sorted((round(1 - float(np.dot(x, y)) / (np.linalg.norm(x) * np.linalg.norm(y)), 6), i) for i, y, t in held if t == s)[:5]
            want |= {(s, q, i, round(1 - d, 6)) for d, i in near if round(1 - d, 6) >= 0.3}
    assert {r[:3] for r in got} == {r[:3] for r in want} and len(got) == len(want)
