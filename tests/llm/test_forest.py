import numpy as np
import pytest

from gleanery.llm import forest

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    return [i for i in ids[np.lexsort((ids, d))] if i != q][:k]


def found(spark, x, ids, **more):
    df = forest.participants(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA))
    rows = forest.nearest(df, df.where("vec_id % 100 = 0"), **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def recall(out, x, ids):
    return np.mean([len(set(v) & set(brute(x, ids, q))) / 10 for q, v in out.items()])


@pytest.mark.parametrize(("rows", "group"), [(16_384, 1024), (100, 3)])
def test_recall_by_small_blocks_and_groups(spark, monkeypatch, rows, group):
    monkeypatch.setattr(forest, "BLOCK_ROWS", rows)
    monkeypatch.setattr(forest, "GROUP", group)
    rng = np.random.default_rng(1)
    x, ids = rng.normal(size=(3000, 16)).astype(np.float32), np.arange(3000)
    out = found(spark, x, ids)
    assert len(out) == 30 and all(len(v) == 10 for v in out.values()) and recall(out, x, ids) >= 0.9


def test_the_whole_budget_is_exact(spark):
    rng = np.random.default_rng(2)
    x, ids = rng.normal(size=(600, 8)).astype(np.float32), np.arange(600)
    out = found(spark, x, ids, target=1.0)
    assert np.mean([v == brute(x, ids, q) for q, v in out.items()]) >= 0.8


def test_clustered_vectors_take_a_small_part_of_the_index(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 5
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)) * 0.2).astype(np.float32)
    df = forest.participants(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)).withColumnRenamed("vec_id", "head")
    trees = forest.Forest(x.astype(np.float64)[:3000])
    sizes = np.bincount(trees.leaves_of(x.astype(np.float64)).ravel(), minlength=trees.leaves)
    assert forest.calibrated(df, trees, sizes) < 0.25 * len(x)


def test_ties_go_to_the_smaller_id(spark):
    x = np.array([[np.cos(a), np.sin(a)] for a in (0, 0.5, -0.5, 0.5, -0.5)] * 3, np.float32)
    out = found(spark, x, np.arange(15))
    assert out[0] == brute(x.astype(np.float64), np.arange(15), 0)
