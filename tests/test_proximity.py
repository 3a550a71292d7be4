import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import proximity, vectors


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")


def recall(found, truth):
    far = lambda df: {(r["query_id"], r["rank"]): r["distance"] for r in df.collect()}
    ours, theirs = far(found), far(truth)
    assert ours.keys() == theirs.keys()
    return np.mean([ours[key] <= theirs[key] + 1e-6 for key in theirs])


def clustered(rng, n, clusters, d):
    return rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] * 4 + rng.normal(size=(n, d)) * 0.3


@pytest.mark.parametrize("rows", [20_000, 400])
@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_against_brute_force(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(proximity, "SHARD_ROWS", rows)
    rng = np.random.default_rng(8)
    v = table(spark, rng.normal(size=(1500, 24)) if kind == "isotropic" else clustered(rng, 1500, 40, 24))
    q = v.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    graphs = proximity.hnsw_build(v)
    assert graphs.count() == -(-1500 // rows)
    ef = proximity.calibrated(v, graphs, 10)
    assert recall(proximity.hnsw_search(q, graphs, 10, ef), vectors.exact(q, v, 10)) >= 0.9


def test_a_search_is_narrower_than_the_shard():
    rng = np.random.default_rng(1)
    x = clustered(rng, 4000, 50, 16)
    graph = proximity.Graph(proximity.packed(np.arange(4000), x))
    links = np.diff(graph.layers[0][1])
    assert links.max() <= 2 * proximity.M + 3 and len(graph.layers) > 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seen = []
    walk = graph._walk
    graph._walk = lambda q, layer, begin, ef: seen.append(ef) or walk(q, layer, begin, ef)
    hits = [len(set(np.argsort(1 - unit @ unit[i])[:10]) & set(graph.search(unit[i], 10, 64))) for i in range(0, 4000, 100)]
    assert np.mean(hits) >= 9 and set(seen) == {8, 64}


def test_parts_are_connected():
    x = np.zeros((300, 3))
    for i, corner in enumerate(np.eye(3)):
        x[i * 100 : i * 100 + 100] = corner + np.random.default_rng(i).normal(size=(100, 3)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out, reached, stack = proximity.linked(x), {0}, [0]
    while stack:
        for j in out[stack.pop()]:
            if j not in reached:
                reached.add(j)
                stack.append(j)
    assert len(reached) == 300


def test_repeated_odd_and_few_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(50, [0.0, 1.0]), (51, None), (52, []), (53, [1.0]), (54, [float("nan"), 1.0]), (None, [1.0, 0.0]), (55, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    graphs = proximity.hnsw_build(v)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "query_id bigint, embedding array<double>")
    found = {}
    for r in proximity.hnsw_search(q, graphs, 3, 16).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["distance"])
    assert found[1] == {1: (0, 0.0), 2: (1, 0.0), 3: (2, 0.0)} and found[2] == {1: (50, 0.0), 2: (0, 1.0), 3: (1, 1.0)}
    assert proximity.hnsw_search(q, proximity.hnsw_build(v.limit(0)), 3, 16).count() == 0


def test_graphs_where_centroids_do_not_help(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(900, 32)), clustered(rng, 900, 30, 16)):
        v = table(spark, x)
        q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
        assert recall(proximity.indexed(q, v, 5, 24), vectors.exact(q, v, 5)) >= 0.9


def test_query_recall(spark, sf):
    from gleanery.plans.registry import queries

    assert queries()["hnsw_recall"](spark, sf).select(F.col("recall")).first()[0] >= 0.9
