import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import lookup, memory

SCHEMA = "id bigint, scope string, prefix string, embedding array<double>"


def made(seed, n=300, scopes=3, prefixes=4, noise=0.25, dims=6):
    """Rows in clusters, with copies, chains of near vectors, and vectors that are like nothing."""
    rng = np.random.default_rng(seed)
    centres, rows = rng.normal(size=(12, dims)), []
    for i in rng.permutation(n).tolist():
        v = centres[rng.integers(12)] + rng.normal(size=dims) * noise
        if rows and rng.random() < 0.3:
            v = np.array(rows[rng.integers(len(rows))][3] or [1.0] * dims)
        if rows and rng.random() < 0.1:
            v = v * 2.0
        rows.append((i, f"s{rng.integers(scopes)}", f"p{rng.integers(prefixes)}", None if rng.random() < 0.02 else (v * (rng.random() > 0.02)).tolist()))
    return rows


def unit(v):
    v = np.array(v if v is not None else [0.0], float)
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0


def like(a, b):
    return round(float(unit(a) @ unit(b)), 12) if a is not None and b is not None else 0.0


def superseded(rows, threshold, cross):
    by, live = {r[0]: None for r in rows}, {}
    for i, scope, prefix, v in sorted(rows):
        same = [r for r in live.values() if r[1] == scope and r[2] == prefix]
        pool, least = (same, threshold) if same else ([r for r in live.values() if r[1] == scope], cross)
        best = min(((-like(v, r[3]), r[0]) for r in pool if like(v, r[3]) >= least), default=None)
        if best:
            by[best[1]] = i
            del live[best[1]]
        live[i] = (i, scope, prefix, v)
    return by


def consolidated(rows, threshold):
    into = {}
    for i, scope, prefix, v in sorted(rows, reverse=True):
        newer = [j for j, s, p, w in rows if j > i and (s, p) == (scope, prefix) and into[j] is None and like(v, w) >= threshold]
        into[i] = max(newer, default=None)
    return into


@pytest.mark.parametrize(("seed", "threshold", "cross", "scopes"), [(1, 0.92, 0.94, 3), (2, 0.8, 0.9, 1), (3, 0.97, 0.7, 2)])
def test_supersession_equals_the_fold(spark, seed, threshold, cross, scopes):
    rows = made(seed, scopes=scopes)
    found = {r["id"]: r["superseded_by"] for r in memory.semantic_supersession(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, cross).collect()}
    want = superseded(rows, threshold, cross)
    assert found == want and any(want.values())


@pytest.mark.parametrize(("seed", "threshold"), [(4, 0.92), (5, 0.6)])
def test_consolidation_equals_the_fold(spark, seed, threshold):
    rows = made(seed)
    found = {r["id"]: r["merged_into"] for r in memory.consolidation(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold).collect()}
    want = consolidated(rows, threshold)
    assert found == want and any(want.values())


@pytest.mark.parametrize("block", [7, 4096])
def test_near_pairs_equal_brute_force(spark, block):
    rows = [(i, s, p, v) for i, s, p, v in made(6) if v is not None and any(v)]
    df = memory.classes(spark.createDataFrame(rows, SCHEMA), ["scope"]).where("id = class").select("scope", "class", "embedding")
    each = [(r["class"], r["scope"], list(r["embedding"])) for r in df.collect()]
    want = {(min(a, b), max(a, b)): like(v, w) for a, s, v in each for b, t, w in each if a < b and s == t and like(v, w) >= 0.85}
    got = {(r["a"], r["b"]): r["similarity"] for r in memory.near_classes(df, "scope", 0.85, block).collect()}
    assert got == pytest.approx(want) and want


def test_a_large_scope_is_not_refused(spark):
    df = spark.range(60_000).selectExpr("id", "'s' AS scope", "concat('p', id % 3) AS prefix", "array(cos(id % 40), sin(id % 40), cast(id % 5 as double)) AS embedding")
    out = memory.semantic_supersession(df, 0.9999, 0.9999).collect()
    # a live row for each distinct vector of each prefix
    assert len(out) == 60_000 and sum(r["superseded_by"] is None for r in out) == 120
    assert memory.consolidation(df, 0.9999).where("merged_into is not null").count() == 60_000 - 120
    assert memory.semantic_supersession(df.limit(0)).count() == 0 and memory.consolidation(df.limit(0), 0.9).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 3])
def test_similar_paths_equal_brute_force(spark, most):
    rng = np.random.default_rng(most)
    paths = sorted({"".join(rng.choice(list("ab/é"), rng.integers(1, 12))) for _ in range(300)})
    wanted = ["", "a", "abab", "b/éa/ab", "aaaaaaaaaa", "a/b/a/b/a/b", *paths[:20]]
    q = spark.createDataFrame(list(enumerate(wanted)), "query_id bigint, wanted string")
    df = lookup.similar_paths(q, spark.createDataFrame([(p,) for p in [*paths, *paths[:5], None]], "path string"), most, 10_000)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r["query_id"], r["path"]): r["distance"] for r in df.collect()}
    assert got == {(i, p): d for i, w in enumerate(wanted) for p in paths if (d := distance(w, p)) <= most}


def test_paths_of_one_folder_do_not_all_meet(spark, monkeypatch):
    pairs, spared = spark.sparkContext.accumulator(0), F.levenshtein

    def counted(a, b, most):
        @F.udf("boolean")
        def seen(x, y):
            pairs.add(1)
            return True

        return F.when(seen(a, b), spared(a, b, most))

    monkeypatch.setattr(F, "levenshtein", counted)
    paths = [f"folder/doc_{i * 7919 % 100_000:05d}.md" for i in range(1500)]
    q = spark.createDataFrame([(i, p.replace("doc_", "dox_")) for i, p in enumerate(paths[:60])], "query_id bigint, wanted string")
    got = lookup.similar_paths(q, spark.createDataFrame([(p,) for p in paths], "path string"), 3, 2).collect()
    assert {r["query_id"]: r["path"] for r in got if r["distance"] == 1} == dict(enumerate(paths[:60]))
    assert pairs.value < 20_000  # of 90,000


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_nearest_paths_of_all_lengths_equal_brute_force(spark, limit):
    rng = np.random.default_rng(limit)
    long = "".join(rng.choice(list("ab/"), 40))
    # lengths on both sides of the one from which on paths are joined by segments
    paths = sorted({long[:n] + "".join(rng.choice(list("abé"), 3)) for n in range(24, 40) for _ in range(6)})
    wanted = [long[:n] + "bé" for n in range(25, 40, 2)] + [long[1:33], long[:30] + "x"]
    q = spark.createDataFrame(list(enumerate(wanted)), "query_id bigint, wanted string")
    got = {(r["query_id"], r["path"], r["distance"]) for r in lookup.similar_paths(q, spark.createDataFrame([(p,) for p in paths], "path string"), 3, limit).collect()}
    every = [sorted((d, p) for p in paths if (d := distance(w, p)) <= 3)[:limit] for w in wanted]
    assert got == {(i, p, d) for i, near in enumerate(every) for d, p in near}
