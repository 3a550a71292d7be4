"""Sets that are alike: each pair once, whole sets not moved for each pair, odd rows as SQL has them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.operators import alike, fusion


def _random_sets(deal, n):
    sets = [frozenset(f"w{min(deal.randrange(60), deal.randrange(60))}" for _ in range(deal.choice((1, 4, 12, 40, 90)))) for _ in range(n)]
    # near copies, so that many pairs share many tokens
    base = sorted({f"c{deal.randrange(900)}" for _ in range(200)})
    return [*sets, *(frozenset(deal.sample(base, len(base) - deal.randrange(30))) | {f"x{deal.randrange(50)}"} for _ in range(40))]


def test_pairs_of_hot_tokens_meet_block_by_block(monkeypatch):
    monkeypatch.setattr(alike, "BLOCK", 8)
    monkeypatch.setattr(alike, "PAIRS", 64)
    deal = random.Random(2)
    sets = list(dict.fromkeys(_random_sets(deal, 200)))
    code = {w: np.int64(deal.getrandbits(63)) for w in sorted(set().union(*sets))}
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([sorted(int(code[w]) for w in s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "t"])
    seen = pa.Table.from_batches(alike.counted([rows]))
    often = alike.levels(seen.filter(pa.compute.is_valid(seen["c"])))
    made = pa.Table.from_batches(alike.prefixes(often, 0.8)([rows])).combine_chunks()
    n, tokens = made["n"].to_pylist(), made["tokens"].to_pylist()
    assert all(len(t) <= k // 5 + 1 for t, k in zip(tokens, n, strict=True))
    asked = pa.RecordBatch.from_arrays([made["doc_id"].chunk(0), pa.array([0] * len(n), pa.int64()), made["n"].chunk(0), made["tokens"].chunk(0)], ["i", "g", "n", "tokens"])
    posts = pa.Table.from_batches(alike.postings(often)([asked])).sort_by([("key", "ascending"), ("n", "ascending")])
    assert len(posts) > sum(map(len, tokens)) and max(posts["key"].value_counts().field("counts").to_pylist()) < 60
    pairs = [(i, j) for b in alike.pairs(0.8)(posts.to_batches(max_chunksize=100)) for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = {(i, j) for i, s in enumerate(sets) for j, u in enumerate(sets) if i < j and len(s & u) / len(s | u) >= 0.8}
    assert want <= set(pairs) and len(want) > 300
    # of the two dozen tokens and more that near copies share in their prefixes, hardly any but the first makes the pair
    assert sum(p in want for p in pairs) < 1.5 * len(want)
    signs = [*((0, i, None, k, s) for i, k, s in zip(range(len(n)), n, made["signs"].to_pylist(), strict=True)), *((0, i, j, None, None) for i, j in sorted(pairs, key=lambda p: p[::-1]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*signs, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["cell", "i", "j", "n", "signs"])
    left = [(i, j) for b in alike.likely(0.8)([batch.slice(k, 50) for k in range(0, len(batch), 50)]) for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert want <= set(left) and len(left) == len(set(left)) < len(set(pairs))


def _moved(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sets_are_not_moved_for_each_pair(spark, monkeypatch):
    deal = random.Random(4)
    base = [f"word{k}" for k in range(420)]
    df = spark.createDataFrame([(i, deal.sample(base, 400)) for i in range(500)], "doc_id bigint, t array<string>").repartition(4).persist()
    df.count()
    held, keep = {}, fusion.written
    monkeypatch.setattr(fusion, "written", lambda made, name: held.setdefault(name, keep(made, name)))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = _moved(spark)
    rows = fusion.similar_sets(df, 0.8).collect()
    moved = _moved(spark) - before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    df.unpersist()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows}) == 500 * 499 // 2
    # 3,200 bytes a set: 1.6 MB of sets, and 400 MB if a set went with each pair
    assert moved < 20 << 20
    # nor are sets stored: of each, a prefix alone
    assert all("t" not in some.columns for some in held.values()) and held["prefixes"].where(F.size("tokens") > F.col("n") / 5 + 1).isEmpty()


def test_odd_rows_are_paired_as_sql_does(spark, duck):
    ten = [f"w{k}" for k in range(10)]
    near, other = [*ten[:9], "x1"], [*ten[:9], "x2"]
    rows = [(1, ten), (1, ten), (2, [*ten, "y"]), (2, near), (2, near), (None, ten), (None, ["only", "here"]), (3, None), (4, []), (5, []), (6, other), (6, [*ten, "z"]), (7, ten), (8, ["one"]), (9, ["two"])]
    got = sorted(tuple(r) for r in fusion.similar_sets(spark.createDataFrame(rows, "doc_id bigint, t array<string>"), 0.8).collect())
    duck.execute("CREATE OR REPLACE TEMP TABLE odd (doc_id BIGINT, t VARCHAR[])")
    duck.executemany("INSERT INTO odd VALUES (?, ?)", rows)
    want = duck.execute("""WITH t AS (SELECT doc_id, list_sort(t) AS t FROM odd), u AS (SELECT t, min(doc_id) AS a FROM t GROUP BY t),
      p AS (SELECT x.a, y.a AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) + len(y.t) AS s FROM u x JOIN u y ON x.a < y.a)
      SELECT a, b, round(i::DOUBLE / (s - i), 6) FROM p WHERE s > i AND i::DOUBLE / (s - i) >= 0.8 UNION ALL SELECT u.a, t.doc_id, 1.0 FROM t JOIN u USING (t) WHERE doc_id > u.a""").fetchall()
    assert got == sorted(want) and len(got) > 5
