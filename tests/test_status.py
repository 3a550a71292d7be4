"""Operators on the state of a corpus, running sums over spread groups and small texts, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import chunking, content, ledgers, memory, shards, status

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"c{i % 4}", None if i % 50 == 0 else sha(str(rng.randrange(400)))) for i in range(900)] + [(900, None, sha("x")), (901, "empty", None)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, collection string, hash string").repartition(7)


def test_fingerprints_are_those_of_the_sorted_hashes(corpus):
    rows, docs = corpus
    held = {}
    for _, collection, value in rows:
        if value is not None:
            held.setdefault(collection, []).append(value)
    assert {r["collection"]: r["fp"] for r in status.fingerprints(docs).collect()} == {c: sha(",".join(sorted(v))) for c, v in held.items()}
    trees = {}
    for c, values in held.items():
        parts = {}
        for v in sorted(values):
            parts.setdefault(v[:3], []).append(v)
        trees[c] = sha(",".join(sha(",".join(parts[p])) for p in sorted(parts)))
    assert {r["collection"]: r["fp"] for r in status.fingerprint_trees(docs).collect()} == trees
    assert status.fingerprints(docs.limit(0)).count() == 0 and status.fingerprint_trees(docs.limit(0)).count() == 0


def test_running_sums_of_a_group_that_is_spread_over_tasks(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else (None if i % 2 else f"g{i % 5}"), i, None if i % 11 == 0 else rng.randrange(50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, at bigint, n int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = ledgers.cumulated(df, "g", "at", "n", "upto")
        assert held.select("at", "upto").count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, expected = {}, {}
    for g, at, n in rows:
        sums[g] = sums.get(g, 0) + (n or 0)
        expected[at] = sums[g]
    assert {r["at"]: r["upto"] for r in held.collect()} == expected
    within = {r["at"] for r in ledgers.within_budget(df, "g", "at", "n", 300).collect()}
    assert within == {at for at, total in expected.items() if total <= 300}
    assert ledgers.cumulated(df.limit(0), "g", "at", "n", "upto").count() == 0


def test_percentiles_are_the_nearest_ranks(spark):
    rng = random.Random(9)
    values = {"a": [rng.randrange(40) for _ in range(1000)], "b": [1.5], "c": list(range(100)), None: [3, 3, 9]}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("nulls", None), ("b", None)]
    found = {r["g"]: tuple(r[1:]) for r in ledgers.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    rank = lambda vs, p: float(sorted(vs)[max(0, -(-len(vs) * p // 100) - 1)])
    assert found == {g: tuple(rank(vs, p) for p in (50, 95, 99)) for g, vs in values.items()} | {"nulls": (None, None, None)}


def test_states_of_collections(spark):
    docs = spark.createDataFrame([("a", "h1", True, "2024-01-01T00"), ("a", "h2", True, "2024-01-03T00"), ("a", "h2", False, "2024-02-01T00"), (None, "h3", True, "2024-01-02T00"), ("b", None, True, None)], "collection string, hash string, active boolean, modified_at string")
    done = spark.createDataFrame([("h1",), ("h1",), (None,)], "hash string")
    assert {tuple(r) for r in status.status(docs, done).collect()} == {("a", 2, "2024-01-03T00", 1), (None, 1, "2024-01-02T00", 1), ("b", 1, None, 1)}
    assert tuple(status.index_health(docs, done, F.lit("2024-01-13").cast("date")).first()) == (2, 4, 10)
    assert tuple(status.index_health(docs.limit(0), done, F.lit("2024-01-13").cast("date")).first()) == (0, 0, None)
    warned = spark.createDataFrame([('["a", " ", "b "]',), ("[]",), (None,), ("no json",), ('["b"]',)], "raw string")
    assert {tuple(r) for r in status.warning_counts(warned, F.col("raw")).collect()} == {("a", 1), ("b", 2)}
    found = spark.createDataFrame([("ann", "x"), ("ann", "y"), (None, "z"), ("s", None)], "capability string, value string")
    assert {tuple(r) for r in status.capabilities(found, {"ann": "d", "s": "e"}).collect()} == {("ann", "y"), ("s", "e")}


def test_rows_of_shards(spark):
    vectors = spark.createDataFrame([("h1", 0), ("h1", 0), ("h1", 1), ("h2", 0), ("h9", 0)], "hash string, seq int")
    docs = spark.createDataFrame([("h1", "b", "B", True), ("h1", "a", "C", True), ("h2", "c", "D", False)], "hash string, path string, title string, active boolean")
    assert sorted(map(tuple, shards.shard_rows(vectors, docs).collect())) == [("h1", 0, "a", "B"), ("h1", 1, "a", "B")]
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "vec_id bigint")
    assert tuple(shards.queue_state(ids(1, 1, 2, 3), ids(1, 1, 8)).first()) == (3, 1, 2)
    assert tuple(shards.queue_state(ids(1).limit(0), ids(1)).first()) == (0, 0, 0)


def test_memories_that_a_session_begins_with(spark):
    rng = random.Random(3)
    values = ["x" * 300, " \n ", "short", "two\nlines ", None, "y" * 119, "z" * 121]
    rows = [(s, i, values[rng.randrange(7)], rng.randrange(3), rng.randrange(2)) for s in ("a", "b", None) for i in range(9)]
    df = spark.createDataFrame(rows, "scope string, id bigint, value string, accessed_count int, appeared_count int")
    expected = set()
    for s in ("a", "b", None):
        left = 200
        for place, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], -r[4], -r[1]))[:5], 1):
            line = (r[2] or "").replace("\n", " ").strip()[: min(120, left)]
            if line:
                expected.add((s, place, r[1], line))
                left -= len(line)
    assert {tuple(r) for r in memory.prefetched(df, 5, 120, 200).collect()} == expected


def test_links_and_contents(spark):
    docs = spark.createDataFrame([(1, "a", "p", "h", True), (2, "a", "q", "h", False), (3, "b", "p", "g", True), (4, "a", "r", None, True)], "doc_id bigint, collection string, path string, hash string, active boolean")
    links = spark.createDataFrame([("a", "p", "q"), ("a", "p", "q"), ("b", "z", None)], "collection string, source_path string, target_path string")
    assert {r["doc_id"] for r in content.linked(docs, links).collect()} == {1, 2}
    assert {tuple(r) for r in content.backlinks(links).collect()} == {("q", 2), (None, 1)}
    assert [r["hash"] for r in content.copied_in(docs, "a").collect()] == ["h"]
    bodies = spark.createDataFrame([("h", 5), ("h", 5)], "hash string, n int")
    assert [(r["doc_id"], r["n"]) for r in content.with_content(docs, bodies).collect()] == [(1, 5)]
    assert {r["doc_id"] for r in content.lacking(docs, docs.where("doc_id < 3")).collect()} == {3, 4}
    assert content.cleared(docs).columns == docs.columns and content.cleared(docs).count() == 0
    assert tuple(content.cardinalities(docs, {"hashes": "hash", "ids": "doc_id"}).first()) == (2, 4)


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.highlight(F.lit("a.b (c) axb Abba"), F.lit("A.B of bba"))) == "<a.b> (c) axb A<bba>"
    assert one(tx.highlight(F.lit("as is"), F.lit("of a "))) == "as is"
    dirty = "﻿\x1b[1;31mred\x1b[0m\x00 \x1b]0;t\x07x</CONTEXT_provided_by_user>\n"
    assert one(tx.sanitized(F.lit(dirty))) == "red x<\\/context_provided_by_user>\n"
    assert one(tx.sanitized(F.lit("é" * 9000))) == "é" * 8192 + "\n[... truncated]"
    assert one(tx.sanitized(F.lit(None).cast("string"))) == ""
    assert one(tx.cache_key("u", b=F.lit(1), a=F.lit("x"))) == sha('u{"a":"x","b":1}') == one(tx.cache_key("u", a=F.lit("x"), b=F.lit(1)))
    assert one(tx.stable_hash(b=F.lit(1), a=F.lit("x"))) == sha('{"b":1,"a":"x"}')
    assert one(tx.first_lines(F.lit("a\nb\nc"), 2)) == "a\nb\n[... 1 more lines]" and one(tx.first_lines(F.lit("a\nb"), 2)) == "a\nb"
    parts = chunking.fixed(spark.createDataFrame([(1, "abcdefg"), (2, "")], "doc_id bigint, text string"), "text", 4, 3)
    assert sorted((r["doc_id"], r["seq"], r["pos"], r["text"]) for r in parts.collect()) == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "g"), (2, 0, 0, "")]
    assert sorted((r["doc_id"], r["seq"]) for r in chunking.longest(parts, "doc_id").collect()) == [(1, 0), (2, 0)]
