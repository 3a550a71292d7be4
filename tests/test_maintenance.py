import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import fusion, maintenance as ops
from gleanery.sources import sinks
from gleanery.streaming.deltas import Deltas


def test_a_collection_goes_from_all_tables(spark):
    documents = spark.createDataFrame([("a", "p", "h1"), ("b", "q", "h1"), ("b", "r", "h2"), (None, "s", "h3")], "collection string, path string, hash string")
    tables = {"documents": documents, "content": documents.select("hash").distinct(), "links": spark.createDataFrame([("b", "q")], "collection string, source string"), "settings": spark.createDataFrame([("x",)], "name string")}
    left = {r["tbl"]: r["rows"] for r in ops.sizes(ops.remove_collection(tables, "b")).collect()}
    assert left == {"documents": 2, "content": 2, "links": 0, "settings": 1}


def test_backups_are_verified_before_they_are_restored(spark, tmp_path):
    df = spark.range(50).withColumn("a b", F.lit("x"))
    path = str(tmp_path / "b")
    sinks.backup(df, path)
    assert sinks.intact(spark, path) and sinks.restore(spark, path).count() == 50
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.backup(df, path)
    spark.range(1).withColumn("a b", F.lit("y")).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="not what its manifest says"):
        sinks.restore(spark, path)


def test_caches(spark):
    cache = spark.createDataFrame([(i, i) for i in range(30)], "key int, at int")
    assert ops.evicted(cache, "at", "key", 30, 5).count() == 30
    assert sorted(r["key"] for r in ops.evicted(cache, "at", "key", 29, 5).collect()) == [25, 26, 27, 28, 29]
    uses = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("n", "c", 3), ("n", "a", 4), ("m", "a", 1)], "ns string, key string, at int")
    assert sorted((r["ns"], r["key"]) for r in ops.least_recently_used(uses, "ns", "key", "at", 2).collect()) == [("m", "a"), ("n", "a"), ("n", "c")]
    assert [r["key"] for r in ops.least_recently_used(uses, "ns", "key", "at", 2, F.lit(4)).collect()] == ["a"]


def test_bulk_operations_fail_one_by_one(spark):
    store = spark.createDataFrame([("s", "a", "1")], "scope string, key string, value string")
    rows = [(1, "put", "s", "b", "2"), (2, "delete", "s", "a", None), (3, "delete", "s", "a", None), (4, "put", "s", " ", "x"), (5, "put", "s", "c", ""), (6, "what", "s", "d", "x"), (7, "delete", "s", "b", None), (8, "put", "s", "b", "3"), (9, "put", "s", None, "x")]
    after, said = ops.bulk(store, spark.createDataFrame(rows, "op_id int, op string, scope string, key string, value string"))
    assert {r["op_id"]: r["status"] for r in said.collect()} == {1: "stored", 2: "deleted", 3: "not_found", 4: "invalid", 5: "invalid", 6: "invalid", 7: "deleted", 8: "stored", 9: "invalid"}
    assert [tuple(r) for r in after.collect()] == [("s", "b", "3")]


def test_shards_are_synced_in_steps(spark):
    source = spark.createDataFrame([(i,) for i in range(20)], "vec_id bigint")
    held, cursor = spark.createDataFrame([], "vec_id bigint, shard bigint"), -1
    for _ in range(3):
        step = ops.shard_sync(source, held, 4, cursor, 8).collect()
        assert {r["action"] for r in step} == {"copy"}
        held = held.unionByName(spark.createDataFrame([(r["vec_id"], r["shard"]) for r in step], held.schema))
        cursor = max(r["vec_id"] for r in step)
    assert cursor == 19 and ops.shard_sync(source, held, 4, cursor, 8).count() == 0
    drift = {r["action"] for r in ops.shard_sync(source.where("vec_id < 19"), held, 5, cursor, 8).collect()}
    assert drift == {"move", "delete"}


@pytest.mark.parametrize(
    ("text", "error"),
    [('{"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "a"}]}', None), ("{", "malformed"), ('{"links": []}', "no_nodes"), ('{"nodes": []}', "no_links"), ('{"nodes": [{"label": "x"}], "links": []}', "node_without_id"), ('{"nodes": [], "links": [{"source": "a"}]}', "link_without_ends"), (None, "malformed")],
)
def test_graph_files(spark, text, error):
    row = spark.createDataFrame([(text,)], "t string").select(ops.parsed_graph(F.col("t")).alias("g")).first()["g"]
    assert row["error"] == error and (row["graph"] is None) == (error is not None)


def test_payloads_of_models(spark):
    lines = json.dumps([{"type": "lex", "text": "a"}, {"type": "odd", "text": "b"}, {"type": "vec", "text": " "}])
    texts = [lines, f'{{"queries": {lines}}}', f"Sure:\n```json\n{lines}\n```", f"They are {lines} I think", "nothing", "[1, 2]", "", None]
    got = [r["p"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ops.expansion_payload(F.col("t")).alias("p")).orderBy("i").collect()]
    assert [[tuple(x) for x in p] if p else p for p in got] == [[("lex", "a")]] * 4 + [None] * 4


def test_policies(spark):
    grants = spark.createDataFrame([("r", ["query"], ["a"]), ("r", ["delete"], ["b"]), ("w", ["query"], ["*"])], "role string, operations array<string>, collections array<string>")
    rows = spark.createDataFrame([("a",), ("b",)], "collection string")
    allowed = lambda role, op: sorted(r["collection"] for r in ops.permitted(rows, grants, role, op).collect())
    assert allowed("r", "query") == ["a"] and allowed("r", "delete") == ["b"] and allowed("w", "query") == ["a", "b"] and allowed("w", "delete") == []


def test_snippets_alike_are_dropped(spark):
    sets = spark.createDataFrame([(1, "the quick brown fox jumps over lazy dogs today".split()), (2, "the quick brown fox jumps over lazy dogs now".split()), (3, "something else entirely here".split()), (4, "something else entirely here".split()), (5, []), (6, [])], "doc_id bigint, t array<string>")
    got = sorted((r["a"], r["b"], r["jaccard"]) for r in fusion.similar_sets(sets, 0.8).collect())
    assert got == [(1, 2, 0.8), (3, 4, 1.0), (5, 6, 1.0)]


def test_files_are_ingested_with_unlinks_and_restarts(spark, tmp_path):
    schema, root = "path string, type string, seq bigint, hash string", f"file://{tmp_path}/ingest"
    source = tmp_path / "events"
    source.mkdir()

    def deliver(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/{name}")
        for f in (tmp_path / name).glob("part*.json"):
            f.rename(source / f"{name}.json")

    start = spark.createDataFrame([("a", "h0"), ("b", "h0")], "path string, hash string")

    kept = Deltas(spark, root, start.schema)
    kept.start(start)

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{source}")
        run = kept.follow(stream, {"availableNow": True}, every=2)
        assert run.awaitTermination(120)
        return sorted(tuple(r) for r in kept.read().collect())

    deliver("one", [("a", "change", 1, "h1"), ("c", "add", 2, "h1"), ("c", "unlink", 3, None)])
    assert drain() == [("a", "h1"), ("b", "h0")]
    deliver("two", [("b", "unlink", 4, None), ("c", "add", 5, "h2")])
    assert drain() == [("a", "h1"), ("c", "h2")]
    assert drain() == [("a", "h1"), ("c", "h2")]
