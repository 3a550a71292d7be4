import sqlite3

import pytest
from pyspark.sql import functions as F

from gleanery.functions.providers import hash_embedding
from gleanery.operators import fusion, memory
from gleanery.plans import registry
from gleanery.sources import files
from gleanery.sources.stores import VectorStore, fresh
from gleanery.streaming import events, folds


def store(path, rows, fulltext=True):
    base = sqlite3.connect(path)
    base.executescript("CREATE TABLE collections (id TEXT, name TEXT); CREATE TABLE embeddings (id TEXT, embedding_id TEXT, collection_id TEXT); CREATE TABLE embedding_metadata (id TEXT, key TEXT, string_value TEXT, int_value INT)")
    base.execute("INSERT INTO collections VALUES ('c', 'notes')")
    if fulltext:
        base.execute("CREATE TABLE embedding_fulltext (string_value TEXT)")
    for i, (name, text, meta) in enumerate(rows, 1):
        base.execute("INSERT INTO embeddings (rowid, id, embedding_id, collection_id) VALUES (?, ?, ?, 'c')", (i, f"u{i:03}", name))
        if fulltext:
            base.execute("INSERT INTO embedding_fulltext (rowid, string_value) VALUES (?, ?)", (i, text))
        for key, value in meta.items():
            base.execute("INSERT INTO embedding_metadata VALUES (?, ?, ?, ?)", (f"u{i:03}", key, value if isinstance(value, str) else None, value if isinstance(value, int) else None))
    base.commit()
    base.close()


@pytest.mark.parametrize("rows", [3, 10_000])
def test_importing_twice_adds_nothing(spark, tmp_path, rows):
    made = [(f"d{i}", f"text {i % 17}", {"path": f"p/{i % 20}.md", "page": i} if i % 2 else {"title": f"T{i}"}) for i in range(50)] + [("blank", " ", {}), ("none", None, {"chroma:document": "said in the metadata"})]
    store(tmp_path / "s.db", made)
    spark.dataSource.register(VectorStore)
    entries = spark.read.format("vector_store_file").options(path=f"file://{tmp_path}/s.db", rows=rows).load()
    found = {r["id"]: r for r in entries.collect()}
    assert len(found) == 52 and (found["u002"]["path"], found["u002"]["text"], found["u003"]["path"], found["u003"]["title"]) == ("p/1.md", "text 1", "d2", "T2")
    empty = spark.createDataFrame([], "collection string, path string, hash string")
    first = fresh(entries, empty, "imported")
    added = {(r["path"], r["text"]) for r in first.collect()}
    assert len(added) == 25 + 10 + 1 and ("none", "said in the metadata") in added and ("p/1.md", "text 1") in added
    assert fresh(entries, first, "imported").count() == 0
    assert fresh(entries, first.where("path <> 'd2'"), "imported").count() == 1


def test_other_files_are_refused(spark, tmp_path):
    sqlite3.connect(tmp_path / "other.db").execute("CREATE TABLE t (x INT)")
    spark.dataSource.register(VectorStore)
    with pytest.raises(Exception, match="no vector store"):
        spark.read.format("vector_store_file").option("path", str(tmp_path / "other.db")).load().count()


def test_json_shapes(spark):
    texts = {
        "list": '[{"b": 1, "a": "x y", "n": null}, {"a": [1, {"z": 2, "y": 3}]}]',
        "within": '{"name": "[1]", "list": [true, "two", 3.5, null], "other": [1]}',
        "object": '{"z": {"k": 1}, "a": false}',
        "plain": ' [1, 2] ',
        "value": "7",
        "bad": "{",
        "none": None,
        "empty": "[]",
        "long": "[" + ",".join(f'{{"i":{i}}}' for i in range(120)) + "]",
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {(r["path"], r["block"]): (r["body"], r["warning"]) for r in files.json_blocks(df, "path", "text").collect()}
    assert got["list", 0][0] == 'Schema: b: number, a: string, n: object\nItems 1-2:\n{"b":1,"a":"x y","n":null}\n{"a":[1,{"z":2,"y":3}]}'
    assert got["within", 0][0] == 'Schema: \nItems 1-4:\ntrue\n"two"\n3.5\nnull'
    assert got["object", 0][0] == 'Schema: z: object, a: boolean\nItems 1-1:\n{"z":{"k":1},"a":false}'
    assert got["plain", 0][0] == "Schema: \nItems 1-2:\n1\n2" and got["value", 0][0] == "Schema: \nItems 1-1:\n7"
    assert got["bad", 0] == got["none", 0] == ("", "extractor_failed:json_error") and ("empty", 0) not in got
    assert [got["long", b][0].split("\n")[1] for b in range(3)] == ["Items 1-50:", "Items 51-100:", "Items 101-120:"] and ("long", 3) not in got


def test_registry_equals_a_dictionary(spark, sf):
    rows = sorted((r["event_type"], r["ts"], r["event_id"], str(r["user_id"])) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    want, key, held = {}, None, {}
    for kind, ts, i, session in rows:
        if kind != key:
            key, held = kind, {}
        gone = [s for s, last in held.items() if (ts - last).total_seconds() >= 36_000]
        for s in gone:
            del held[s]
        if session not in held and len(held) == 4:
            gone.append(next(iter(held)))
            del held[gone[-1]]
        held[session] = ts
        want[i] = ",".join(gone)
    assert {r["event_id"]: r["gone"] for r in registry.queries()["st_session_registry"](spark, sf).collect()} == want


def test_streams_over_shuffled_files_and_restarts(spark, tmp_path):
    import random

    pick = random.Random(5)
    rows = [(i, f"k{pick.randrange(4)}", 1_700_000_000_000_000 + pick.randrange(3_600) * 1_000_000 + pick.randrange(1000), pick.random() < 0.6) for i in range(400)]
    schema = "event_id bigint, key string, us bigint, ok boolean"
    instants = lambda df: df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    batch = {tuple(r) for r in events.breaker(instants(spark.createDataFrame(rows, schema)), 2, 300.0).collect()}
    source, out = tmp_path / "in", []
    source.mkdir()

    def deliver(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(f"file://{source}")

    def drain():
        stream = instants(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(f"file://{source}"))
        run = events.ingest(events.stateful.in_order(stream, ["ok"], "state string", folds.breaker(2, 300.0), "2 hours").select("event_id", "key", "state"), lambda b, i: out.extend(map(tuple, b.collect())), f"file://{tmp_path}/state", trigger={"availableNow": True})
        run.awaitTermination()

    pick.shuffle(rows)
    for at in range(0, 200, 100):
        deliver(rows[at : at + 100])
    drain()
    deliver(rows[200:])
    drain()
    deliver([(-1, "end", 1_900_000_000_000_000, True)])
    drain()
    assert len(out) == len(batch) == 400 and set(out) == batch


def test_embeddings_of_memories(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "id bigint, text string")
    out = {r["id"]: r["embedding"] for r in memory.embed(rows, rows.where("id % 3 = 0"), hash_embedding).collect()}
    assert sorted(out) == [1, 2, 4, 5] and all(out[i] == pytest.approx(hash_embedding([f"text {i}"])[0].tolist(), abs=1e-6) for i in out)


def test_snippets_kept_equal_a_loop(spark):
    rows = [(q, p, s) for q in range(3) for p, s in enumerate(["alpha beta gamma delta", "alpha beta gamma delta eps", "other words here now", "alpha beta gamma delta", "a b", "", "words other now here"], 1)]
    got = {(r["query_id"], r["place"]) for r in fusion.snippet_dedup(spark.createDataFrame(rows, "query_id int, place int, snippet string")).collect()}
    want = set()
    for q in range(3):
        kept = []
        for _, p, s in (r for r in rows if r[0] == q):
            t = {w for w in s.lower().split() if len(w) > 2}
            if not any((len(t & u) / len(t | u) if t | u else 1.0) >= 0.8 for u in kept):
                kept.append(t)
                want.add((q, p))
    assert got == want


def test_capability_manifest_names_each_capability_once(spark, sf):
    rows = registry.queries()["capability_manifest"](spark, sf).collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)


def test_long_lists_of_snippets_equal_a_loop(spark):
    import random

    deal = random.Random(3)
    lists = {q: [[w for w in (f"w{deal.randrange(9)}x" for _ in range(deal.choice((0, 1, 3, 9, 12))))] for _ in range(300)] for q in (1, 2)}
    # a chain in which each is like the next alone, so that every other one goes
    lists[3] = [[f"c{i + k}c" for k in range(20)] for i in range(0, 60, 2)]
    rows = [(q, p, " ".join(ws)) for q, some in lists.items() for p, ws in enumerate(some, 1)]
    df = spark.createDataFrame(rows, "query_id int, place int, snippet string")
    assert "aggregate(" not in (fusion.snippet_dedup(df)._jdf.queryExecution().optimizedPlan().toString())
    got = {(r["query_id"], r["place"]) for r in fusion.snippet_dedup(df).collect()}
    want = set()
    for q, some in lists.items():
        kept = []
        for p, ws in enumerate(some, 1):
            t = set(ws)
            if not any((len(t & u) / len(t | u) if t | u else 1.0) >= 0.8 for u in kept):
                kept.append(t)
                want.add((q, p))
    assert got == want and (3, 2) not in got and (3, 3) in got


def test_similar_sets_equal_all_pairs_and_move_few(spark, monkeypatch):
    import random

    deal = random.Random(5)
    sets = [sorted({f"w{min(deal.randrange(40), deal.randrange(40))}" for _ in range(deal.choice((0, 1, 2, 5, 10, 30, 80)))}) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id bigint, t array<string>")
    first = {}
    for i, t in enumerate(sets):
        first.setdefault(tuple(t), i)
    want = {(first[tuple(t)], i, 1.0) for i, t in enumerate(sets) if first[tuple(t)] != i}
    reps = [(i, set(t)) for t, i in first.items()]
    want |= {(i, j, round(len(t & u) / len(t | u), 6)) for i, t in reps for j, u in reps if i < j and len(t & u) / len(t | u) >= 0.8}
    held = {}
    keep = fusion.written
    monkeypatch.setattr(fusion, "written", lambda made, name: held.setdefault(name, keep(made, name)))
    assert {tuple(r) for r in fusion.similar_sets(df, 0.8).select("a", "b", "jaccard").collect()} == want
    # what is joined are prefixes: of a set of n tokens n // 5 + 1 at most
    assert all(r["k"] <= r["n"] // 5 + 1 for r in held["prefixes"].groupBy("a", "n").agg({"*": "count"}).toDF("a", "n", "k").collect())
