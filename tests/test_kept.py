"""Tables and states that last: delta files, watched folders, shards behind a cursor."""

import os
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import shards, vectors
from gleanery.sources.tables import committed, get_state
from gleanery.sources.watch import FolderEvents
from gleanery.streaming.deltas import Deltas

ROWS, EVENTS = "path string, hash string", "path string, type string, seq bigint, hash string"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_deltas_equal_a_dictionary(spark, tmp_path):
    root, pick, want = f"file://{tmp_path}/t", random.Random(3), {f"p{i}": "h" for i in range(2000)}
    kept = Deltas(spark, root, ROWS)
    kept.start(spark.createDataFrame(list(want.items()), ROWS))
    kept.start(spark.createDataFrame([("no", "no")], ROWS))
    seq, read = 0, lambda: dict(map(tuple, kept.read().collect()))
    for number in range(6):
        events = []
        for _ in range(20):
            seq += 1
            path, kind = f"p{pick.randrange(2010)}", pick.choice(["add", "change", "unlink"])
            events.append((path, kind, seq, f"h{seq}"))
            if kind == "unlink":
                want.pop(path, None)
            else:
                want[path] = f"h{seq}"
        pick.shuffle(events)
        kept.apply(spark.createDataFrame(events, EVENTS).coalesce(1), number)
        kept.apply(spark.createDataFrame(events, EVENTS).coalesce(1), number)  # a batch that runs again
        assert read() == want
        if number == 3:
            assert kept.compact() == 3 and read() == want and kept.vacuum() == 5 and read() == want
    assert size(tmp_path / "t/delta-5") < size(tmp_path / "t/base-3") / 3
    assert kept.compact() == 5 and kept.compact() is None and kept.vacuum() == 3 and read() == want
    assert [n for n, _ in committed(spark, root, "base")] == [5] and not committed(spark, root, "delta")
    (tmp_path / "t/delta-6").mkdir()  # half written
    assert read() == want and kept.pending() == []


def test_a_watched_folder_over_restarts(spark, tmp_path):
    folder, root = tmp_path / "docs", f"file://{tmp_path}/kept"
    (folder / "a").mkdir(parents=True)
    (folder / "node_modules").mkdir()
    spark.dataSource.register(FolderEvents)
    kept = Deltas(spark, root, "path string, size bigint")
    seen = []

    def drain(settle=0):
        stream = spark.readStream.format("folder_events").options(path=str(folder), state=f"{tmp_path}/listings", pattern="*.md", settle=settle).load()
        batches = []

        def step(batch, number):
            batches.extend((r["path"], r["type"]) for r in batch.collect())
            kept.apply(batch, number)

        run = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        seen.append(sorted(batches))
        return {r["path"]: r["size"] for r in kept.read().collect()}

    (folder / "a/one.md").write_text("1")
    (folder / "two.md").write_text("22")
    (folder / "node_modules/no.md").write_text("x")
    (folder / "no.txt").write_text("x")
    assert drain() == {"a/one.md": 1, "two.md": 2}
    assert drain() == {"a/one.md": 1, "two.md": 2}
    (folder / "two.md").write_text("333")
    (folder / "a/one.md").unlink()
    (folder / "three.md").write_text("4444")
    (folder / "gone.md").write_text("x")
    (folder / "gone.md").unlink()
    assert drain() == {"two.md": 3, "three.md": 4}
    (folder / "late.md").write_text("5")
    (folder / "two.md").write_text("still being written")
    assert drain(settle=3600) == {"two.md": 3, "three.md": 4}
    os.utime(folder / "late.md", (time.time() - 7200,) * 2)
    assert drain(settle=3600) == {"two.md": 3, "three.md": 4, "late.md": 1}
    assert seen == [[("a/one.md", "add"), ("two.md", "add")], [], [("a/one.md", "unlink"), ("three.md", "add"), ("two.md", "change")], [], [("late.md", "add")]]
    assert len(list((tmp_path / "listings").glob("listing-*"))) <= 2


SCHEMA = "vec_id bigint, embedding array<double>"


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], SCHEMA).repartition(6)


def state(spark, root, source, n):
    rows = sorted((r["vec_id"], r["shard"]) for r in shards.held(spark, root, SCHEMA).collect())
    return rows, all(r["equal"] for r in shards.parity(source, shards.held(spark, root, SCHEMA), n).collect())


def test_a_sync_that_is_killed_goes_on(spark, source, tmp_path, monkeypatch):
    root, whole = f"file://{tmp_path}/s", f"file://{tmp_path}/w"
    first = shards.sync(source, root, 4, 64, stop_after=2)
    assert (first["batches"], first["rows"], first["completed"], first["key"]) == (2, 128, False, 127 * 3)
    put = shards.put_state
    monkeypatch.setattr(shards, "put_state", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # the batch is written, the cursor is not moved
        shards.sync(source, root, 4, 64)
    monkeypatch.setattr(shards, "put_state", put)
    assert len(shards.held(spark, root, SCHEMA).collect()) == 128 and not state(spark, root, source, 4)[1]
    last = shards.sync(source, root, 4, 64)
    assert (last["rows"], last["completed"], last["warnings"]) == (400, True, [])
    shards.sync(source, whole, 4, 1000)
    assert state(spark, root, source, 4) == state(spark, whole, source, 4) and state(spark, root, source, 4)[1]
    again = shards.sync(source, root, 4, 64)
    assert (again["rows"], again["batches"]) == (400, last["batches"])


def test_drift_and_lost_cursors_start_anew(spark, source, tmp_path):
    root = f"file://{tmp_path}/s"
    shards.sync(source, root, 4, 150)
    moved = shards.sync(source, root, 3, 150)
    assert moved["warnings"] == ["topology_drift:4->3"] and state(spark, root, source, 3)[1]
    assert sorted(p.name for p in (tmp_path / "s").glob("shards-*")) == ["shards-3"]
    less = source.where("vec_id < 900")
    lost = shards.sync(less, root, 3, 150)
    assert lost["warnings"] == [f"cursor_lost:{399 * 3}"] and lost["rows"] == 300 and state(spark, root, less, 3)[1]
    (tmp_path / "s/cursor.json").write_text("{")
    assert shards.sync(less, root, 3, 150)["warnings"] == ["cursor_unreadable"] and get_state(spark, f"{root}/cursor.json")["rows"] == 300
    found = shards.parity(source, shards.held(spark, root, SCHEMA), 3).agg(F.sum("missing"), F.sum("extra")).first()
    assert tuple(found) == (100, 0)


def test_graphs_of_changed_shards_are_built_again(spark, source, tmp_path):
    root = f"file://{tmp_path}/s"
    shards.sync(source.where("vec_id < 600"), root, 3, 1000)
    assert shards.rebuilt(spark, root, SCHEMA) == 3 and shards.rebuilt(spark, root, SCHEMA) == 0
    q = source.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    shards.sync(source, root, 3, 1000)
    assert shards.rebuilt(spark, root, SCHEMA) == 3
    ours = {(r["query_id"], r["rank"]): r["vec_id"] for r in shards.searched(q, root, SCHEMA, 5, 200).collect()}
    theirs = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.exact(q, source, 5).collect()}
    assert ours.keys() == theirs.keys() and np.mean([ours[k] == theirs[k] for k in theirs]) >= 0.95
