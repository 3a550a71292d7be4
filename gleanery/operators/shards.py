"""Shards of a vector table that are written and kept: copied in batches behind a stored cursor, checked, indexed.

In a folder, for each number of shards, `shards-n` holds a table a batch (batch-b, in folders by shard); cursor.json says how far the
copy has come. A batch is written first and the cursor moved after it, so that a run that ends between the two writes the
same batch again in its place: rows are copied once, whatever run is broken off. Only batches that the cursor covers are read.

States that are found and mended, each with a warning: a number of shards other than the cursor's (the copy starts anew in another
folder; the old one goes when the new one is whole), a cursor that can't be read or whose key the source no longer has (starts anew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import proximity
from gleanery.operators import vectors as ops
from gleanery.sources.tables import get_state, put_state, ranked, removed

_FRESH = {"shards": 0, "key": None, "batches": 0, "rows": 0, "completed": False}


def sync(source: DataFrame, root: str, shards: int, batch: int = 100_000, stop_after: int | None = None) -> dict:
    """Copy rows of source (vec_id, further columns; ids are unique) to shards by the hash of the id, in the order of ids, after the stored cursor. What the cursor holds then, with warnings.

    Rows after the cursor are sorted once, into a written table; each batch reads its own range of that.
    stop_after ends the run after so many batches.
    """
    spark, place = source.sparkSession, f"{root}/cursor.json"
    state, warnings = get_state(spark, place), []
    if state is None or set(state) != set(_FRESH):
        if _exists(spark, place):
            warnings.append("cursor_unreadable")
        state = dict(_FRESH, shards=shards)
    if state["shards"] != shards:
        warnings.append(f"topology_drift:{state['shards']}->{shards}")
        state = dict(_FRESH, shards=shards)
    if state["key"] is not None and source.where(F.col("vec_id") == state["key"]).isEmpty():
        warnings.append(f"cursor_lost:{state['key']}")
        state = dict(_FRESH, shards=shards)
    if not state["batches"]:
        removed(spark, f"{root}/shards-{shards}")
    left = source.where("vec_id is not null") if state["key"] is None else source.where(F.col("vec_id") > state["key"])
    rows = ranked(left.select("vec_id", *[c for c in source.columns if c != "vec_id"]), "vec_id", name="to-sync")
    ends = [r["vec_id"] for r in rows.where((F.col("_at") + 1) % batch == 0).select("vec_id").orderBy("vec_id").collect()]  # one id a batch
    last = rows.agg(F.max("vec_id")).first()[0]
    if last is not None and (not ends or ends[-1] != last):
        ends.append(last)
    for number, end in enumerate(ends):
        if stop_after is not None and number >= stop_after:
            break
        part = rows.where(F.col("vec_id") <= end).drop("_at")
        part = part if state["key"] is None else part.where(F.col("vec_id") > state["key"])
        dealt = part.withColumn("shard", ops.shard_of(F.col("vec_id").cast("string"), shards).cast("int"))
        dealt.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{root}/shards-{shards}/batch-{state['batches']}")
        count = spark.read.parquet(f"{root}/shards-{shards}/batch-{state['batches']}").count()
        state = dict(state, key=end, batches=state["batches"] + 1, rows=state["rows"] + count)
        put_state(spark, place, state)
    else:
        state = dict(state, completed=True)
        put_state(spark, place, state)
        for other in _others(spark, root, shards):
            removed(spark, other)
    return dict(state, warnings=warnings)


def _exists(spark: SparkSession, path: str) -> bool:
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base)


def _others(spark: SparkSession, root: str, shards: int) -> list[str]:
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)]
    return [p.toString() for p in names if p.getName().startswith("shards-") and p.getName() != f"shards-{shards}"]


def held(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows of the batches that the cursor covers, with their shard."""
    state = get_state(spark, f"{root}/cursor.json") or _FRESH
    paths = [f"{root}/shards-{state['shards']}/batch-{b}" for b in range(state["batches"])]
    out = spark.createDataFrame([], schema).withColumn("shard", F.lit(0))
    for path in paths:
        out = out.unionByName(spark.read.schema(out.schema).parquet(path))
    return out


def parity(source: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """shard, source_rows, shard_rows, missing and extra ids and misplaced ones, and whether all is equal, of each shard."""
    own = ops.shard_of(F.col("vec_id").cast("string"), shards).cast("int")
    a = source.where("vec_id is not null").select("vec_id", own.alias("a"))
    b = rows.select("vec_id", F.col("shard").alias("b"))
    both = a.join(b, "vec_id", "full")
    counts = both.groupBy(F.coalesce("a", "b").alias("shard")).agg(F.count("a").alias("source_rows"), F.count("b").alias("shard_rows"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a") != F.col("b")).alias("misplaced"))
    return counts.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("misplaced") == 0))


def rebuilt(spark: SparkSession, root: str, schema) -> int:
    """Write the graph of each shard whose rows have changed since its graph was built (told by number and sum of hashes); how many were built."""
    rows = held(spark, root, schema)
    marks = {r["shard"]: [r["n"], r["mark"]] for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.xxhash64("vec_id", "embedding").cast("decimal(38,0)")).cast("string").alias("mark")).collect()}
    known = get_state(spark, f"{root}/graphs.json") or {}
    stale = [s for s, mark in marks.items() if known.get(str(s)) != mark]
    for shard in stale:
        proximity.hnsw_build(rows.where(F.col("shard") == shard)).write.mode("overwrite").parquet(f"{root}/graphs/shard-{shard}")
        known[str(shard)] = marks[shard]
        put_state(spark, f"{root}/graphs.json", known)
    put_state(spark, f"{root}/graphs.json", {str(s): marks[s] for s in marks})
    return len(stale)


def searched(queries: DataFrame, root: str, schema, k: int, ef: int) -> DataFrame:
    """The k nearest of the kept shards: by the graphs of those that have one of their present rows, by all rows of the others."""
    spark = queries.sparkSession
    rows, known = held(spark, root, schema), get_state(spark, f"{root}/graphs.json") or {}
    there = [int(s) for s in known]
    by_rows = ops.exact(queries, rows.where(~F.col("shard").isin(there)), k)
    out = by_rows.select("query_id", "vec_id", "distance")
    for shard in there:
        graph = spark.read.parquet(f"{root}/graphs/shard-{shard}")
        out = out.unionByName(proximity.hnsw_search(queries, graph, k, ef).select("query_id", "vec_id", "distance"))
    return ops.nearest(out, k)


def shard_rows(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """hash, seq, path and title of every vector (hash, seq) that an active document holds: the first path and title of several, each row once."""
    owners = documents.where("active").groupBy("hash").agg(F.min("path").alias("path"), F.min("title").alias("title"))
    return vectors.select("hash", "seq").distinct().join(owners, "hash").select("hash", "seq", "path", "title")


def queue_state(vectors: DataFrame, synced: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: total (distinct vectors), processed (of these, what a shard has) and pending."""
    done = synced.select(key).distinct().withColumn("_done", F.lit(True))
    every = vectors.select(key).distinct().join(done, key, "left")
    return every.agg(F.count("*").alias("total"), F.count_if("_done").alias("processed")).withColumn("pending", F.col("total") - F.col("processed"))
