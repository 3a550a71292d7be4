"""Scoped key-value memories as batches: deduplication, supersession, expiry, search, feedback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.tables import ranked, written

# Keys of which only the newest value holds.
SINGLE = ("first_name", "last_name", "full_name", "date_of_birth", "gender", "job_title", "card_holder_name")


def resolve_scope(explicit: Column, session: Column, workspace: Column, strict: Column) -> Column:
    """scope, source and error: the explicit scope, else the session's, else the workspace's, else the default."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    e, s, w = clean(explicit), clean(session), clean(workspace)
    allowed = F.coalesce(s, w)
    source = F.when(e.isNotNull(), "explicit").when(s.isNotNull(), "session").when(w.isNotNull(), "workspace").otherwise("default")
    return F.struct(F.coalesce(e, s, w, F.lit("default")).alias("scope"), source.alias("source"), F.when(strict & (e != allowed), "cross_scope_forbidden").alias("error"))


def derive_scope(path: Column) -> Column:
    """A readable scope of a workspace path: its last part and eight digits of the whole path's hash."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.element_at(parts, -1))), r"[^a-z0-9._-]+", "-"), "-+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "default").otherwise(F.concat(slug, F.lit("-"), F.substring(F.sha2(F.array_join(parts, "/"), 256), 1, 8)))


def key_prefix(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def tags(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda t: t != ""))


def merged_sources(values: Column) -> Column:
    """Comma lists as one list, each name once, in the order of the rows."""
    names = F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), lambda t: F.trim(t))))
    return F.array_join(F.array_distinct(F.filter(names, lambda t: t != "")), ",")


def exact_dedup(rows: DataFrame) -> DataFrame:
    """One memory of equal scope, key and value: how often it appeared, its first id, last sight and merged sources."""
    return rows.groupBy("scope", "key", "value").agg(F.min("id").alias("id"), F.count("*").alias("appeared_count"), F.max("created_at").alias("last_appeared_at"), merged_sources(F.transform(F.array_sort(F.collect_set(F.struct("source"))), lambda s: s["source"])).alias("source"))


def single_cardinality(rows: DataFrame, keys: tuple[str, ...] = SINGLE) -> DataFrame:
    """superseded_by: of the single-valued keys each row but the newest is replaced by the next."""
    order = Window.partitionBy("scope", "key").orderBy("id")
    return rows.withColumn("superseded_by", F.when(key_prefix(F.col("key")).isin(*keys), F.lead("id").over(order)))


def classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (id, embedding and `by`) with class: the smallest id of the equal vectors of a group. Null, empty and zero vectors are like nothing and form no class."""
    x = F.col("embedding")
    fine = rows.where(F.coalesce(F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull()), F.lit(False)))
    named = fine.groupBy(*by, "embedding").agg(F.min("id").alias("class"))
    return fine.join(named, [*by, "embedding"])


def near_classes(vectors: DataFrame, by: str, threshold: float, block: int = 4096) -> DataFrame:
    """by, a, b and similarity (twelve digits) of all pairs a < b of vectors (class, embedding) of a group whose cosine is at least `threshold`.

    Exact. Vectors lie on a line by a projection of theirs, and are cut into blocks of it: two blocks meet only if they come within
    the distance that such a cosine allows, each pair of blocks in a row of its own, as one product of matrices. So a large group
    is shared out among tasks, and only pairs that reach the threshold leave them.
    """
    spark, group = vectors.sparkSession, vectors.schema[by].dataType.simpleString()
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = vectors.select(F.col(by).alias("g"), "class", F.transform("embedding", lambda v: v.cast("double") / size).alias("x"))
    # signs dealt by the number of the entry: a direction that favours none, of length one
    signs = lambda v, i: v * F.when(F.pmod(F.xxhash64(i), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    line = F.aggregate(F.transform("x", signs), F.lit(0.0), lambda s, v: s + v) / F.sqrt(F.size("x").cast("double"))
    placed = ranked(unit.withColumn("line", line), "g", "line", "class", name="line").withColumn("block", F.floor(F.col("_at") / block))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lines = table["line"].to_numpy()
        rows = table["x"].combine_chunks()
        width = max((len(r) for r in rows), default=0)
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, : len(r)] = r.values.to_numpy(zero_copy_only=False)
        return pa.table({"g": table["g"][:1], "block": pa.array([key[1].as_py()], pa.int64()), "low": [lines.min()], "high": [lines.max()], "ids": pa.array([table["class"].to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    blocks = written(placed.select("g", "block", "class", "line", "x").groupBy("g", "block").applyInArrow(pack, f"g {group}, block bigint, low double, high double, ids binary, x binary"), "blocks")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    # the pairs are told from a few numbers a block, and vectors come to them afterwards
    ends = blocks.select("g", "block", "low", "high")
    other = ends.select("g", F.col("block").alias("with"), F.col("low").alias("other_low"))
    meet = ends.join(other, "g").where((F.col("with") >= F.col("block")) & (F.col("other_low") - F.col("high") <= reach)).select("g", "block", "with")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names) if n != "g"}
                ids, others = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["other_ids"], np.int64)
                x, y = np.frombuffer(row["x"]).reshape(len(ids), -1), np.frombuffer(row["other_x"]).reshape(len(others), -1)
                n = min(x.shape[1], y.shape[1])
                for at in range(0, len(ids), 1024):
                    like = np.round(x[at : at + 1024, :n] @ y[:, :n].T, 12)
                    i, j = np.nonzero(like >= threshold)
                    a, b, s = ids[at + i], others[j], like[i, j]
                    keep = a < b if row["block"] == row["with"] else np.ones(len(a), bool)
                    a, b, s = a[keep], b[keep], s[keep]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[r], len(a)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["g", "a", "b", "similarity"])

    pairs = meet.join(blocks.select("g", "block", "ids", "x"), ["g", "block"]).join(blocks.select("g", F.col("block").alias("with"), F.col("ids").alias("other_ids"), F.col("x").alias("other_x")), ["g", "with"])
    found = pairs.select("g", "block", "with", "ids", "x", "other_ids", "other_x").mapInArrow(compare, f"g {group}, a bigint, b bigint, similarity double")
    return written(found, "near").select(F.col("g").alias(by), "a", "b", "similarity")


def semantic_supersession(rows: DataFrame, threshold: float = 0.92, cross: float = 0.94) -> DataFrame:
    """id and superseded_by: in the order of ids, a memory replaces the live one most like it of its scope and key prefix (ties: the smaller id), or, where there is none of that prefix, of its scope.

    The fold runs over near pairs: equal vectors of a prefix are one class, and its first row comes with the classes near its own. A scope's
    rows are streamed, sorted, through one task, which holds the near pairs of its distinct vectors, the live id of each and a count a prefix, but
    no vectors and no rows.
    """
    named = classes(rows.select("id", "scope", "prefix", "embedding"), ["scope", "prefix"])
    named = written(named.select("id", "scope", "prefix", "class", "embedding"), "classes")
    each = named.where("id = class")
    near = near_classes(each.select("scope", "class", "embedding"), "scope", min(threshold, cross))
    both = near.select("a", "b", "similarity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    # equal vectors of two prefixes are two classes at similarity one; the other's prefix goes along
    links = both.join(each.select(F.col("class").alias("b"), F.col("prefix").alias("b_prefix")), "b").groupBy(F.col("a").alias("class")).agg(F.collect_list(F.struct("b", "b_prefix", "similarity")).alias("near"))
    first = each.select("id").join(links.withColumnRenamed("class", "id"), "id")
    every = rows.select("id", "scope", "prefix").join(named.select("id", "class"), "id", "left").join(first, "id", "left")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, live, count, around = object(), {}, {}, {}
        for batch in batches:
            gone, by = [], []
            for at, i, prefix, own, near in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if at != scope:
                    scope, live, count, around = at, {}, {}, {}
                same, best = count.get(prefix, 0) > 0, None
                if own is not None:
                    if near is not None:
                        around[own] = [(n["b"], n["b_prefix"], n["similarity"]) for n in near]
                    least = threshold if same else cross
                    pool = [(own, prefix, 1.0), *(n for n in around.get(own, ()) if not same or n[1] == prefix)]
                    best = min(((-s, live[c][0], c, p) for c, p, s in pool if s >= least and live.get(c)), default=None)
                if best:
                    gone.append(best[1])
                    by.append(i)
                    live[best[2]].pop(0)
                    count[best[3]] -= 1
                if own is not None:
                    live.setdefault(own, []).append(i)
                count[prefix] = count.get(prefix, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64()), pa.array(by, pa.int64())], ["id", "superseded_by"])

    ordered = every.select("scope", "id", "prefix", "class", "near").repartition("scope").sortWithinPartitions("scope", "id")
    return rows.select("id").join(ordered.mapInArrow(fold, "id bigint, superseded_by bigint"), "id", "left")


def consolidation(rows: DataFrame, threshold: float) -> DataFrame:
    """id and merged_into: newest first within a scope and prefix, an older near copy goes into the newest kept one near it.

    Copies of a vector share the fate of the newest. The others are told from near pairs alone: a class is kept if no newer kept one is near it.
    Pairs are streamed in order, group by group; a task holds the ids that are kept, and of those only such as have neighbours.
    """
    group = F.to_json(F.struct("scope", "prefix")).alias("group")
    named = written(classes(rows.select("id", group, "embedding"), ["group"]), "classes")
    newest = named.groupBy("class").agg(F.max("id").alias("newest"))
    vectors = named.where("id = class").join(newest, "class").select("group", F.col("newest").alias("class"), "embedding")
    near = near_classes(vectors, "group", threshold)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), set()
        for batch in batches:
            merged, into = [], []
            for g, older, newer in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if g != now:
                    now, kept = g, set()
                best = max((n for n in newer if n in kept), default=None)
                if best is None:
                    kept.add(older)
                else:
                    merged.append(older)
                    into.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(merged, pa.int64()), pa.array(into, pa.int64())], ["newest", "into"])

    # nodes with neighbours, newest first, each with its newer neighbours
    older = near.select("group", F.col("a").alias("node"), F.col("b").alias("newer")).unionByName(near.select("group", F.col("b").alias("node"), F.lit(None).cast("bigint").alias("newer")))
    nodes = older.groupBy("group", "node").agg(F.collect_list("newer").alias("newer"))
    ordered = nodes.repartition("group").sortWithinPartitions("group", F.desc("node"))
    fate = ordered.mapInArrow(fold, "newest bigint, into bigint")
    of_class = newest.join(fate, "newest", "left")
    told = named.select("id", "class").join(of_class, "class").select("id", F.coalesce("into", F.when(F.col("id") < F.col("newest"), F.col("newest"))).alias("merged_into"))
    return rows.select("id").join(told, "id", "left")


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """scope, a > b and similarity (six digits) of one scope and prefix whose cosine reaches the threshold: pairs of distinct vectors, each named by its smallest id, and each copy of a vector with that id."""
    group = F.to_json(F.struct("scope", "prefix")).alias("group")
    named = written(classes(rows.select("id", "scope", group, "embedding"), ["scope", "group"]), "classes")
    each = named.where("id = class")
    near = near_classes(each.select("group", "class", "embedding"), "group", threshold - 1e-6)
    pairs = near.join(each.select(F.col("class").alias("a"), "scope"), "a").select("scope", F.col("b").alias("a"), F.col("a").alias("b"), F.round("similarity", 6).alias("similarity"))
    copies = named.where("id > class").select("scope", F.col("id").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold).unionByName(copies)


def live(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("superseded_by").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def text_search(rows: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, id and place: live rows of the query's scope whose text holds all of its words, by hit rate and accesses."""
    words = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "")
    q = queries.select("query_id", "scope", words.alias("words")).where(F.size("words") > 0)
    text = F.lower(F.concat_ws(": ", "key", "value"))
    hits = rows.join(q, "scope").where(F.forall("words", lambda w: F.contains(text, w)))
    rate = F.when(F.col("appeared_count") == 0, 0.0).otherwise(F.col("accessed_count") / F.col("appeared_count"))
    order = Window.partitionBy("query_id").orderBy(F.desc(rate), F.desc("accessed_count"), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "id", "place")


def counters(rows: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """What reading changes: appeared and accessed by one a sight, and sliding expiry; the rows themselves stay."""
    n = seen.groupBy("id").agg(F.count("*").alias("n"))
    slide = F.when(F.col("ttl_seconds").isNotNull(), now + F.make_interval(secs=F.col("ttl_seconds"))).otherwise(F.col("expires_at"))
    return rows.join(n, "id").select("id", (F.col("appeared_count") + F.col("n")).alias("appeared_count"), (F.col("accessed_count") + F.col("n")).alias("accessed_count"), slide.alias("expires_at"))


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without those ids; who was replaced by a deleted row is replaced by what replaced that one."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    kept = rows.join(gone, rows["id"] == gone["gone"], "left_anti")
    bridge = rows.join(gone, rows["id"] == gone["gone"]).select(F.col("gone"), F.col("superseded_by").alias("next"))
    healed = kept.join(bridge, kept["superseded_by"] == bridge["gone"], "left")
    return healed.withColumn("superseded_by", F.when(F.col("gone").isNotNull(), F.col("next")).otherwise(F.col("superseded_by"))).drop("gone", "next")


def evict(rows: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """The rows each scope may keep: victims go by earliest access, those never accessed last."""
    order = Window.partitionBy("scope").orderBy(F.col("last_accessed_at").desc_nulls_first(), F.desc("id"))
    numbered = rows.withColumn("_r", F.row_number().over(order)).join(limits, "scope", "left")
    return numbered.where(F.col("_r") <= F.coalesce("max_rows", F.lit(default))).drop("_r", "max_rows")


def stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope").agg(F.count_if(F.col("superseded_by").isNull()).alias("live"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count("*").alias("total"), F.sum("accessed_count").alias("accessed"))


def embed(rows: DataFrame, done: DataFrame, embedder) -> DataFrame:
    """Embeddings of rows (id, text) that have none yet, in Arrow batches through the embedder (list of texts to matrix)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": list(np.asarray(embedder(list(batch["text"])), np.float32))})

    return rows.select("id", "text").join(done.select("id"), "id", "left_anti").mapInPandas(run, "id bigint, embedding array<float>")


def semantic_search(rows: DataFrame, queries: DataFrame, least: float, limit: int) -> DataFrame:
    """scope, query_id, id and similarity: the nearest memories (id, embedding) of a query's own scope, ties to the smaller id; products of matrices a batch, no pair leaves a task but the nearest."""
    from gleanery.operators.vectors import of_scope

    near = of_scope(queries.withColumnRenamed("q", "embedding"), rows.withColumnRenamed("id", "vec_id"), limit).withColumn("similarity", F.round(1 - F.col("distance"), 6))
    found = near.where(F.col("similarity") >= least).join(queries.select("query_id", "scope").distinct(), "query_id")
    return found.select("scope", "query_id", F.col("vec_id").alias("id"), "similarity")


def inserted(rows: DataFrame, new: DataFrame, limits: DataFrame | None = None, default: int | None = None) -> DataFrame:
    """rows with new ones, and where a limit is given only as many of a scope as it allows (see evict())."""
    every = rows.unionByName(new)
    if default is None:
        return every
    return evict(every, limits if limits is not None else rows.sparkSession.createDataFrame([], "scope string, max_rows int"), default)


def history(rows: DataFrame, key: str) -> DataFrame:
    """All rows of a key with version, from 1 in each scope by age, superseded ones too."""
    order = Window.partitionBy("scope").orderBy("created_at", "id")
    return rows.where(F.col("key") == key).withColumn("version", F.row_number().over(order))


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    """rows without those that have expired by now."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def prefetched(rows: DataFrame, limit: int = 3, line: int = 120, total: int = 360) -> DataFrame:
    """scope, place, id and line of what a session begins with: the `limit` most accessed memories of a scope, each on a line of its own.

    A line is cut at `line` characters and where the lines of a scope reach `total`; blank values are passed over, but have
    their place among the most accessed.
    """
    order = Window.partitionBy("scope").orderBy(F.desc("accessed_count"), F.desc("appeared_count"), F.desc("id"))
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    clean = F.trim(F.replace(F.coalesce("value", F.lit("")), F.lit("\n"), F.lit(" ")))
    cut = top.select("scope", "place", "id", F.substring(clean, 1, line).alias("_line"))
    before = F.coalesce(F.sum(F.length("_line")).over(Window.partitionBy("scope").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = cut.withColumn("_left", F.lit(total) - before).where("_left > 0 AND _line <> ''")
    return left.select("scope", "place", "id", F.expr("substring(_line, 1, int(_left))").alias("line"))
