"""Keeping a corpus in order: cascades, clean-up, health, shard sync, reconciliation, caches, policies, tolerant parsing.

Tables are snapshots: operators return what is to be written, or what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.vectors import shard_of


def remove_collection(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """All tables without a collection: rows of their own go by name, content and vectors that no document is left for by hash."""
    out = {k: t.where(~F.col("collection").eqNullSafe(F.lit(name))) if "collection" in t.columns else t for k, t in tables.items()}
    left = out["documents"].select("hash").distinct()
    return {k: t if k == "documents" or "hash" not in t.columns else t.join(left, "hash", "left_semi") for k, t in out.items()}


def cleaned(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """documents without inactive ones, content and vectors without orphans, cache without what has expired."""
    documents = tables["documents"].where("active")
    left = documents.select("hash").distinct()
    return {
        "documents": documents,
        "content": tables["content"].join(left, "hash", "left_semi"),
        "vectors": tables["vectors"].join(left, "hash", "left_semi"),
        "cache": tables["cache"].where(F.col("expires_at").isNull() | (F.col("expires_at") > now)),
    }


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """tbl and rows of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def health(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents, active ones, contents that wait for vectors, vectors without content, and a state."""
    hashes = documents.where("active").select("hash").distinct()
    known = vectors.select("hash").distinct()
    counts = documents.agg(F.count("*").alias("documents"), F.count_if("active").alias("active"))
    pending = hashes.join(known, "hash", "left_anti").agg(F.count("*").alias("pending"))
    orphans = known.join(documents.select("hash").distinct(), "hash", "left_anti").agg(F.count("*").alias("orphans"))
    row = counts.join(pending).join(orphans)  # three tables of one row
    return row.withColumn("state", F.when((F.col("pending") == 0) & (F.col("orphans") == 0), "ok").when(F.col("orphans") > 0, "inconsistent").otherwise("indexing"))


def evicted(cache: DataFrame, at: str, key: str, trigger: int = 1500, keep: int = 1000) -> DataFrame:
    """The cache as it is up to `trigger` rows; beyond, its `keep` newest."""
    return cache.orderBy(F.desc(at), F.desc(key)).limit(keep) if cache.limit(trigger + 1).count() > trigger else cache


def least_recently_used(accesses: DataFrame, by: str, key: str, at: str, capacity: int, since: Column | None = None) -> DataFrame:
    """by, key and last use of what a bounded cache holds after these accesses: the `capacity` keys used last in each namespace, none older than since."""
    last = accesses.groupBy(by, key).agg(F.max(at).alias("last"))
    live = last if since is None else last.where(F.col("last") >= since)
    order = Window.partitionBy(by).orderBy(F.desc("last"), key)
    return live.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= capacity).drop("_r")


def reconciled(known: DataFrame, disk: DataFrame) -> DataFrame:
    """path and type of what a watcher has missed: known and disk are (path, mtime); add, change (newer on disk) or unlink."""
    both = known.select("path", F.col("mtime").alias("was")).join(disk.select("path", F.col("mtime").alias("now")), "path", "full")
    kind = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "unlink").when(F.col("now") > F.col("was"), "change")
    return both.select("path", kind.alias("type")).where("type is not null")


def applied(snapshot: DataFrame, events: DataFrame, key: str = "path") -> DataFrame:
    """A snapshot after a micro-batch of events (key, type, seq, further columns): the last event of a key decides; unlink takes the row out, add and change replace it."""
    values = [c for c in snapshot.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct("type", *values), "seq").alias("e"))
    kept = snapshot.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("e.type <> 'unlink'").select(key, *[F.col(f"e.{c}").alias(c) for c in values]).select(*snapshot.columns))


def shard_sync(source: DataFrame, synced: DataFrame, shards: int, cursor: int, batch: int) -> DataFrame:
    """vec_id, shard and action: the next batch to copy after the cursor, in the order of ids; what to move after a change of topology; what to delete.

    The greatest id copied is the next cursor; running the same step twice gives the same rows.
    """
    there = synced.select("vec_id", F.col("shard").alias("held"))
    wanted = source.select("vec_id", shard_of(F.col("vec_id").cast("string"), shards).alias("shard"))
    copy = wanted.where(F.col("vec_id") > cursor).join(there, "vec_id", "left_anti").orderBy("vec_id").limit(batch).withColumn("action", F.lit("copy"))
    move = wanted.join(there, "vec_id").where("held <> shard").select("vec_id", "shard", F.lit("move").alias("action"))
    gone = there.join(source.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.col("held").alias("shard"), F.lit("delete").alias("action"))
    return copy.unionByName(move).unionByName(gone)


def capped_counts(rows: DataFrame, label: str, most: int = 5000) -> DataFrame:
    """label and n; labels beyond the first `most`, by name, count together as overflow."""
    counts = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    own = F.broadcast(counts.select("label").orderBy("label").limit(most).withColumn("own", F.lit(True)))
    named = counts.join(own, "label", "left").select(F.when(F.col("own"), F.col("label")).otherwise("overflow").alias("label"), "n")
    return named.groupBy("label").agg(F.sum("n").alias("n"))


def exposition(counts: DataFrame, metric: str, label: str) -> DataFrame:
    """Lines of the text format, with labels escaped."""
    escaped = F.replace(F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return counts.select(F.concat(F.lit(f'{metric}{{{label}="'), escaped, F.lit('"} '), F.col("n").cast("string")).alias("line"))


def permitted(rows: DataFrame, grants: DataFrame, role: str, operation: str, column: str = "collection") -> DataFrame:
    """The rows that a role may put to an operation; grants: role, operations, collections, of which * means all."""
    own = grants.where((F.col("role") == role) & F.array_contains("operations", operation)).select(F.explode("collections").alias(column)).distinct()
    return rows if own.where(F.col(column) == "*").limit(1).count() else rows.join(own, column, "left_semi")


def tool_allowed(tool: Column, enabled: list[str] | None, disabled: list[str] | None) -> Column:
    """On the list of those enabled, if there is one, and not on that of those disabled."""
    yes = F.lit(True) if enabled is None else tool.isin(*enabled)
    return yes & ~(F.lit(False) if not disabled else tool.isin(*disabled))


def warnings(rows: DataFrame, by: str, rules: dict[str, Column]) -> DataFrame:
    """by and warnings: the names of the rules, aggregates each, that hold for a group, in their order."""
    said = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return rows.groupBy(by).agg(F.array_join(said, ",").alias("warnings"))


def feedback_rows(events: DataFrame) -> DataFrame:
    """scope, query_hash, result_id, satisfaction and source of feedback; a query is known by the digest of its trimmed lower case, unknown satisfactions are neutral."""
    known = F.when(F.col("satisfaction").isin("positive", "negative", "neutral"), F.col("satisfaction")).otherwise("neutral")
    return events.select("scope", F.sha2(F.lower(F.trim("query")), 256).alias("query_hash"), "result_id", known.alias("satisfaction"), F.coalesce("source", F.lit("explicit")).alias("source"))


def bulk(memories: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories after the operations, op_id and status): ops are op_id, op (put or delete), scope, key, value, folded in the order of op_id.

    One bad operation does not stop the others: blank keys, blank values of puts and unknown operations are
    invalid; a delete of what isn't there is not_found.
    """
    good = F.trim(F.coalesce("key", F.lit(""))) != ""
    valid = good & ((F.col("op") == "delete") | ((F.col("op") == "put") & (F.trim(F.coalesce("value", F.lit(""))) != "")))
    fine = ops.where(valid)
    there = memories.select("scope", "key", F.lit(True).alias("there")).distinct()
    order = Window.partitionBy("scope", "key").orderBy("op_id")
    before = F.coalesce(F.lag("op").over(order) == "put", F.coalesce("there", F.lit(False)))
    status = fine.join(there, ["scope", "key"], "left").withColumn("before", before)
    said = status.select("op_id", F.when(F.col("op") == "put", "stored").when(F.col("before"), "deleted").otherwise("not_found").alias("status"))
    last = fine.groupBy("scope", "key").agg(F.max_by(F.struct("op", "value"), "op_id").alias("l"))
    kept = memories.select("scope", "key", "value").join(last.select("scope", "key"), ["scope", "key"], "left_anti")
    after = kept.unionByName(last.where("l.op = 'put'").select("scope", "key", F.col("l.value").alias("value")))
    return after, said.unionByName(ops.where(~F.coalesce(valid, F.lit(False))).select("op_id", F.lit("invalid").alias("status")))


GRAPH = "nodes array<struct<id:string,label:string,community:string>>, links array<struct<source:string,target:string,relation:string,confidence:string>>"


def parsed_graph(json: Column) -> Column:
    """graph and error of a graph file: malformed JSON, a part that is missing, a node without id or a link without ends."""
    graph = F.from_json(json, GRAPH)
    bad_node = F.exists(graph["nodes"], lambda n: n["id"].isNull())
    bad_link = F.exists(graph["links"], lambda k: k["source"].isNull() | k["target"].isNull())
    error = F.when(graph.isNull() | (graph["nodes"].isNull() & graph["links"].isNull()), "malformed").when(graph["nodes"].isNull(), "no_nodes").when(graph["links"].isNull(), "no_links").when(bad_node, "node_without_id").when(bad_link, "link_without_ends")
    return F.struct(F.when(error.isNull(), graph).alias("graph"), error.alias("error"))


ITEM = "array<struct<type:string,text:string>>"


def expansion_payload(raw: Column) -> Column:
    """The typed lines in what a model answers: a bare array, one under a name, one in a code fence or one amid prose; null if there is none."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(raw)
    items = F.from_json(F.nullif(F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.lit("")), ITEM)
    good = F.filter(items, lambda x: x["type"].isin("lex", "vec", "hyde") & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""))
    return F.when(F.size(good) > 0, good)


def timeout_ms(asked: Column, profile: Column) -> Column:
    """The fast profile waits five seconds at most, the precise one fifteen at least."""
    return F.when(profile == "fast", F.least(asked, F.lit(5000))).when(profile == "max_precision", F.greatest(asked, F.lit(15000))).otherwise(asked)


def extraction_warning(extension: Column, size: Column, extractors: tuple[str, ...] = (), largest_image: int = 10 << 20) -> Column:
    """Why an image gives no text: it is beyond a size, or its extractor is not there."""
    image = extension.isin("png", "jpg", "jpeg", "gif", "webp")
    return F.when(image & (size > largest_image), "extractor_failed:image_too_large").when(image & F.lit("image" not in extractors), "extractor_failed:vision_model_unavailable")
