"""Queries of maintenance, policies and tolerant parsing; fixtures are made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import maintenance as ops
from gleanery.operators import shards
from gleanery.plans.catalog import DOCS, EDGES, docs, edges, query, table
from gleanery.plans.content import VECS, _chunk_vectors
from gleanery.plans.fusion import FUSED, _fused
from gleanery.plans.memory import MEM, _mem
from gleanery.sources import files, sinks
from gleanery.sources.tables import folder

W = f"WITH {DOCS}"


def _tables(spark, sf):
    d = docs(spark, sf)
    return {"documents": d, "content": d.select("hash", "body").dropDuplicates(["hash"]), "vectors": _chunk_vectors(spark, sf), "links": edges(spark, sf)}


@query("coll_remove", f"""{W}, {VECS}, {EDGES}, kept AS (SELECT * FROM docs WHERE collection <> 'src3') SELECT 'documents' AS tbl, count(*) AS rows FROM kept UNION ALL SELECT 'content', count(DISTINCT hash) FROM kept
 UNION ALL SELECT 'vectors', count(*) FROM vecs WHERE hash IN (SELECT hash FROM kept) UNION ALL SELECT 'links', count(*) FROM edges WHERE collection <> 'src3'""")
def coll_remove(spark, sf):
    return ops.sizes(ops.remove_collection(_tables(spark, sf), "src3"))


@query("cleanup", f"""{W}, {VECS}, kept AS (SELECT * FROM docs WHERE active) SELECT 'documents' AS tbl, count(*) AS rows FROM kept UNION ALL SELECT 'content', count(DISTINCT hash) FROM kept
 UNION ALL SELECT 'vectors', count(*) FROM vecs WHERE hash IN (SELECT hash FROM kept) UNION ALL SELECT 'cache', count(*) FILTER (event_id % 3 <> 0 OR value > 50) FROM events""")
def cleanup(spark, sf):
    cache = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("expires_at"))
    return ops.sizes(ops.cleaned(_tables(spark, sf) | {"cache": cache}, F.lit(50.0)))


@query("health", f"""{W}, {VECS}, v AS (SELECT hash FROM vecs UNION ALL SELECT 'none') SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE active) AS active,
 (SELECT count(DISTINCT hash) FROM docs WHERE active AND hash NOT IN (SELECT hash FROM v)) AS pending, (SELECT count(DISTINCT hash) FROM v WHERE hash NOT IN (SELECT hash FROM docs)) AS orphans, 'inconsistent' AS state""")
def health(spark, sf):
    v = _chunk_vectors(spark, sf).select("hash")
    return ops.health(docs(spark, sf), v.unionByName(spark.createDataFrame([("none",)], "hash string")))


@query("cache_evict", "SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= CASE WHEN (SELECT count(*) FROM events) > 1500 THEN 1000 ELSE 1500 END")
def cache_evict(spark, sf):
    return ops.evicted(table(spark, sf, "events"), "ts", "event_id").select("event_id")


@query("st_lru", "SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY max(ts) DESC, user_id) <= 8")
def st_lru(spark, sf):
    return ops.least_recently_used(table(spark, sf, "events"), "event_type", "user_id", "ts", 8)


DISK = "known AS (SELECT doc_id AS path, doc_id AS mtime FROM documents WHERE doc_id % 7 <> 1), disk AS (SELECT doc_id AS path, doc_id + CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 0 END AS mtime FROM documents WHERE doc_id % 11 <> 2)"


@query("st_reconcile", f"WITH {DISK} SELECT path, CASE WHEN k.mtime IS NULL THEN 'add' WHEN d.mtime IS NULL THEN 'unlink' ELSE 'change' END AS type FROM known k FULL JOIN disk d USING (path) WHERE k.mtime IS NULL OR d.mtime IS NULL OR d.mtime > k.mtime")
def st_reconcile(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    known = d.where("path % 7 <> 1").withColumn("mtime", F.col("path"))
    return ops.reconciled(known, d.where("path % 11 <> 2").withColumn("mtime", F.col("path") + F.when(F.col("path") % 5 == 0, 9).otherwise(0)))


@query("ingest_single", f"""{W}, e AS (SELECT path, hash || '+' AS hash, event_id AS seq, CASE event_type WHEN 'error' THEN 'unlink' ELSE 'change' END AS type FROM events JOIN docs ON doc_id = event_id // 4),
 l AS (SELECT path, hash, type FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) SELECT path, hash FROM docs WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT path, hash FROM l WHERE type <> 'unlink'""")
def ingest_single(spark, sf):
    d = docs(spark, sf)
    e = table(spark, sf, "events").withColumn("doc_id", F.floor(F.col("event_id") / 4)).join(d, "doc_id")
    kind = F.when(F.col("event_type") == "error", "unlink").otherwise("change")
    return ops.applied(d.select("path", "hash"), e.select("path", F.concat("hash", F.lit("+")).alias("hash"), F.col("event_id").alias("seq"), kind.alias("type")))


SHARD = "('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % 4"


@query("shard_sync", f"""WITH s AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 9 ELSE {SHARD} END AS shard FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT -5, 2)
 SELECT vec_id, shard, 'copy' AS action FROM (SELECT vec_id, {SHARD} AS shard FROM embeddings WHERE vec_id > 100 AND vec_id NOT IN (SELECT vec_id FROM s) ORDER BY vec_id LIMIT 64)
 UNION ALL SELECT e.vec_id, ('0x' || substr(sha256(e.vec_id::VARCHAR), 1, 8))::BIGINT % 4, 'move' FROM embeddings e JOIN s USING (vec_id) WHERE s.shard <> ('0x' || substr(sha256(e.vec_id::VARCHAR), 1, 8))::BIGINT % 4 UNION ALL SELECT -5, 2, 'delete'""")
def shard_sync(spark, sf):
    from gleanery.operators.vectors import shard_of

    v = table(spark, sf, "embeddings").select("vec_id")
    own = shard_of(F.col("vec_id").cast("string"), 4)
    held = v.where("vec_id % 3 <> 0").select("vec_id", F.when(F.col("vec_id") % 10 == 0, 9).otherwise(own).alias("shard"))
    return ops.shard_sync(v, held.unionByName(spark.createDataFrame([(-5, 2)], "vec_id bigint, shard bigint")), 4, 100, 64)


@query("shard_sync_kept", f"SELECT vec_id, ({SHARD})::INT AS shard FROM embeddings")
def shard_sync_kept(spark, sf):
    """Vectors copied to written shards by a run that ends after its first batch and one that goes on behind its cursor."""
    v, root = table(spark, sf, "embeddings").select("vec_id", "embedding"), folder(spark, "sync")
    shards.sync(v, root, 4, 10_000, stop_after=1)
    shards.sync(v, root, 4, 10_000)
    return shards.held(spark, root, v.schema).select("vec_id", "shard")


@query("st_checkpoint", f"SELECT ({SHARD})::INT AS shard, count(*) AS source_rows, count(*) AS shard_rows, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS misplaced, true AS equal FROM embeddings GROUP BY 1")
def st_checkpoint(spark, sf):
    """Parity of shards after a change of their number in the middle of a copy."""
    v, root = table(spark, sf, "embeddings").select("vec_id", "embedding"), folder(spark, "sync")
    shards.sync(v, root, 7, 10_000, stop_after=1)
    shards.sync(v, root, 4, 10_000)
    return shards.parity(v, shards.held(spark, root, v.schema), 4)


@query("sink_prometheus", """WITH n AS (SELECT user_id::VARCHAR AS label, count(*) AS n FROM events GROUP BY 1), r AS (SELECT CASE WHEN row_number() OVER (ORDER BY label) <= 10 THEN label ELSE 'overflow' END AS label, n FROM n)
 SELECT 'events_total{user="' || label || '"} ' || sum(n) AS line FROM r GROUP BY label""")
def sink_prometheus(spark, sf):
    return ops.exposition(ops.capped_counts(table(spark, sf, "events"), "user_id", 10), "events_total", "user")


@query("rbac_filter", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def rbac_filter(spark, sf):
    grants = spark.createDataFrame([("reader", ["query", "get"], ["src1", "src2"]), ("reader", ["delete"], ["src9"]), ("admin", ["query"], ["*"])], "role string, operations array<string>, collections array<string>")
    return ops.permitted(table(spark, sf, "documents").withColumnRenamed("source", "collection"), grants, "reader", "query").select("doc_id")


@query("tool_policy", "SELECT event_id, event_type IN ('click', 'view') AND event_type <> 'view' AS allowed FROM events")
def tool_policy(spark, sf):
    return table(spark, sf, "events").select("event_id", ops.tool_allowed(F.col("event_type"), ["click", "view"], ["view"]).alias("allowed"))


@query("op_status", "SELECT user_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (event_type = 'error') > 5 THEN 'errors' END, CASE WHEN max(value) > 300 THEN 'slow' END, CASE WHEN count(*) < 50 THEN 'idle' END], lambda x: x IS NOT NULL), ',') AS warnings FROM events GROUP BY user_id")
def op_status(spark, sf):
    return ops.warnings(table(spark, sf, "events"), "user_id", {"errors": F.count_if(F.col("event_type") == "error") > 5, "slow": F.max("value") > 300, "idle": F.count("*") < 50})


@query("mem_feedback", "SELECT 's' || conv_id % 20 AS scope, sha256(lower(trim(text))) AS query_hash, turn AS result_id, CASE role WHEN 'user' THEN 'positive' ELSE 'neutral' END AS satisfaction, 'explicit' AS source FROM conversations")
def mem_feedback(spark, sf):
    said = F.when(F.col("role") == "user", "positive").otherwise("whatever")
    c = table(spark, sf, "conversations").select(F.concat(F.lit("s"), (F.col("conv_id") % 20).cast("string")).alias("scope"), F.col("text").alias("query"), F.col("turn").alias("result_id"), said.alias("satisfaction"), F.lit(None).cast("string").alias("source"))
    return ops.feedback_rows(c)


OPS = f"""{MEM}, store AS (SELECT DISTINCT scope, key FROM mem WHERE id % 2 = 0), o AS (SELECT id AS op_id, CASE id % 5 WHEN 1 THEN 'delete' WHEN 4 THEN 'drop' ELSE 'put' END AS op, scope, key || id % 7 AS key, CASE WHEN id % 11 = 0 THEN ' ' ELSE value END AS value FROM mem),
 held AS (SELECT scope, key || i AS key FROM store, range(3) r(i)), f AS (SELECT * FROM o WHERE op = 'delete' OR op = 'put' AND trim(value) <> ''),
 s AS (SELECT op_id, CASE WHEN op = 'put' THEN 'stored' WHEN coalesce(lag(op) OVER (PARTITION BY scope, key ORDER BY op_id) = 'put', h.key IS NOT NULL) THEN 'deleted' ELSE 'not_found' END AS status FROM f LEFT JOIN (SELECT scope, key FROM held) h USING (scope, key))"""


@query("mem_bulk", f"WITH {OPS} SELECT op_id, status FROM s UNION ALL SELECT op_id, 'invalid' FROM o WHERE op_id NOT IN (SELECT op_id FROM f)")
def mem_bulk(spark, sf):
    m, k = _mem(spark, sf), F.col("id")
    store = m.where("id % 2 = 0").select("scope", "key").distinct().select("scope", F.explode(F.array(*[F.concat("key", F.lit(str(i))) for i in range(3)])).alias("key"), F.lit("v").alias("value"))
    op = F.when(k % 5 == 1, "delete").when(k % 5 == 4, "drop").otherwise("put")
    return ops.bulk(store, m.select(k.alias("op_id"), op.alias("op"), "scope", F.concat("key", (k % 7).cast("string")).alias("key"), F.when(k % 11 == 0, " ").otherwise(F.col("value")).alias("value")))[1]


@query("graph_parse", f"""{W}, {EDGES}, l AS (SELECT collection, source_path, count(*) AS links FROM edges GROUP BY ALL)
 SELECT doc_id, CASE WHEN ok THEN 1 + coalesce(links, 0) END AS nodes, CASE WHEN ok THEN coalesce(links, 0) END AS links, CASE WHEN NOT ok THEN 'malformed' END AS error
 FROM (SELECT docs.doc_id, links, docs.collection <> 'src1' AS ok FROM docs LEFT JOIN l ON l.collection = docs.collection AND source_path = path)""")
def graph_parse(spark, sf):
    """A graph file for each document, of itself and what it links to; those of one collection are damaged."""
    links = edges(spark, sf).groupBy("collection", F.col("source_path").alias("path")).agg(F.collect_list(F.struct(F.col("source_path").alias("source"), F.col("target_path").alias("target"))).alias("links"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    graphs = docs(spark, sf).select("doc_id", "collection", "path").join(links, ["collection", "path"], "left").withColumn("links", F.coalesce("links", none))
    nodes = F.transform(F.array_insert(F.transform("links", lambda x: x["target"]), 1, F.col("path")), lambda p: F.struct(p.alias("id")))
    text = F.to_json(F.struct(nodes.alias("nodes"), "links"))
    parsed = graphs.select("doc_id", ops.parsed_graph(F.when(F.col("collection") == "src1", F.concat(F.lit("oops"), text)).otherwise(text)).alias("g"))
    good = F.col("g.error").isNull()
    return parsed.select("doc_id", F.when(good, F.size("g.graph.nodes")).cast("bigint").alias("nodes"), F.when(good, F.size("g.graph.links")).cast("bigint").alias("links"), F.col("g.error").alias("error"))


@query("expand_payload", "SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN NULL ELSE 2::INT END AS lines, CASE turn % 5 WHEN 4 THEN NULL ELSE text END AS first FROM conversations WHERE trim(text) <> ''")
def expand_payload(spark, sf):
    c = table(spark, sf, "conversations").where(F.trim("text") != "")
    two = F.to_json(F.array(F.struct(F.lit("lex").alias("type"), "text"), F.struct(F.lit("none").alias("type"), "text"), F.struct(F.lit("vec").alias("type"), F.lit("v").alias("text"))))
    k = F.col("turn") % 5
    raw = F.when(k == 0, two).when(k == 1, F.concat(F.lit('{"queries": '), two, F.lit("}"))).when(k == 2, F.concat(F.lit("Here:\n```json\n"), two, F.lit("\n```\nDone"))).when(k == 3, F.concat(F.lit("The lines are "), two, F.lit(" as asked"))).otherwise("no lines at all")
    return c.select("conv_id", "turn", ops.expansion_payload(raw).alias("p")).select("conv_id", "turn", F.when(F.col("p").isNotNull(), F.size("p")).alias("lines"), F.col("p")[0]["text"].alias("first"))


@query("timeout_profile", "SELECT event_id, CASE event_type WHEN 'click' THEN least(event_id * 10, 5000) WHEN 'view' THEN greatest(event_id * 10, 15000) ELSE event_id * 10 END AS ms FROM events")
def timeout_profile(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select("event_id", ops.timeout_ms(F.col("event_id") * 10, F.when(t == "click", "fast").when(t == "view", "max_precision").otherwise("balanced")).alias("ms"))


PDF = r"regexp_replace(array_to_string(regexp_extract_all(replace(coalesce(text, ''), ' ', chr(1)), '[\t\x20-\x7E]{4,}'), chr(10)), '^\s+|\s+$', '', 'g')"


@query("src_pdf", f"""WITH d AS (SELECT doc_id, {PDF} AS strings, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS whole FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND whole <> '' THEN whole ELSE strings END AS text, CASE WHEN doc_id % 3 = 1 AND whole <> '' THEN 'extractor' WHEN strings <> '' THEN 'strings_fallback' ELSE 'unavailable' END AS extractor,
 CASE WHEN doc_id % 3 = 1 AND whole <> '' THEN '' WHEN strings <> '' THEN 'extractor_degraded:pdf_strings_fallback' ELSE 'extractor_failed:pdf_no_output' END AS warnings FROM d""")
def src_pdf(spark, sf):
    """Every text as bytes whose blanks are unprintable; an extractor has read a third of them."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("relative_path"), F.encode(F.translate("text", " ", "\x01"), "UTF-8").alias("content"), "text")
    found = files.read_pdf(d, extracted=F.when(F.col("relative_path") % 3 == 1, F.col("text")))
    return found.select(F.col("relative_path").alias("doc_id"), "text", "extractor", F.array_join("warnings", ",").alias("warnings"))


@query("src_image", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN n_chars > 1000 THEN 'extractor_failed:image_too_large' ELSE 'extractor_failed:vision_model_unavailable' END END AS warning FROM documents")
def src_image(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.extraction_warning(F.when(F.col("doc_id") % 3 == 0, "png").otherwise("md"), F.col("n_chars"), largest_image=1000).alias("warning"))


@query("sink_backup", f"{W} SELECT count(*) AS rows, true AS verified, count(DISTINCT hash) AS contents FROM docs")
def sink_backup(spark, sf):
    """A snapshot is written, verified and restored; what comes back is counted."""
    path = folder(spark, "backup")
    sinks.backup(docs(spark, sf), path)
    restored = sinks.restore(spark, path)
    return restored.agg(F.count("*").alias("rows"), F.lit(sinks.intact(spark, path)).alias("verified"), F.count_distinct("hash").alias("contents"))


@query("sink_replay", f"""WITH {FUSED} SELECT query_id, '{{"query_id":' || query_id || ',"results":' || count(*) || ',"files":["' || string_agg(file, '","' ORDER BY rank) || '"]}}' AS trace FROM rrf WHERE rank <= 5 GROUP BY query_id""")
def sink_replay(spark, sf):
    """The trace of each query's fused results is written as JSON and read back."""
    path = folder(spark, "replay")
    sinks.replay(_fused(spark, sf).where("rank <= 5"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.query_id").cast("bigint").alias("query_id"), F.col("value").alias("trace"))
