"""Queries of ingest and content operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import content as ops
from gleanery.operators import lookup, status
from gleanery.plans.catalog import DOCS, EDGES, docs, edges, iso, iso_sql, query, table, vectors

W = f"WITH {DOCS}"
TITLE_SQL = """CASE WHEN regexp_extract(body, '(?m)^##?\\s+(.+)$', 1) <> '' THEN trim(regexp_extract(body, '(?m)^##?\\s+(.+)$', 1))
 ELSE list_extract(string_split(regexp_replace(path, '\\.[^.]+$', ''), '/'), -1) END"""


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query("docid", "SELECT doc_id, substr(sha256(text), 1, 6) AS docid FROM documents")
def docid(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.docid(tx.content_hash(F.col("text"))).alias("docid"))


@query("content_dedup", f"{W} SELECT hash, min(modified_at) AS created_at, any_value(body) AS doc FROM docs GROUP BY hash")
def content_dedup(spark, sf):
    return ops.dedup(docs(spark, sf).select("hash", F.col("modified_at").alias("created_at"), F.col("body").alias("doc")))


HEADED = "CASE doc_id % 4 WHEN 0 THEN '# Part ' || doc_id || chr(10) || text WHEN 1 THEN '## Notes' || chr(10) || '## Case ' || doc_id || chr(10) || text ELSE text END"


@query("extract_title", f"""WITH h AS (SELECT doc_id, lang || '/doc_' || doc_id || '.md' AS path, {HEADED} AS body FROM documents),
 t AS (SELECT *, trim(regexp_extract(body, '(?m)^##?\\s+(.+)$', 1)) AS a, trim(regexp_extract(body, '(?m)^##\\s+(.+)$', 1)) AS b FROM h)
 SELECT doc_id, CASE WHEN a IN ('Notes', '📝 Notes') AND b <> '' THEN b WHEN a <> '' THEN a ELSE 'doc_' || doc_id END AS title FROM t""")
def extract_title(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    number = F.col("doc_id").cast("string")
    body = F.when(k == 0, F.concat(F.lit("# Part "), number, F.lit("\n"), "text")).when(k == 1, F.concat(F.lit("## Notes\n## Case "), number, F.lit("\n"), "text")).otherwise(F.col("text"))
    path = F.concat("lang", F.lit("/doc_"), number, F.lit(".md"))
    return d.select("doc_id", tx.title(body, path).alias("title"))


@query("handelize", """WITH p AS (SELECT doc_id, 'My Notes___' || lang || '/Sub  Dir (' || source || ')/' || 'Été & Report_' || doc_id || '!.MD' AS path FROM documents),
 s AS (SELECT doc_id, string_split(lower(replace(path, '___', '/')), '/') AS l FROM p)
 SELECT doc_id, array_to_string(list_filter(list_concat(list_transform(l[:-2], lambda x: regexp_replace(regexp_replace(x, '[^\\p{L}\\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g')),
 [regexp_replace(regexp_replace(regexp_replace(l[-1], '\\.[a-z0-9]+$', ''), '[^\\p{L}\\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g') || regexp_extract(l[-1], '\\.[a-z0-9]+$')]), lambda x: x <> ''), '/') AS handle FROM s""")
def handelize(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("My Notes___"), "lang", F.lit("/Sub  Dir ("), "source", F.lit(")/Été & Report_"), F.col("doc_id").cast("string"), F.lit("!.MD"))
    return d.select("doc_id", tx.handelize(path).alias("handle"))


def _incoming(spark, sf):
    """What a later scan finds: every seventh file gone, every fifth changed, every eleventh retitled, and copies under a new folder."""
    d = docs(spark, sf)
    old = d.where("doc_id % 7 <> 3").select("collection", "path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("body", F.lit("+")), 256)).otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("New "), "path")).otherwise(F.col("path")).alias("title"), iso(F.lit(1735689600) + F.col("doc_id")).alias("modified_at"))
    new = d.where("doc_id % 50 = 1").select("collection", F.concat(F.lit("added/"), "path").alias("path"), "hash", F.col("path").alias("title"), iso(F.lit(1735689600) + F.col("doc_id")).alias("modified_at"))
    return old.unionByName(new)


INCOMING = f"""incoming AS (SELECT collection, path, CASE WHEN doc_id % 5 = 0 THEN sha256(body || '+') ELSE hash END AS hash, CASE WHEN doc_id % 11 = 0 THEN 'New ' || path ELSE path END AS title,
 {iso_sql("1735689600 + doc_id")} AS modified_at FROM docs WHERE doc_id % 7 <> 3 UNION ALL SELECT collection, 'added/' || path, hash, path, {iso_sql("1735689600 + doc_id")} FROM docs WHERE doc_id % 50 = 1)"""


def _now(spark, sf):
    return docs(spark, sf).withColumn("title", F.col("path"))


@query("change_detect", f"""{W}, {INCOMING}, old AS (SELECT collection, path, hash, path AS title FROM docs WHERE active)
 SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.path IS NULL THEN 'new' WHEN i.path IS NULL THEN 'removed' WHEN o.hash <> i.hash THEN 'updated' WHEN o.title <> i.title THEN 'title' ELSE 'unchanged' END AS status
 FROM old o FULL JOIN incoming i ON o.collection = i.collection AND o.path = i.path) GROUP BY status""")
def change_detect(spark, sf):
    return ops.changes(_now(spark, sf), _incoming(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("doc_upsert", f"""{W}, {INCOMING} SELECT coalesce(o.collection, i.collection) AS collection, coalesce(o.path, i.path) AS path, coalesce(i.hash, o.hash) AS hash, coalesce(i.title, o.path) AS title,
 coalesce(i.modified_at, o.modified_at) AS modified_at, i.path IS NOT NULL OR o.active AS active FROM docs o FULL JOIN incoming i ON o.collection = i.collection AND o.path = i.path""")
def doc_upsert(spark, sf):
    return ops.upsert(_now(spark, sf), _incoming(spark, sf))[0]


@query("doc_archive", f"{W}, {INCOMING} SELECT collection, path, o.hash, o.modified_at AS created_at FROM docs o JOIN incoming i USING (collection, path) WHERE o.hash <> i.hash")
def doc_archive(spark, sf):
    return ops.upsert(_now(spark, sf), _incoming(spark, sf))[1]


@query("doc_title_update", f"{W}, {INCOMING} SELECT collection, path, coalesce(i.title, o.path) AS title FROM docs o LEFT JOIN incoming i USING (collection, path)")
def doc_title_update(spark, sf):
    return ops.retitled(_now(spark, sf), _incoming(spark, sf)).select("collection", "path", "title")


@query("doc_deactivate", f"{W}, {INCOMING} SELECT doc_id, active AND EXISTS (SELECT 1 FROM incoming i WHERE i.collection = docs.collection AND i.path = docs.path) AS active FROM docs")
def doc_deactivate(spark, sf):
    return ops.deactivate(docs(spark, sf), _incoming(spark, sf)).select("doc_id", "active")


@query("ingest_diag", """SELECT user_id, event_type AS format, ts AS extracted_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def ingest_diag(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("format"), F.col("ts").alias("extracted_at"), "event_id")
    return ops.latest(rows, ["user_id", "format"], "extracted_at")


LINKED = "text || ' [n](./doc_' || (doc_id + 1) || '.md#top) [u](../README.md) [[Home Page]] [[Guide.md|g]] [x](https://e.com/a) [m](mailto:a@b.c) [e](../../../etc/passwd) ```' || chr(10) || '[c](code.md)' || chr(10) || '```'"


@query("links_extract", f"""WITH d AS (SELECT doc_id, lang || '/sub/doc_' || doc_id || '.md' AS path, {LINKED} AS body FROM documents),
 b AS (SELECT doc_id, path, regexp_replace(body, '(?s)```.*?```', '', 'g') AS body FROM d),
 t AS (SELECT doc_id, path, list_concat(regexp_extract_all(body, '\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1), list_transform(regexp_extract_all(body, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: CASE WHEN contains(x, '.') THEN x ELSE x || '.md' END)) AS l FROM b),
 f AS (SELECT doc_id, path, unnest(list_filter(list_transform(l, lambda x: string_split(x, '#')[1]), lambda x: NOT regexp_matches(x, '^[a-z]+://|^mailto:'))) AS t FROM t),
 n AS (SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace(path, '[^/]*$', '') || t, '/'), lambda s: [s])),
  lambda a, s: CASE WHEN s[1] IN ('', '.') THEN a WHEN s[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] ELSE list_concat(a, s) END) AS p FROM f)
 SELECT DISTINCT doc_id, array_to_string(list_transform(p, lambda s: regexp_replace(regexp_replace(regexp_replace(lower(s), '\\.md$', ''), '[^\\p{{L}}\\p{{N}}$]+', '-', 'g'), '^-+|-+$', '', 'g') || regexp_extract(lower(s), '\\.md$')), '/') AS target FROM n WHERE p[1] <> '..'""")
def links_extract(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    body = F.concat("text", F.lit(" [n](./doc_"), (n + 1).cast("string"), F.lit(".md#top) [u](../README.md) [[Home Page]] [[Guide.md|g]] [x](https://e.com/a) [m](mailto:a@b.c) [e](../../../etc/passwd) ```\n[c](code.md)\n```"))
    path = F.concat("lang", F.lit("/sub/doc_"), n.cast("string"), F.lit(".md"))
    return d.select("doc_id", F.explode(tx.internal_links(body, path)).alias("target"))


@query("links_replace", f"""{W}, {EDGES}, new AS (SELECT collection, path AS source_path, CASE WHEN doc_id % 2 = 0 THEN path || '.new' END AS target_path FROM docs WHERE doc_id % 3 = 0)
 SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.collection = e.collection AND n.source_path = e.source_path) UNION SELECT * FROM new WHERE target_path IS NOT NULL""")
def links_replace(spark, sf):
    new = docs(spark, sf).where("doc_id % 3 = 0").select("collection", F.col("path").alias("source_path"), F.when(F.col("doc_id") % 2 == 0, F.concat("path", F.lit(".new"))).alias("target_path"))
    return ops.replaced_links(edges(spark, sf), new)


@query("schema_store", "SELECT doc_id, source AS src_type, n_chars::VARCHAR AS n FROM documents")
def schema_store(spark, sf):
    body = F.concat(F.lit("Schema: src: "), "source", F.lit(", n: "), F.col("n_chars").cast("string"), F.lit("\nRows 1-2:\n"))
    m = tx.schema_map(body)
    return table(spark, sf, "documents").select("doc_id", m["src"].alias("src_type"), m["n"].alias("n"))


def _chunk_vectors(spark, sf):
    return docs(spark, sf).where("doc_id % 4 <> 1").select("hash", F.lit(0).alias("seq"), F.concat("hash", F.lit("_0")).alias("hash_seq")).distinct()


VECS = "vecs AS (SELECT DISTINCT hash, 0 AS seq, hash || '_0' AS hash_seq FROM docs WHERE doc_id % 4 <> 1)"
VERSIONS = f"versions AS (SELECT collection, path, sha256(body || k) AS hash, {iso_sql('1704067200 + doc_id * 60 - k * 3600')} AS created_at FROM docs, (VALUES (1), (2), (2 + 1)) v(k))"


def _versions(spark, sf):
    k = F.col("k")
    return docs(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("collection", "path", F.sha2(F.concat("body", k.cast("string")), 256).alias("hash"), iso(F.lit(1704067200) + F.col("doc_id") * 60 - k * 3600).alias("created_at"))


@query("orphan_content", f"{W}, {VERSIONS} SELECT DISTINCT hash FROM (SELECT sha256(body || '9') AS hash FROM docs UNION SELECT hash FROM docs UNION SELECT hash FROM versions) WHERE hash NOT IN (SELECT hash FROM docs) AND hash NOT IN (SELECT hash FROM versions)")
def orphan_content(spark, sf):
    d, v = docs(spark, sf), _versions(spark, sf)
    content = d.select(F.sha2(F.concat("body", F.lit("9")), 256).alias("hash")).union(d.select("hash")).union(v.select("hash")).distinct()
    return ops.orphans(content, d, v)


@query("orphan_vectors", f"{W}, {VECS} SELECT hash, seq FROM vecs WHERE hash NOT IN (SELECT hash FROM docs WHERE active)")
def orphan_vectors(spark, sf):
    return ops.orphan_vectors(_chunk_vectors(spark, sf), docs(spark, sf)).select("hash", "seq")


@query("inactive_delete", f"{W} SELECT doc_id, path FROM docs WHERE active")
def inactive_delete(spark, sf):
    return lookup.active(docs(spark, sf)).select("doc_id", "path")


@query("coll_rename", f"{W} SELECT doc_id, CASE collection WHEN 'src3' THEN 'renamed' ELSE collection END AS collection FROM docs")
def coll_rename(spark, sf):
    return ops.renamed(docs(spark, sf), "src3", "renamed").select("doc_id", "collection")


@query("vec_parity", f"""{W}, {VECS}, idx AS (SELECT DISTINCT hash || '_0' AS hash_seq FROM docs WHERE doc_id % 4 <> 2),
 b AS (SELECT v.hash_seq AS a, i.hash_seq AS b FROM vecs v FULL JOIN idx i USING (hash_seq))
 SELECT count(a) AS content_rows, count(b) AS index_rows, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra,
 sum(('0x' || substr(sha256(a), 1, 8))::BIGINT)::BIGINT AS content_fp, sum(('0x' || substr(sha256(b), 1, 8))::BIGINT)::BIGINT AS index_fp FROM b""")
def vec_parity(spark, sf):
    index = docs(spark, sf).where("doc_id % 4 <> 2").select(F.concat("hash", F.lit("_0")).alias("hash_seq")).distinct()
    return ops.vector_parity(_chunk_vectors(spark, sf), index)


@query("needs_embedding", f"{W}, {VECS} SELECT hash, min(path) AS path FROM docs WHERE active AND hash NOT IN (SELECT hash FROM vecs WHERE seq = 0) GROUP BY hash")
def needs_embedding(spark, sf):
    return ops.needs_embedding(docs(spark, sf), _chunk_vectors(spark, sf))


@query("embed_insert", "SELECT vec_id, max_by(label, (batch, label)) AS label, max(batch) AS batch FROM (SELECT vec_id, label, 0 AS batch FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0) GROUP BY vec_id")
def embed_insert(spark, sf):
    v = vectors(spark, sf).select("vec_id", "label", F.lit(0).alias("batch"))
    new = v.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).withColumn("batch", F.lit(1))
    return ops.latest(v.unionByName(new), ["vec_id"], "batch")


@query("embed_clear", "SELECT vec_id, label FROM embeddings WHERE false")
def embed_clear(spark, sf):
    return ops.cleared(vectors(spark, sf).select("vec_id", "label"))


@query("src_index_attach", f"""{W} SELECT collection, path, hash FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT collection, path, hash FROM docs s WHERE collection = 'src1' AND NOT EXISTS (SELECT 1 FROM docs t WHERE t.doc_id % 2 = 0 AND t.collection = s.collection AND t.path = s.path)""")
def src_index_attach(spark, sf):
    d = docs(spark, sf)
    return ops.attached(d.where("doc_id % 2 = 0").select("collection", "path", "hash"), d, ["src1"])


@query("win_versions", f"""{W}, {VERSIONS}, every AS (SELECT collection, path, hash, max(created_at) AS created_at FROM (SELECT * FROM versions UNION ALL SELECT collection, path, hash, modified_at FROM docs) GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY created_at DESC, hash) AS version FROM every""")
def win_versions(spark, sf):
    return ops.version_list(docs(spark, sf), _versions(spark, sf))


@query("doc_history", f"""{W}, {VERSIONS}, every AS (SELECT collection, path, hash, max(created_at) AS created_at FROM (SELECT * FROM versions UNION ALL SELECT collection, path, hash, modified_at FROM docs) GROUP BY ALL)
 SELECT collection, path, substr(hash, 1, 12) AS hash, created_at FROM every QUALIFY row_number() OVER (PARTITION BY collection, path ORDER BY created_at DESC, hash) <= 2""")
def doc_history(spark, sf):
    return ops.version_list(docs(spark, sf), _versions(spark, sf)).where("version <= 2").select("collection", "path", F.substring("hash", 1, 12).alias("hash"), "created_at")


@query("join_asof", f"""{W}, {VERSIONS}, wanted AS (SELECT collection, path, {iso_sql("1704067200 + doc_id * 60 - 5400 - (doc_id % 3) * 3600")} AS ts FROM docs)
 SELECT wanted.collection, wanted.path, ts, max_by(hash, created_at) FILTER (created_at <= ts) AS hash FROM wanted LEFT JOIN versions USING (collection, path) GROUP BY ALL""")
def join_asof(spark, sf):
    at = docs(spark, sf).select("collection", "path", iso(F.lit(1704067200) + F.col("doc_id") * 60 - 5400 - (F.col("doc_id") % 3) * 3600).alias("ts"))
    return ops.as_of(_versions(spark, sf), at)


@query("graph_expand", f"""{W}, {EDGES}, cand AS (SELECT doc_id % 5 AS query_id, collection, path FROM docs),
 near AS (SELECT query_id, e.collection, target_path AS path FROM cand c JOIN edges e ON c.collection = e.collection AND c.path = e.source_path UNION SELECT query_id, e.collection, source_path FROM cand c JOIN edges e ON c.collection = e.collection AND c.path = e.target_path)
 SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = n.query_id AND c.collection = n.collection AND c.path = n.path) AND EXISTS (SELECT 1 FROM docs d WHERE d.active AND d.collection = n.collection AND d.path = n.path)""")
def graph_expand(spark, sf):
    d = docs(spark, sf)
    candidates = d.select((F.col("doc_id") % 5).alias("query_id"), "collection", "path")
    return ops.neighbours(edges(spark, sf), candidates, d)


@query("backlinks", f"{W}, {EDGES} SELECT target_path AS path, count(*) AS n FROM edges GROUP BY target_path")
def backlinks(spark, sf):
    return ops.backlinks(edges(spark, sf))


@query("join_semi", f"{W}, {EDGES} SELECT doc_id FROM docs WHERE (collection, path) IN (SELECT (collection, source_path) FROM edges) OR (collection, path) IN (SELECT (collection, target_path) FROM edges)")
def join_semi(spark, sf):
    return ops.linked(docs(spark, sf), edges(spark, sf)).select("doc_id")


@query("join_exists_copy", f"{W} SELECT DISTINCT hash FROM docs d WHERE EXISTS (SELECT 1 FROM docs e WHERE e.hash = d.hash AND e.collection = 'src1')")
def join_exists_copy(spark, sf):
    return ops.copied_in(docs(spark, sf), "src1")


@query("join_doc_content", f"{W}, content AS (SELECT DISTINCT hash, length(body) AS n FROM docs) SELECT doc_id, n FROM docs JOIN content USING (hash) WHERE active")
def join_doc_content(spark, sf):
    d = docs(spark, sf)
    return ops.with_content(d.select("doc_id", "hash", "active"), d.select("hash", F.length("body").alias("n"))).select("doc_id", "n")


@query("join_vec_docs", f"{W}, {VECS} SELECT doc_id, hash_seq, length(body) AS n FROM vecs JOIN docs ON vecs.hash = docs.hash WHERE active")
def join_vec_docs(spark, sf):
    d = docs(spark, sf).select("doc_id", "hash", "active", F.length("body").alias("n"))
    return ops.vector_documents(_chunk_vectors(spark, sf), d).select("doc_id", "hash_seq", "n")


@query("join_left_ingest", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_ingest(spark, sf):
    return ops.with_ingest(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"))


@query("join_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(spark, sf):
    return ops.lacking(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"))


@query("set_union", f"{W}, {VERSIONS} SELECT hash FROM docs UNION SELECT hash FROM versions")
def set_union(spark, sf):
    return ops.known_hashes(docs(spark, sf), _versions(spark, sf))


@query("distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(spark, sf):
    return ops.facets(table(spark, sf, "documents"), ["lang", "source"])


@query("count_distinct", "SELECT count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents")
def count_distinct(spark, sf):
    return ops.cardinalities(table(spark, sf, "documents"), {"texts": "text", "langs": "lang"})


@query("group_concat_fp", f"{W} SELECT collection, sha256(string_agg(hash, ',' ORDER BY hash)) AS fp FROM docs WHERE active GROUP BY collection")
def group_concat_fp(spark, sf):
    return status.fingerprints(lookup.active(docs(spark, sf)))


@query("collection_fp_tree", f"""{W}, p AS (SELECT collection, hash[1:3] AS part, sha256(string_agg(hash, ',' ORDER BY hash)) AS fp FROM docs WHERE active GROUP BY ALL)
 SELECT collection, sha256(string_agg(fp, ',' ORDER BY part)) AS fp FROM p GROUP BY collection""")
def collection_fp_tree(spark, sf):
    """The fingerprint of collections of any size: by parts of their hashes."""
    return status.fingerprint_trees(lookup.active(docs(spark, sf)))


@query("agg_collection_stats", f"{W} SELECT collection, count(*) AS total, count(*) FILTER (active) AS active, max(modified_at) AS last_modified FROM docs GROUP BY collection")
def agg_collection_stats(spark, sf):
    return status.collection_stats(docs(spark, sf))


@query("agg_status", f"{W}, {VECS} SELECT collection, count(*) AS documents, max(modified_at) AS last_modified, count(*) FILTER (hash NOT IN (SELECT hash FROM vecs)) AS needs_embedding FROM docs WHERE active GROUP BY collection")
def agg_status(spark, sf):
    return status.status(docs(spark, sf), _chunk_vectors(spark, sf))


@query("agg_index_health", f"{W}, {VECS} SELECT count(DISTINCT hash) FILTER (hash NOT IN (SELECT hash FROM vecs)) AS needs_embedding, count(*) AS total, date_diff('day', max(modified_at)[:10]::DATE, DATE '2025-01-01') AS days_stale FROM docs WHERE active")
def agg_index_health(spark, sf):
    return status.index_health(docs(spark, sf), _chunk_vectors(spark, sf), F.lit("2025-01-01").cast("date"))


@query("agg_ingest_format", "SELECT event_type AS format, count(*) AS n FROM events GROUP BY event_type")
def agg_ingest_format(spark, sf):
    return status.counts(table(spark, sf, "events"), F.col("event_type"), "format")


def _warned():
    """A JSON array of warnings of each event."""
    return F.concat(F.lit('["'), "event_type", F.lit('_warn", "k'), (F.col("event_id") % 3).cast("string"), F.lit('", " "]'))


WARNINGS = """'["' || event_type || '_warn", "k' || (event_id % 3) || '", " "]'"""


@query("agg_ingest_warning", f"SELECT w AS warning, count(*) AS n FROM (SELECT trim(unnest(from_json({WARNINGS}, '[\"VARCHAR\"]'))) AS w FROM events) WHERE w <> '' GROUP BY w")
def agg_ingest_warning(spark, sf):
    return status.warning_counts(table(spark, sf, "events"), _warned())


@query("join_lateral_json", f"SELECT event_id, unnest(from_json({WARNINGS}, '[\"VARCHAR\"]')) AS warning FROM events")
def join_lateral_json(spark, sf):
    return status.listed(table(spark, sf, "events"), _warned(), "warning").select("event_id", "warning")


@query("strip_xml", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</(w:)?p>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS t FROM a)
 SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM b""")
def strip_xml(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_xml(F.col("html")).alias("text"))


@query("content_type", """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.PNG' WHEN 1 THEN 'b.csv' WHEN 2 THEN 'c.json' ELSE 'd.md' END AS path, CASE page_id % 3 WHEN 0 THEN 'Schema: a: t' || chr(10) || 'Rows 1-2' ELSE html END AS body FROM pages)
 SELECT page_id, CASE WHEN lower(string_split(path, '.')[-1]) = 'png' THEN 'image' WHEN path LIKE '%.csv' THEN 'csv' WHEN path LIKE '%.json' THEN 'json' WHEN contains(body, 'Schema:') AND contains(body, 'Rows ') THEN 'csv' WHEN contains(body, 'Schema:') AND contains(body, 'Items ') THEN 'json' ELSE 'text' END AS kind FROM p""")
def content_type(spark, sf):
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a.PNG").when(k == 1, "b.csv").when(k == 2, "c.json").otherwise("d.md")
    body = F.when(F.col("page_id") % 3 == 0, F.lit("Schema: a: t\nRows 1-2")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", tx.content_type(body, path).alias("kind"))


@query("schema_extract", "SELECT doc_id, 2 AS n_columns, lang AS first_type FROM documents")
def schema_extract(spark, sf):
    m = tx.schema_map(F.concat(F.lit("Schema: first: "), "lang", F.lit(", second: number, bad\nItems 1-3")))
    return table(spark, sf, "documents").select("doc_id", F.size(m).alias("n_columns"), m["first"].alias("first_type"))


@query("src_unsupported", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'extractor_unsupported_extension:.xyz' END AS warning, CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END AS text FROM documents""")
def src_unsupported(spark, sf):
    from gleanery.sources.files import dispatch

    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".xyz").otherwise(".md"))
    return dispatch(table(spark, sf, "documents").select("doc_id", path.alias("path"), "text")).select("doc_id", "warning", "text")


@query("src_csv", """WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
 SELECT ((rn - 1) // 100)::BIGINT AS block, 'Schema: doc_id: string, lang: string, n_chars: string' || chr(10) || 'Rows ' || min(rn) || '-' || max(rn) || ':' || chr(10) || string_agg('doc_id: ' || doc_id || ', lang: ' || lang || ', n_chars: ' || n_chars, chr(10) ORDER BY rn) AS body FROM r GROUP BY 1""")
def src_csv(spark, sf):
    from gleanery.sources.files import row_blocks

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "lang", F.col("n_chars").cast("string").alias("n_chars"))
    return row_blocks(rows, "row", ["doc_id", "lang", "n_chars"], 100, "Rows")


@query("src_json", """WITH r AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS rn FROM pages)
 SELECT ((rn - 1) // 50)::BIGINT AS block, 'Schema: page_id: string, url: string' || chr(10) || 'Items ' || min(rn) || '-' || max(rn) || ':' || chr(10) || string_agg('page_id: ' || page_id || ', url: ' || url, chr(10) ORDER BY rn) AS body FROM r GROUP BY 1""")
def src_json(spark, sf):
    from gleanery.sources.files import row_blocks

    rows = table(spark, sf, "pages").select(F.col("page_id").alias("row"), F.col("page_id").cast("string").alias("page_id"), "url")
    return row_blocks(rows, "row", ["page_id", "url"], 50, "Items")


# a third of the documents each: a list, a property that is a list, one object; lines of the text are the items
JSON_FILES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), i AS (SELECT doc_id, list_transform(l, lambda x, i: '{"n":' || i || ',"line":' || to_json(x) || ',"even":' || (i % 2 = 0) || '}') AS items FROM l WHERE doc_id % 3 < 2
 UNION ALL SELECT doc_id, ['{"id":' || doc_id || ',"source":' || to_json(source) || ',"lines":{"first":1}}'] FROM documents WHERE doc_id % 3 = 2),
 b AS (SELECT doc_id, items, unnest(range(0, len(items), 50)) AS first, CASE WHEN doc_id % 3 < 2 THEN 'n: number, line: string, even: boolean' ELSE 'id: number, source: string, lines: object' END AS types FROM i)
 SELECT doc_id, (first // 50)::INT AS block, 'Schema: ' || types || chr(10) || 'Items ' || (first + 1) || '-' || least(first + 50, len(items)) || ':' || chr(10) || array_to_string(items[first + 1:first + 50], chr(10)) AS body FROM b"""


@query("src_json_files", f"WITH {JSON_FILES}")
def src_json_files(spark, sf):
    from gleanery.sources.files import json_blocks

    third = F.col("doc_id") % 3
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"), (i % 2 == 1).alias("even")))
    one = F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.struct(F.lit(1).alias("first")).alias("lines"))
    within = F.struct(F.lit("[1]").alias("name"), F.struct(F.lit(2).alias("x")).alias("about"), lines.alias("rows"), F.array(F.lit(1)).alias("more"))
    text = F.when(third == 0, F.to_json(lines)).when(third == 1, F.to_json(within)).otherwise(F.to_json(one))
    return json_blocks(table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", "block", "body")


@query("src_ndjson_training", "SELECT conv_id, turn, 'lex' AS kind, text AS value FROM conversations WHERE turn = 0 AND length(trim(text)) > 0")
def src_ndjson_training(spark, sf):
    from gleanery.sources.files import training_rows

    rows = table(spark, sf, "conversations").where("turn = 0").select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("query"), F.array(F.array(F.lit("lex"), "text")).alias("output"))).alias("line"))
    return training_rows(rows, "line", ["conv_id", "turn"]).select("conv_id", "turn", F.explode("output").alias("o")).select("conv_id", "turn", F.col("o.kind").alias("kind"), F.col("o.value").alias("value"))


@query("src_chroma", "SELECT e.vec_id, 'c' || e.label AS collection, d.text AS document, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def src_chroma(spark, sf):
    from gleanery.sources.files import from_vector_store

    e = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"))
    d = table(spark, sf, "documents")
    texts = d.select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    meta = d.select(F.col("doc_id").alias("id"), F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("key", "value"))
    return from_vector_store(e, texts, meta, ["lang", "source"]).select(F.col("id").alias("vec_id"), "collection", "document", "lang", "source")
