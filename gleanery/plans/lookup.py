"""Queries of filters, point lookups, context and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import lookup as ops
from gleanery.plans.catalog import DOCS, docs, query, table

W = f"WITH {DOCS}"


@query("filter_active", f"{W} SELECT doc_id FROM docs WHERE active")
def filter_active(spark, sf):
    return ops.active(docs(spark, sf)).select("doc_id")


@query("filter_collection", f"{W} SELECT doc_id FROM docs WHERE collection IN ('src1', 'src2')")
def filter_collection(spark, sf):
    return ops.in_collections(docs(spark, sf), ["src1", "src2"]).select("doc_id")


@query("default_collections", f"{W} SELECT DISTINCT collection FROM docs WHERE coalesce(CASE WHEN collection = 'src3' THEN false END, true)")
def default_collections(spark, sf):
    return ops.default_collections(docs(spark, sf).select("collection", F.when(F.col("collection") == "src3", False).alias("by_default")))


WANTED = "wanted AS (SELECT doc_id AS query_id, upper(substr(sha256(text), 1, 8)) AS wanted FROM documents)"


@query("docid_lookup", f"{W}, {WANTED} SELECT query_id, min(path) AS path FROM wanted JOIN docs ON active AND starts_with(hash, lower(wanted)) GROUP BY query_id")
def docid_lookup(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.upper(F.substring(F.sha2("text", 256), 1, 8)).alias("wanted"))
    return ops.by_docid(q, docs(spark, sf).where("active"))


NAMES = """names AS (SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN '#' || substr(sha256(text), 1, 6) WHEN 1 THEN source || '/' || lang || '/doc_' || doc_id || '.md' WHEN 2 THEN lang || '/doc_' || doc_id || '.md' ELSE 'doc_' || doc_id || '.md' END AS name FROM documents)"""


@query("doc_lookup", f"""{W}, {NAMES}, hits AS (SELECT query_id, 1 AS priority, path FROM names JOIN docs ON active AND starts_with(name, '#') AND substr(hash, 1, 6) = substr(name, 2) UNION ALL SELECT query_id, 2, path FROM names JOIN docs ON active AND name = collection || '/' || path
 UNION ALL SELECT query_id, 3, path FROM names JOIN docs ON active AND name = path UNION ALL SELECT query_id, 4, path FROM names JOIN docs ON active AND ends_with(path, '/' || name))
 SELECT query_id, min((priority, path))[1] AS priority, min((priority, path))[2] AS path FROM hits GROUP BY query_id""")
def doc_lookup(spark, sf):
    d = table(spark, sf, "documents")
    k, file = F.col("doc_id") % 4, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    name = F.when(k == 0, F.concat(F.lit("#"), F.substring(F.sha2("text", 256), 1, 6))).when(k == 1, F.concat_ws("/", "source", "lang", file)).when(k == 2, F.concat_ws("/", "lang", file)).otherwise(file)
    return ops.find(d.select(F.col("doc_id").alias("query_id"), name.alias("name")), docs(spark, sf).where("active"))


@query("doc_body_slice", f"{W} SELECT doc_id, array_to_string(string_split(body, chr(10))[2:4], chr(10)) AS text FROM docs")
def doc_body_slice(spark, sf):
    return docs(spark, sf).select("doc_id", ops.line_range(F.col("body"), 2, 3).alias("text"))


@query("multi_get", f"{W} SELECT doc_id, CASE WHEN length(body) > 10240 THEN 'File too large' END AS skipped, CASE WHEN length(body) <= 10240 THEN body END AS body FROM docs WHERE active AND regexp_matches(path, '^en/doc_1[^/]*\\.md$')")
def multi_get(spark, sf):
    d = docs(spark, sf).where("active").where(F.col("path").rlike(ops.glob_regex("en/doc_1*.md")))
    large = F.length("body") > 10240
    return d.select("doc_id", F.when(large, "File too large").alias("skipped"), F.when(~large, F.col("body")).alias("body"))


@query("glob_match", f"{W} SELECT doc_id FROM docs WHERE active AND (regexp_matches(path, '^(?:.*/)?doc_[^/][05]\\.md$') OR regexp_matches(collection || '/' || path, '^(?:.*/)?doc_[^/][05]\\.md$'))")
def glob_match(spark, sf):
    pattern = ops.glob_regex("**/doc_?[05].md")
    return docs(spark, sf).where("active").where(F.col("path").rlike(pattern) | F.concat_ws("/", "collection", "path").rlike(pattern)).select("doc_id")


@query("fuzzy_paths", f"{W}, q AS (SELECT doc_id AS query_id, replace(path, 'doc_', 'dox_') AS wanted FROM docs WHERE doc_id % 100 = 0), p AS (SELECT query_id, path, levenshtein(path, wanted) AS distance FROM q JOIN docs ON active AND abs(length(path) - length(wanted)) <= 3) SELECT query_id, path, distance FROM p WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, path) <= 5")
def fuzzy_paths(spark, sf):
    q = docs(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.replace("path", F.lit("doc_"), F.lit("dox_")).alias("wanted"))
    return ops.similar_paths(q, docs(spark, sf).where("active"), 3, 5)


@query("list_files", f"{W} SELECT doc_id, path, length(body) AS size, modified_at FROM docs WHERE active AND collection = 'src1' AND starts_with(path, 'en/')")
def list_files(spark, sf):
    return ops.listed_files(docs(spark, sf), "src1", "en/")


@query("vpath_parse", f"{W} SELECT doc_id, regexp_extract('doc://' || collection || '//' || path, '^[a-z]+://([^/]+)/*(.*)$', 1) AS collection, regexp_extract('doc://' || collection || '//' || path, '^[a-z]+://([^/]+)/*(.*)$', 2) AS path FROM docs")
def vpath_parse(spark, sf):
    v = ops.parse_virtual(tx.virtual_path("doc", F.col("collection"), F.concat(F.lit("/"), "path")))
    return docs(spark, sf).select("doc_id", v["collection"].alias("collection"), v["path"].alias("path"))


CTX = "ctx(collection, prefix, context) AS (VALUES (NULL, '', 'all'), ('src1', '', 'one'), ('src1', 'en', 'one en'), ('src1', 'en/doc_1', 'one en 1'), ('src2', 'fr/', 'two fr'))"


def _contexts(spark):
    return spark.createDataFrame([(None, "", "all"), ("src1", "", "one"), ("src1", "en", "one en"), ("src1", "en/doc_1", "one en 1"), ("src2", "fr/", "two fr")], "collection string, prefix string, context string")


@query("context_inherit", f"{W}, {CTX} SELECT doc_id, string_agg(context, chr(10) || chr(10) ORDER BY c.collection IS NOT NULL, length(prefix)) AS context FROM docs d JOIN ctx c ON (c.collection IS NULL OR c.collection = d.collection) AND starts_with(path, prefix) GROUP BY doc_id")
def context_inherit(spark, sf):
    return ops.inherited_context(docs(spark, sf).select("doc_id", "collection", "path"), _contexts(spark))


@query("join_prefix", f"{W}, {CTX} SELECT doc_id, count(*) AS contexts FROM docs d JOIN ctx c ON (c.collection IS NULL OR c.collection = d.collection) AND starts_with(path, prefix) GROUP BY doc_id")
def join_prefix(spark, sf):
    return ops.matching_contexts(docs(spark, sf).select("doc_id", "collection", "path"), _contexts(spark)).groupBy("doc_id").agg(F.count("*").alias("contexts"))


@query("context_best", f"{W}, {CTX} SELECT doc_id, context FROM docs d JOIN ctx c ON (c.collection IS NULL OR c.collection = d.collection) AND starts_with(path, prefix) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c.collection IS NOT NULL DESC, length(prefix) DESC) = 1")
def context_best(spark, sf):
    return ops.best_context(docs(spark, sf).select("doc_id", "collection", "path"), _contexts(spark))


@query("context_missing", f"{W}, {CTX} SELECT DISTINCT collection, string_split(path, '/')[1] AS folder FROM docs d WHERE NOT EXISTS (SELECT 1 FROM ctx c WHERE c.collection = d.collection AND (prefix = '' OR string_split(prefix, '/')[1] = string_split(d.path, '/')[1]))")
def context_missing(spark, sf):
    return ops.missing_context(docs(spark, sf).select("collection", "path"), _contexts(spark))


FOLDERS = "folders AS (SELECT collection, lang || '/' AS prefix, count(*) || ' files' AS context FROM docs GROUP BY ALL UNION ALL SELECT collection, '', 'all ' || count(*) FROM docs GROUP BY ALL UNION ALL SELECT NULL, '', 'everything')"


def _folders(spark, sf):
    """A context for each collection and each of its folders, and a global one."""
    d = docs(spark, sf)
    folders = d.groupBy("collection", F.concat("lang", F.lit("/")).alias("prefix")).agg(F.concat(F.count("*").cast("string"), F.lit(" files")).alias("context"))
    whole = d.groupBy("collection").agg(F.concat(F.lit("all "), F.count("*").cast("string")).alias("context")).select("collection", F.lit("").alias("prefix"), "context")
    return folders.unionByName(whole).unionByName(spark.createDataFrame([(None, "", "everything")], "collection string, prefix string, context string"))


@query("path_contexts_list", f"{W}, {FOLDERS} SELECT collection, prefix, context, row_number() OVER (ORDER BY collection, length(prefix) DESC, prefix) AS place FROM folders WHERE collection IS NOT NULL")
def path_contexts_list(spark, sf):
    return ops.listed_contexts(_folders(spark, sf))


@query("context_crud", f"""{W}, {FOLDERS} SELECT collection, prefix, CASE WHEN prefix = 'fr/' THEN 'new ' || context WHEN collection IS NULL THEN 'changed' ELSE context END AS context FROM folders WHERE prefix <> 'en/'
 UNION ALL SELECT collection, 'xx/', 'added' FROM folders WHERE collection IS NOT NULL AND prefix = ''""")
def context_crud(spark, sf):
    """Folders en lose their context, folders fr and the whole get other ones, and each collection a new one."""
    held = _folders(spark, sf)
    gone = held.where("prefix = 'en/'").select("collection", "prefix", F.lit(None).cast("string").alias("context"))
    other = held.where("prefix = 'fr/'").select("collection", "prefix", F.concat(F.lit("new "), "context").alias("context"))
    whole = held.where("collection is null").select("collection", "prefix", F.lit("changed").alias("context"))
    added = held.where("collection is not null and prefix = ''").select("collection", F.lit("xx/").alias("prefix"), F.lit("added").alias("context"))
    return ops.with_contexts(held, gone.unionByName(other).unionByName(whole).unionByName(added))


@query("collection_crud", f"{W} SELECT DISTINCT CASE collection WHEN 'src4' THEN 'renamed' ELSE collection END AS collection, regexp_matches(collection, '^[A-Za-z0-9][A-Za-z0-9_-]*$') AS valid FROM docs WHERE collection <> 'src5'")
def collection_crud(spark, sf):
    c = docs(spark, sf).select("collection").distinct().where("collection <> 'src5'")
    return c.select(F.when(F.col("collection") == "src4", "renamed").otherwise(F.col("collection")).alias("collection"), ops.valid_name(F.col("collection")).alias("valid"))


@query("index_crud", "SELECT 'idx_' || lang AS name, count(*) AS documents FROM documents WHERE lang <> 'es' GROUP BY lang")
def index_crud(spark, sf):
    return ops.index_list(table(spark, sf, "documents"), F.concat(F.lit("idx_"), "lang"), ("idx_es",))


@query("stale_detect", f"{W} SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM docs")
def stale_detect(spark, sf):
    d = docs(spark, sf).select("doc_id", (F.lit(1704067200) + F.col("doc_id") * 60).alias("mtime"))
    disk = d.where("doc_id % 13 <> 0").select("doc_id", (F.col("mtime") + F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)).alias("disk_mtime"))
    return ops.staleness(d, disk)


@query("line_diff")
def line_diff(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("body").alias("old"), F.concat(F.lit("first line\n"), F.regexp_replace("body", r"\n[^\n]*$", "")).alias("new"))
    return ops.line_diff(d, "doc_id")


@query("line_diff_counts", f"""{W}, o AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM docs), n AS (SELECT doc_id, unnest(string_split('first line' || chr(10) || body, chr(10))) AS line FROM docs),
 k AS (SELECT doc_id, line, sum(d) AS d FROM (SELECT doc_id, line, -1 AS d FROM o UNION ALL SELECT doc_id, line, 1 FROM n) GROUP BY ALL) SELECT doc_id, coalesce(sum(d) FILTER (d > 0), 0)::BIGINT AS added, coalesce(-sum(d) FILTER (d < 0), 0)::BIGINT AS deleted FROM k GROUP BY doc_id""")
def line_diff_counts(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("body").alias("old"), F.concat(F.lit("first line\n"), "body").alias("new"))
    return ops.line_changes(d, "doc_id")


@query("set_except", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t NOT IN ('the', 'and', 'of', 'to', '')))), ' ') AS terms FROM benchmark")
def set_except(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.without_words(F.col("text"), ("the", "and", "of", "to")).alias("terms"))


@query("set_symdiff", "WITH w AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) SELECT a.item_id, (len(a.w) + len(b.w) - 2 * len(list_intersect(a.w, b.w)))::INT AS distance FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def set_symdiff(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    b = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("x"))
    return w.join(b, "item_id").select("item_id", tx.set_distance(F.col("w"), F.col("x")).alias("distance"))
