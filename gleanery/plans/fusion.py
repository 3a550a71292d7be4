"""Queries of fusion and post-processing. Every benchmark item is a query; its three ranked lists are dealt, by digests, from all documents whose id ends in the same digit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import chunking, status
from gleanery.operators import content as cops
from gleanery.operators import fusion as ops
from gleanery.plans.catalog import DOCS, EDGES, docs, edges, query, table

RANKED = f"""{DOCS}, dealt AS (SELECT q.q AS query_id, l.l::INT AS list_idx, path AS file, doc_id, md5(q.q || ':' || l.l || ':' || doc_id) AS key FROM docs JOIN (SELECT item_id AS q FROM benchmark) q ON doc_id % 10 = q.q % 10, range(3) l(l)),
ranked AS (SELECT query_id, list_idx, file, doc_id, row_number() OVER (PARTITION BY query_id, list_idx ORDER BY key)::INT AS rank FROM dealt QUALIFY rank <= 25),
weights AS (SELECT query_id, list_idx, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY list_idx) <= 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT DISTINCT query_id, list_idx FROM ranked))"""
FUSED = f"""{RANKED}, fused AS (SELECT query_id, file, any_value(doc_id) AS doc_id, sum(weight / (60 + rank)) AS base, min(rank) AS best, min((list_idx, rank)) AS seen FROM ranked JOIN weights USING (query_id, list_idx) GROUP BY query_id, file),
scored AS (SELECT query_id, file, doc_id, round(base + CASE WHEN best = 1 THEN 0.05::DOUBLE WHEN best <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END, 9) AS score, seen FROM fused),
rrf AS (SELECT query_id, file, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM scored)"""


def _ranked(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("path").alias("file"), (F.col("doc_id") % 10).alias("tenth"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("tenth"))
    dealt = d.join(asked, "tenth").withColumn("list_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("list_idx").cast("string"), F.col("doc_id").cast("string")))
    return ops.ranked_lists(dealt, key, 25)


def _fused(spark, sf):
    lists = _ranked(spark, sf)
    return ops.rrf(lists, ops.list_weights(lists, 2))


@query("rrf", f"WITH {FUSED} SELECT query_id, file, score, rank FROM rrf")
def rrf(spark, sf):
    return _fused(spark, sf)


@query("rrf_trace", f"""WITH {RANKED} SELECT query_id, file, count(*) AS lists, round(sum(weight / (60 + rank)), 9) AS base, CASE WHEN min(rank) = 1 THEN 0.05::DOUBLE WHEN min(rank) <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END AS bonus,
 string_agg(list_idx || ':' || rank, ',' ORDER BY list_idx) AS trace FROM ranked JOIN weights USING (query_id, list_idx) GROUP BY ALL""")
def rrf_trace(spark, sf):
    lists = _ranked(spark, sf)
    t = ops.rrf_trace(lists, ops.list_weights(lists, 2))
    said = F.array_join(F.transform("contributions", lambda c: F.concat_ws(":", c["list_idx"].cast("string"), c["rank"].cast("string"))), ",")
    return t.select("query_id", "file", F.size("contributions").cast("bigint").alias("lists"), "base", "bonus", said.alias("trace"))


@query("list_weights", f"WITH {RANKED} SELECT * FROM weights")
def list_weights(spark, sf):
    return ops.list_weights(_ranked(spark, sf), 2)


@query("win_list_rank", f"WITH {RANKED} SELECT query_id, list_idx, file, rank FROM ranked")
def win_list_rank(spark, sf):
    return _ranked(spark, sf).select("query_id", "list_idx", "file", "rank")


@query("candidate_limit", f"WITH {FUSED} SELECT query_id, file, rank FROM rrf WHERE rank <= 20")
def candidate_limit(spark, sf):
    return ops.top(_fused(spark, sf), 20).select("query_id", "file", "rank")


def _blended(spark, sf):
    number = F.regexp_extract("file", r"doc_(\d+)", 1).cast("bigint")
    f = ops.top(_fused(spark, sf), 20)
    return f.withColumn("score", F.round(ops.blend(F.col("rank"), (number % 17) / 17.0), 6))


BLENDED = f"""{FUSED}, blended AS (SELECT query_id, file, rank, round(w * greatest(0.01::DOUBLE, exp(-(rank - 1) / 5.5::DOUBLE)) + (1 - w) * (doc_id % 17) / 17.0::DOUBLE, 6) AS score
 FROM (SELECT *, CASE WHEN rank <= 3 THEN 0.75::DOUBLE WHEN rank <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM rrf WHERE rank <= 20))"""


@query("blend", f"WITH {BLENDED} SELECT query_id, file, score FROM blended")
def blend(spark, sf):
    return _blended(spark, sf).select("query_id", "file", "score")


@query("final_topk", f"WITH {BLENDED} SELECT query_id, file, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS place FROM blended WHERE score >= 0.3 QUALIFY place <= 5")
def final_topk(spark, sf):
    return ops.final(_blended(spark, sf), 0.3, 5)


@query("min_score", f"WITH {BLENDED} SELECT query_id, count(*) AS n FROM blended WHERE score >= 0.5 GROUP BY query_id")
def min_score(spark, sf):
    return _blended(spark, sf).where("score >= 0.5").groupBy("query_id").agg(F.count("*").alias("n"))


@query("graph_candidates", f"""WITH {FUSED}, {EDGES}, c AS (SELECT r.query_id, d.collection, r.file FROM rrf r JOIN docs d ON d.path = r.file WHERE r.rank <= 20),
 near AS (SELECT query_id, target_path AS file FROM c JOIN edges e ON e.collection = c.collection AND e.source_path = c.file UNION SELECT query_id, source_path FROM c JOIN edges e ON e.collection = c.collection AND e.target_path = c.file),
 fresh AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = n.query_id AND c.file = n.file) AND EXISTS (SELECT 1 FROM docs WHERE active AND path = n.file))
 SELECT query_id, file, score, rank FROM rrf WHERE rank <= 20 UNION ALL SELECT query_id, file, 0.1::DOUBLE, 20 + row_number() OVER (PARTITION BY query_id ORDER BY file) FROM fresh""")
def graph_candidates(spark, sf):
    d = docs(spark, sf)
    ranked = ops.top(_fused(spark, sf), 20)
    seeds = ranked.join(d.select("collection", F.col("path").alias("file")), "file").select("query_id", "collection", F.col("file").alias("path"))
    near = cops.neighbours(edges(spark, sf), seeds, d).select("query_id", F.col("path").alias("file"))
    return ops.with_neighbours(ranked, near)


def _chunks(spark, sf, size=400, step=300):
    d = docs(spark, sf).select("doc_id", F.col("path").alias("file"), "body")
    return chunking.fixed(d, "body", size, step)


CHUNKS = "chunks AS (SELECT doc_id, path AS file, (unnest(range(0, greatest(length(body), 1), 300)) // 300)::INT AS seq, body FROM docs), cut AS (SELECT doc_id, file, seq, seq * 300 AS pos, substr(body, seq * 300 + 1, 400) AS text FROM chunks)"


@query("chunk_fixed", f"WITH {DOCS}, {CHUNKS} SELECT doc_id, seq, pos, text FROM cut")
def chunk_fixed(spark, sf):
    return _chunks(spark, sf).select("doc_id", "seq", "pos", "text")


ITEMS10 = "items AS (SELECT item_id AS query_id, text FROM benchmark), terms AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: length(t) > 2)) AS terms FROM items)"


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("best_chunk", f"WITH {FUSED}, {CHUNKS}, {ITEMS10}, o AS (SELECT r.query_id, r.file, seq, len(list_filter(terms, lambda t: contains(lower(text), t)))::INT AS overlap FROM rrf r JOIN terms USING (query_id) JOIN cut ON cut.file = r.file WHERE rank <= 10) SELECT query_id, file, seq, overlap FROM o QUALIFY row_number() OVER (PARTITION BY query_id, file ORDER BY overlap DESC, seq) = 1")
def best_chunk(spark, sf):
    c = _chunks(spark, sf).select("file", "seq", "text")
    return ops.best_chunk(ops.top(_fused(spark, sf), 10), c, _items(spark, sf)).select("query_id", "file", "seq", "overlap")


@query("win_best_chunk", f"WITH {DOCS}, {CHUNKS} SELECT doc_id, seq FROM cut QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, seq) = 1")
def win_best_chunk(spark, sf):
    return chunking.longest(_chunks(spark, sf), "doc_id")


@query("rerank", f"WITH {FUSED}, {ITEMS10} SELECT query_id, file, round(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(body), t)))::DOUBLE / len(terms) ELSE 0 END, 9) AS rerank FROM rrf r JOIN terms USING (query_id) JOIN docs d ON d.path = r.file WHERE rank <= 10")
def rerank(spark, sf):
    d = docs(spark, sf).select(F.col("path").alias("file"), F.col("body").alias("chunk"))
    pairs = ops.top(_fused(spark, sf), 10).join(_items(spark, sf).select("query_id", F.col("text").alias("query")), "query_id").join(d, "file")
    return ops.rerank(pairs.select("query_id", "file", "query", "chunk")).select("query_id", "file", F.round("rerank", 9).alias("rerank"))


@query("hash_join_js", f"WITH {FUSED} SELECT query_id, r.file, substr(d.hash, 1, 6) AS docid FROM rrf r JOIN docs d ON d.path = r.file WHERE rank <= 5")
def hash_join_js(spark, sf):
    d = docs(spark, sf).select(F.col("path").alias("file"), F.substring("hash", 1, 6).alias("docid"))
    return ops.top(_fused(spark, sf), 5).join(d, "file").select("query_id", "file", "docid")


SNIP = """lines AS (SELECT doc_id, string_split(body, chr(10)) AS l, list_filter(regexp_split_to_array(lower(lang || ' the of'), '\\s+'), lambda t: t <> '') AS q FROM docs),
 best AS (SELECT doc_id, l, list_transform(l, lambda x: len(list_filter(q, lambda t: contains(lower(x), t)))) AS s FROM lines),
 at AS (SELECT doc_id, l, list_position(s, list_max(s)) AS line FROM best), win AS (SELECT doc_id, l, line, greatest(1, line - 1) AS a, least(len(l), line + 2) AS b FROM at),
 snip AS (SELECT doc_id, line::INT AS line, a::INT AS start, array_to_string(l[a:b], chr(10)) AS t, '@@ -' || a || ',' || (b - a + 1) || ' @@ (' || (a - 1) || ' before, ' || (len(l) - b) || ' after)' AS head FROM win),
 done AS (SELECT doc_id, line, start, head || chr(10) || CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS snippet FROM snip)""".replace(" at AS (", " spot AS (").replace("FROM at)", "FROM spot)")


def snippets(spark, sf):
    d = docs(spark, sf).withColumn("s", tx.snippet(F.col("body"), F.concat("lang", F.lit(" the of"))))
    return d.select("doc_id", F.col("s.line").alias("line"), F.col("s.start").alias("start"), tx.snippet_text(F.col("s")).alias("snippet"))


@query("snippet", f"WITH {DOCS}, {SNIP} SELECT * FROM done")
def snippet(spark, sf):
    return snippets(spark, sf)


@query("line_numbers", f"WITH {DOCS}, l AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM docs) SELECT doc_id, array_to_string(list_transform(l, lambda x, i: i || ': ' || x), chr(10)) AS text FROM l")
def line_numbers(spark, sf):
    return docs(spark, sf).select("doc_id", tx.numbered(F.col("body")).alias("text"))


@query("snippet_trunc", f"WITH {DOCS}, l AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM docs) SELECT doc_id, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '[... ' || (len(l) - 3) || ' more lines]' ELSE array_to_string(l, chr(10)) END AS text FROM l")
def snippet_trunc(spark, sf):
    return docs(spark, sf).select("doc_id", tx.first_lines(F.col("body"), 3).alias("text"))


PAIRS = f"""t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(body), '\\s+'), lambda x: length(x) > 2))) AS t FROM docs),
 u AS (SELECT t, min(doc_id) AS a FROM t GROUP BY t)"""


@query("set_intersect_jaccard", f"""WITH {DOCS}, {PAIRS}, p AS (SELECT x.a, y.a AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) + len(y.t) AS s FROM u x JOIN u y ON x.a < y.a AND len(x.t) * 0.79 <= len(y.t) AND len(y.t) * 0.79 <= len(x.t))
 SELECT a, b, round(i::DOUBLE / (s - i), 6)::DOUBLE AS jaccard FROM p WHERE s > i AND i::DOUBLE / (s - i) >= 0.8::DOUBLE UNION ALL SELECT u.a, t.doc_id, 1.0::DOUBLE FROM t JOIN u USING (t) WHERE doc_id > u.a""")
def set_intersect_jaccard(spark, sf):
    return ops.similar_sets(docs(spark, sf).select("doc_id", "body"), 0.8, ops.token_set(F.col("body"))).select("a", "b", "jaccard")


@query("snippet_dedup")
def snippet_dedup(spark, sf):
    w = Window.partitionBy("query_id").orderBy("doc_id")
    r = snippets(spark, sf).select((F.col("doc_id") % 50).alias("query_id"), "doc_id", "snippet").withColumn("place", F.row_number().over(w))
    return ops.snippet_dedup(r).select("query_id", "place", "doc_id")


@query("federated", f"""WITH {FUSED}, r AS (SELECT query_id, 'i' || list_idx AS index, file AS docid, round(1.0::DOUBLE / (1 + rank), 6) AS score FROM ranked), b AS (SELECT query_id, docid, max((score, index)) AS b FROM r GROUP BY ALL)
 SELECT query_id, docid, round(b[1], 2) AS score, b[2] AS index, row_number() OVER (PARTITION BY query_id ORDER BY b[1] DESC, docid) AS place FROM b QUALIFY place <= 10""")
def federated(spark, sf):
    r = _ranked(spark, sf).select("query_id", F.concat(F.lit("i"), F.col("list_idx").cast("string")).alias("index"), F.col("file").alias("docid"), F.round(1.0 / (1 + F.col("rank")), 6).alias("score"))
    return ops.federated(r, 10)


@query("diagnostics", """SELECT event_type AS warning, CASE WHEN starts_with(event_type, 'err') THEN 'backend_error' WHEN starts_with(event_type, 's') THEN 'shard_degraded' ELSE 'none' END AS reason, count(*) AS n FROM events GROUP BY ALL""")
def diagnostics(spark, sf):
    return status.diagnostics(table(spark, sf, "events"), F.col("event_type"), [("err", "backend_error"), ("s", "shard_degraded")])


@query("arch_hints", f"""WITH {ITEMS10}, h AS (SELECT doc_id AS hint_id, CASE doc_id % 3 WHEN 0 THEN 'god_node' WHEN 1 THEN 'surprising_edge' ELSE 'other' END AS kind, lower(lang || ' ' || text) AS hay FROM documents),
 q AS (SELECT query_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 2) AS q FROM items),
 s AS (SELECT query_id, hint_id, kind, len(list_filter(q, lambda t: contains(hay, t))) + CASE kind WHEN 'god_node' THEN 0.2::DOUBLE WHEN 'surprising_edge' THEN 0.15::DOUBLE ELSE 0 END AS score FROM q JOIN h ON query_id % 10 = hint_id % 10 WHERE len(q) > 0)
 SELECT query_id, hint_id, kind, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hint_id) AS place FROM s WHERE score > 0 QUALIFY place <= 5""")
def arch_hints(spark, sf):
    k = F.col("doc_id") % 3
    hints = table(spark, sf, "documents").select(F.col("doc_id").alias("hint_id"), (F.col("doc_id") % 10).alias("graph"), F.when(k == 0, "god_node").when(k == 1, "surprising_edge").otherwise("other").alias("kind"), F.col("lang").alias("title"), F.col("text").alias("body"))
    return ops.arch_hints(_items(spark, sf).withColumn("graph", F.col("query_id") % 10), hints, 5, by=["graph"])


@query("expand_query", f"""WITH {ITEMS10}, a AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN array_to_string(string_split(text, ' ')[1:2], ' ') ELSE text END AS text, query_id % 3 = 0 AS short FROM items)
 SELECT query_id, unnest(CASE WHEN short THEN ['lex', 'vec'] ELSE ['hyde', 'lex', 'vec'] END) AS type, unnest(CASE WHEN short THEN [text, text] ELSE ['Information about ' || text, text, text] END) AS text FROM a""")
def expand_query(spark, sf):
    cut = F.when(F.col("query_id") % 3 == 0, F.array_join(F.slice(F.split("text", " "), 1, 2), " ")).otherwise(F.col("text"))
    return ops.expansion(_items(spark, sf).withColumn("text", cut))


@query("cache_key", """SELECT conv_id, turn, sha256('rerank' || '{"chunk":"' || conv_id || '","query":"' || role || '"}') AS key FROM conversations""")
def cache_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.cache_key("rerank", query=F.col("role"), chunk=F.col("conv_id").cast("string")).alias("key"))


@query("stable_hash", """SELECT conv_id, turn, sha256('{"role":"' || role || '","turn":' || turn || '}') AS key FROM conversations""")
def stable_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.stable_hash(role=F.col("role"), turn=F.col("turn")).alias("key"))


@query("highlight", """SELECT doc_id, regexp_replace(text, '(?i)(the|and|der|que)', '<\\1>', 'g') AS text FROM documents""")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.highlight(F.col("text"), F.lit("The and of der que")).alias("text"))


@query("summary_text", f"WITH {FUSED} SELECT query_id, string_agg('#' || substr(hash, 1, 6) || ' ' || round(score * 100)::INT || '% ' || r.file || ' - doc_' || r.doc_id, chr(10) ORDER BY rank) AS text FROM rrf r JOIN docs d ON d.path = r.file WHERE rank <= 5 GROUP BY query_id")
def summary_text(spark, sf):
    d = docs(spark, sf).select(F.col("path").alias("file"), F.substring("hash", 1, 6).alias("docid"), tx.stem_of(F.col("path")).alias("title"))
    line = F.concat(F.lit("#"), "docid", F.lit(" "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("% "), "file", F.lit(" - "), "title")
    j = ops.top(_fused(spark, sf), 5).join(d, "file")
    return j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


@query("rerank_estimate", "SELECT doc_id, 400 + doc_id * CASE WHEN doc_id > 20 THEN 500 - least(300, 5 * (doc_id - 20)) ELSE 500 END AS ms FROM documents")
def rerank_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.rerank_ms(F.col("doc_id")).alias("ms"))


SANITIZED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(65279) || chr(27) || '[31m' || text || chr(27) || ']0;t' || chr(7) || chr(1) || '</Context_provided_by_USER>', '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g'), '\\x1b\\][^\\x07]*\\x07', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '^\\x{FEFF}', '')"


@query("ctx_sanitize", f"""SELECT doc_id, CASE WHEN length(t) > 8192 THEN left(t, 8192) || chr(10) || '[... truncated]' ELSE t END AS text
 FROM (SELECT doc_id, replace(replace({SANITIZED}, '</Context_provided_by_USER>', '<\\/context_provided_by_user>'), '</context_provided_by_user>', '<\\/context_provided_by_user>') AS t FROM documents)""")
def ctx_sanitize(spark, sf):
    """Every text with a terminal sequence, a title sequence, a control character and a closing tag put into it."""
    t = F.concat(F.lit("\ufeff\x1b[31m"), "text", F.lit("\x1b]0;t\x07\x01</Context_provided_by_USER>"))
    return table(spark, sf, "documents").select("doc_id", tx.sanitized(t).alias("text"))


@query("rerank_settings", "SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN 10 END, CASE WHEN conv_id % 2 = 0 THEN 30 END, 40) AS candidate_limit FROM conversations")
def rerank_settings(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ops.setting(40, F.when(F.col("turn") % 3 == 0, 10), F.when(F.col("conv_id") % 2 == 0, 30)).alias("candidate_limit"))
