"""Queries of memories, over conversations: a conversation is a scope, a role a key, a text a value."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import memory as ops
from gleanery.plans.catalog import query, table

MEM = """mem AS (SELECT conv_id * 1000 + turn AS id, 's' || conv_id % 20 AS scope, CASE turn % 3 WHEN 0 THEN 'job_title' ELSE role || ':' || turn % 2 END AS key, text AS value, role || ', r' || turn % 2 AS source,
 conv_id * 60 + turn AS created_at, turn % 4 AS accessed_count, 1 + turn % 3 AS appeared_count, CASE WHEN turn % 5 > 0 THEN conv_id + turn * 7 END AS last_accessed_at, CASE WHEN turn % 6 = 1 THEN conv_id END AS expires_at FROM conversations)"""


def _mem(spark, sf):
    t, c = F.col("turn"), F.col("conv_id")
    return table(spark, sf, "conversations").select((c * 1000 + t).alias("id"), F.concat(F.lit("s"), (c % 20).cast("string")).alias("scope"), F.when(t % 3 == 0, "job_title").otherwise(F.concat("role", F.lit(":"), (t % 2).cast("string"))).alias("key"), F.col("text").alias("value"), F.concat("role", F.lit(", r"), (t % 2).cast("string")).alias("source"), (c * 60 + t).alias("created_at"), (t % 4).alias("accessed_count"), (1 + t % 3).alias("appeared_count"), F.when(t % 5 > 0, c + t * 7).alias("last_accessed_at"), F.when(t % 6 == 1, c).alias("expires_at"))


@query("mem_scope_resolve", """SELECT conv_id, turn, coalesce(e, s, w, 'default') AS scope, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN s IS NOT NULL THEN 'session' WHEN w IS NOT NULL THEN 'workspace' ELSE 'default' END AS source, CASE WHEN turn % 2 = 0 AND e <> coalesce(s, w) THEN 'cross_scope_forbidden' END AS error
 FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'e' || conv_id END AS e, CASE WHEN turn % 4 = 0 THEN 's' END AS s, CASE WHEN conv_id % 2 = 0 THEN 'w' END AS w FROM conversations)""")
def mem_scope_resolve(spark, sf):
    t, c = F.col("turn"), F.col("conv_id")
    r = ops.resolve_scope(F.when(t % 3 == 0, F.concat(F.lit("e"), c.cast("string"))), F.when(t % 4 == 0, " s "), F.when(c % 2 == 0, "w").otherwise(""), t % 2 == 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


@query("mem_scope_derive", "SELECT doc_id, 'my-proj-' || doc_id || '-' || substr(sha256('home/' || lang || '/My  Proj ' || doc_id), 1, 8) AS scope FROM documents")
def mem_scope_derive(spark, sf):
    p = F.concat(F.lit("/home/"), "lang", F.lit("/My  Proj "), F.col("doc_id").cast("string"), F.lit("/"))
    return table(spark, sf, "documents").select("doc_id", ops.derive_scope(p).alias("scope"))


@query("mem_key_prefix", f"WITH {MEM} SELECT id, string_split(key, ':')[1] AS prefix FROM mem")
def mem_key_prefix(spark, sf):
    return _mem(spark, sf).select("id", ops.key_prefix(F.col("key")).alias("prefix"))


@query("mem_tags_norm", "SELECT conv_id, turn, role || ',x' AS tags FROM conversations")
def mem_tags_norm(spark, sf):
    raw = F.array(F.concat(F.lit(" "), "role"), F.lit(""), F.lit("x "), F.col("role"), F.lit("x"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(ops.tags(raw), ",").alias("tags"))


@query("mem_source_merge", f"WITH {MEM}, n AS (SELECT DISTINCT scope, trim(unnest(string_split(source, ','))) AS s FROM mem) SELECT scope, count(*) AS names FROM n GROUP BY scope")
def mem_source_merge(spark, sf):
    m = _mem(spark, sf).groupBy("scope").agg(ops.merged_sources(F.collect_set("source")).alias("s"))
    return m.select("scope", F.size(F.split("s", ",")).cast("bigint").alias("names"))


@query("mem_exact_dedup", f"WITH {MEM} SELECT scope, key, value, min(id) AS id, count(*) AS appeared_count, max(created_at) AS last_appeared_at FROM mem GROUP BY ALL")
def mem_exact_dedup(spark, sf):
    return ops.exact_dedup(_mem(spark, sf)).drop("source")


SUP = f"{MEM}, sup AS (SELECT *, CASE WHEN key = 'job_title' THEN lead(id) OVER (PARTITION BY scope, key ORDER BY id) END AS superseded_by FROM mem)"


def _sup(spark, sf):
    return ops.single_cardinality(_mem(spark, sf))


@query("mem_single_card", f"WITH {SUP} SELECT id, superseded_by FROM sup")
def mem_single_card(spark, sf):
    return _sup(spark, sf).select("id", "superseded_by")


@query("mem_insert", f"WITH {MEM} SELECT scope, count(*) AS n FROM (SELECT scope, id FROM mem UNION ALL SELECT scope, id + 500 FROM mem WHERE id % 2 = 0) GROUP BY scope")
def mem_insert(spark, sf):
    m = _mem(spark, sf).select("scope", "id")
    return ops.inserted(m, m.where("id % 2 = 0").withColumn("id", F.col("id") + 500)).groupBy("scope").agg(F.count("*").alias("n"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")).alias("scope"), F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string")).alias("prefix"), "embedding")


@query("mem_semantic_super")
def mem_semantic_super(spark, sf):
    return ops.semantic_supersession(_vectors(spark, sf))


@query("mem_cross_super")
def mem_cross_super(spark, sf):
    return ops.semantic_supersession(_vectors(spark, sf).withColumn("prefix", F.col("id").cast("string")))


@query("mem_consolidate")
def mem_consolidate(spark, sf):
    return ops.consolidation(_vectors(spark, sf), 0.92)


@query("join_self_sim", """WITH v AS (SELECT vec_id AS id, 's' || vec_id % 5 AS scope, 'p' || vec_id % 3 AS prefix, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT x.scope, x.id AS a, y.id AS b, round(1 - greatest(0, least(2, 1 - list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))))), 6) AS similarity FROM v x JOIN v y ON x.scope = y.scope AND x.prefix = y.prefix AND x.id > y.id)
 SELECT * FROM p WHERE similarity >= 0.2""")
def join_self_sim(spark, sf):
    return ops.similar_pairs(_vectors(spark, sf), 0.2)


@query("mem_text_search", f"WITH {SUP}, l AS (SELECT * FROM sup WHERE superseded_by IS NULL AND (expires_at IS NULL OR expires_at > 50)), q AS (SELECT DISTINCT scope, 'user th' AS query, scope AS query_id FROM mem) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY accessed_count::DOUBLE / appeared_count DESC, accessed_count DESC, id) AS place FROM l JOIN q USING (scope) WHERE contains(lower(key || ': ' || value), 'user') AND contains(lower(key || ': ' || value), 'th') QUALIFY place <= 5")
def mem_text_search(spark, sf):
    rows = ops.live(_sup(spark, sf), F.lit(50))
    q = _mem(spark, sf).select("scope").distinct().select("scope", F.lit(" User TH ").alias("query"), F.col("scope").alias("query_id"))
    return ops.text_search(rows, q, 5)


@query("mem_sem_search", "WITH v AS (SELECT vec_id, (vec_id // 100) % 5 AS scope, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT scope, vec_id AS query_id, e AS q FROM v WHERE vec_id % 100 = 0), s AS (SELECT scope, query_id, vec_id AS id, round(1 - greatest(0, least(2, 1 - list_inner_product(q, e) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(e, e))))), 6) AS similarity FROM v JOIN q USING (scope)) SELECT scope, query_id, id, similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10")
def mem_sem_search(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.floor(F.col("vec_id") / 100) % 5).alias("scope"), "embedding")
    return ops.semantic_search(v, v.where("id % 100 = 0").select("scope", F.col("id").alias("query_id"), F.col("embedding").alias("q")), 0.3, 10)


@query("mem_counters", f"WITH {MEM} SELECT id, appeared_count + 2 AS appeared_count, accessed_count + 2 AS accessed_count FROM mem WHERE id % 3 = 0")
def mem_counters(spark, sf):
    m = _mem(spark, sf).withColumn("ttl_seconds", F.lit(None).cast("double")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    seen = m.where("id % 3 = 0").select("id")
    return ops.counters(m, seen.union(seen), F.lit("2025-01-01").cast("timestamp")).select("id", "appeared_count", "accessed_count")


@query("mem_history", f"WITH {MEM} SELECT id, value, row_number() OVER (PARTITION BY scope, key ORDER BY created_at, id) AS version FROM mem WHERE key = 'job_title'")
def mem_history(spark, sf):
    return ops.history(_mem(spark, sf), "job_title").select("id", "value", "version")


@query("mem_delete", f"WITH {SUP}, g AS (SELECT id AS gone, superseded_by AS next FROM sup WHERE id % 2003 = 3) SELECT s.id, CASE WHEN g.gone IS NOT NULL THEN g.next ELSE s.superseded_by END AS superseded_by FROM sup s LEFT JOIN g ON s.superseded_by = g.gone WHERE s.id NOT IN (SELECT gone FROM g)")
def mem_delete(spark, sf):
    s = _sup(spark, sf)
    return ops.delete(s, s.where("id % 2003 = 3").select("id")).select("id", "superseded_by")


@query("mem_purge", f"WITH {MEM} SELECT id FROM mem WHERE expires_at IS NULL OR expires_at > 50")
def mem_purge(spark, sf):
    return ops.unexpired(_mem(spark, sf), F.lit(50)).select("id")


@query("mem_evict", f"WITH {MEM} SELECT id FROM mem QUALIFY row_number() OVER (PARTITION BY scope ORDER BY last_accessed_at DESC NULLS FIRST, id DESC) <= CASE scope WHEN 's1' THEN 3 ELSE 10 END")
def mem_evict(spark, sf):
    limits = spark.createDataFrame([("s1", 3)], "scope string, max_rows int")
    return ops.evict(_mem(spark, sf), limits, 10).select("id")


@query("mem_prefetch", f"""WITH {MEM}, t AS (SELECT scope, id, trim(replace(value, chr(10), ' '), ' ')[1:120] AS l, row_number() OVER (PARTITION BY scope ORDER BY accessed_count DESC, appeared_count DESC, id DESC) AS place FROM mem QUALIFY place <= 5),
 u AS (SELECT *, coalesce(sum(length(l)) OVER (PARTITION BY scope ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t) SELECT scope, place, id, l[1:(360 - used)::BIGINT] AS line FROM u WHERE used < 360 AND l <> ''""")
def mem_prefetch(spark, sf):
    return ops.prefetched(_mem(spark, sf), limit=5)


@query("agg_memory_stats", f"WITH {SUP} SELECT scope, count(*) FILTER (superseded_by IS NULL) AS live, count(*) FILTER (superseded_by IS NOT NULL) AS superseded, count(*) AS total, sum(accessed_count)::BIGINT AS accessed FROM sup GROUP BY scope")
def agg_memory_stats(spark, sf):
    return ops.stats(_sup(spark, sf))


@query("mem_embed")
def mem_embed(spark, sf):
    from gleanery.functions.providers import hash_embedding

    m = _mem(spark, sf).select("id", F.concat_ws(": ", "key", "value").alias("text"))
    return ops.embed(m, m.where("id % 2 = 0"), hash_embedding)


@query("mem_lifecycle")
def mem_lifecycle(spark, sf):
    v = _vectors(spark, sf)
    kept = ops.consolidation(v, 0.92).where("merged_into is null").select("id")
    return v.join(kept, "id", "left_semi").select("id", "scope", "prefix")
