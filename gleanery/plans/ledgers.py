"""Queries of ledgers, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import ledgers as ops
from gleanery.operators import status
from gleanery.plans.catalog import DOCS, EDGES, edges, query, table

USAGE = """usage AS (SELECT 'k' || event_id AS idempotency_key, event_type AS operation, ['gpt-4o-mini', 'gpt-4o', 'gemini-1.5-pro', 'llama3', 'claude-3-5-haiku', 'text-embed', 'unknown'][event_id % 7 + 1] AS model,
 json_extract_string(props, '$.k')::BIGINT * 1000 + 5 AS input_tokens, event_id % 500 AS output_tokens, event_id % 5 AS cached_tokens, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, 'p' || user_id % 3 || '/x' AS project, ts, user_id FROM events),
 priced AS (SELECT *, CASE WHEN contains(model, 'llama') THEN 0.0::DOUBLE
 WHEN model = 'gemini-1.5-pro' THEN (greatest(input_tokens - cached_tokens, 0) * 1.25::DOUBLE + cached_tokens * 0.3125::DOUBLE + output_tokens * 5.0::DOUBLE) / 1e6 * CASE WHEN input_tokens > 128000 THEN 2 ELSE 1 END
 WHEN model = 'claude-3-5-haiku' THEN (greatest(input_tokens - cached_tokens, 0) * 1.0::DOUBLE + cached_tokens * 0.1::DOUBLE + output_tokens * 5.0::DOUBLE) / 1e6
 WHEN model = 'gpt-4o-mini' THEN (greatest(input_tokens - cached_tokens, 0) * 0.15::DOUBLE + cached_tokens * 0.075::DOUBLE + output_tokens * 0.6::DOUBLE) / 1e6
 WHEN model = 'gpt-4o' THEN (greatest(input_tokens - cached_tokens, 0) * 2.5::DOUBLE + cached_tokens * 1.25::DOUBLE + output_tokens * 10.0::DOUBLE) / 1e6
 WHEN model = 'text-embed' THEN (greatest(input_tokens - cached_tokens, 0) * 0.02::DOUBLE + cached_tokens * 0.02::DOUBLE) / 1e6 END AS cost_usd FROM usage)"""


def _usage(spark, sf):
    n = F.col("event_id")
    models = F.array(*map(F.lit, ("gpt-4o-mini", "gpt-4o", "gemini-1.5-pro", "llama3", "claude-3-5-haiku", "text-embed", "unknown")))
    e = table(spark, sf, "events").select(F.concat(F.lit("k"), n.cast("string")).alias("idempotency_key"), F.col("event_type").alias("operation"), F.get(models, (n % 7).cast("int")).alias("model"), (F.get_json_object("props", "$.k").cast("bigint") * 1000 + 5).alias("input_tokens"), (n % 500).alias("output_tokens"), (n % 5).alias("cached_tokens"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"), F.lit("/x")).alias("project"), "ts", "user_id")
    return e.withColumn("cost_usd", ops.cost(F.col("model"), F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))


@query("usage_cost", f"WITH {USAGE} SELECT idempotency_key, round(cost_usd, 10) AS cost_usd FROM priced")
def usage_cost(spark, sf):
    return _usage(spark, sf).select("idempotency_key", F.round("cost_usd", 10).alias("cost_usd"))


@query("agg_usage_summary", f"WITH {USAGE} SELECT count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, round(sum(cost_usd), 6) AS cost_usd, count(DISTINCT model) AS models, count(*) FILTER (status = 'error') AS errors FROM priced WHERE starts_with(project, 'p1/')")
def agg_usage_summary(spark, sf):
    return ops.usage_summary(_usage(spark, sf).where(ops.in_project(F.col("project"), "p1/*")))


@query("agg_usage_by_op", f"WITH {USAGE} SELECT operation, count(*) AS calls, sum(input_tokens + output_tokens)::BIGINT AS tokens, round(sum(cost_usd), 6) AS cost_usd FROM priced GROUP BY operation")
def agg_usage_by_op(spark, sf):
    return ops.usage_by_operation(_usage(spark, sf))


@query("usage_record", f"WITH {USAGE}, l AS (SELECT idempotency_key, status, ts, input_tokens FROM priced WHERE substr(idempotency_key, 2)::BIGINT % 2 = 0), n AS (SELECT idempotency_key, status, ts, CASE status WHEN 'error' THEN 0 ELSE input_tokens END FROM priced WHERE substr(idempotency_key, 2)::BIGINT % 2 = 1) SELECT idempotency_key, status, input_tokens FROM (SELECT * FROM l UNION ALL SELECT * FROM n)")
def usage_record(spark, sf):
    u = _usage(spark, sf).select("idempotency_key", F.col("ts").alias("created_at"), "status", "input_tokens")
    old = u.where(F.substring("idempotency_key", 2, 20).cast("bigint") % 2 == 0)
    return ops.record(old, u.unionByName(u)).select("idempotency_key", "status", "input_tokens")


@query("usage_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def usage_retention(spark, sf):
    return ops.kept_since(table(spark, sf, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query("audit_retention", "SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def audit_retention(spark, sf):
    return ops.kept_since(table(spark, sf, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp")).agg(F.count("*").alias("kept"))


@query("audit_query", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id < 10 ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_query(spark, sf):
    return ops.audit_page(table(spark, sf, "events").where(F.col("event_type").isin("click", "error") & (F.col("user_id") < 10)), 100).select("event_id", "event_type")


@query("audit_summary", "SELECT event_type AS action, count(*) AS total, count(*) FILTER (value < 10) AS failures, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def audit_summary(spark, sf):
    return ops.audit_summary(table(spark, sf, "events").select(F.col("event_type").alias("action"), (F.col("value") >= 10).alias("success"), "ts"))


@query("agg_trigger_rate", "SELECT count(*) FILTER (event_type = 'click') AS agent_auto, count(*) FILTER (event_type = 'purchase') AS user_explicit, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS unknown FROM events")
def agg_trigger_rate(spark, sf):
    t = F.col("event_type")
    return ops.trigger_rates(table(spark, sf, "events"), F.when(t == "click", "agent-auto").when(t == "purchase", "user-explicit"))


@query("agg_feedback", "SELECT doc_id % 50 AS result_id, count(*) FILTER (quality = 1 AND toxic = 0) AS positive, count(*) FILTER (toxic = 1) AS negative, count(*) FILTER (quality = 0 AND toxic = 0) AS neutral, count(*) AS total FROM labels GROUP BY 1")
def agg_feedback(spark, sf):
    said = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return ops.feedback_counts(table(spark, sf, "labels").select((F.col("doc_id") % 50).alias("result_id"), said.alias("satisfaction")))


@query("feedback_bias", "WITH f AS (SELECT doc_id // 3 AS result_id, count(*) FILTER (quality = 1) AS p, count(*) AS n FROM labels GROUP BY 1) SELECT doc_id AS result_id, coalesce(round(1 + 0.3::DOUBLE * (p::DOUBLE / n - 0.5::DOUBLE), 6), 1.0::DOUBLE) AS bias FROM documents LEFT JOIN f ON f.result_id = doc_id")
def feedback_bias(spark, sf):
    f = table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 3).alias("result_id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("satisfaction"))
    return ops.feedback_bias(f, table(spark, sf, "documents").select(F.col("doc_id").alias("result_id")))


@query("agg_metrics_hist", "WITH b AS (SELECT * FROM (VALUES ('1.0', 1.0::DOUBLE), ('10.0', 10.0::DOUBLE), ('100.0', 100.0::DOUBLE), ('+Inf', 1e300)) t(le, bound)) SELECT event_type, le, count(*) FILTER (value <= bound) AS count FROM events, b GROUP BY event_type, le")
def agg_metrics_hist(spark, sf):
    return ops.histogram(table(spark, sf, "events"), "event_type", "value", (1.0, 10.0, 100.0))


@query("agg_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def agg_percentile(spark, sf):
    return ops.percentiles(table(spark, sf, "events"), "event_type", "value")


@query("agg_arch_distill", f"WITH {DOCS}, {EDGES} SELECT id, count(*) AS edges FROM (SELECT unnest([source_path, target_path]) AS id FROM edges) GROUP BY id ORDER BY edges DESC, id LIMIT 15")
def agg_arch_distill(spark, sf):
    return ops.degrees(edges(spark, sf).select(F.col("source_path").alias("source"), F.col("target_path").alias("target")))


@query("topk_arch", f"WITH {DOCS}, {EDGES}, l AS (SELECT source_path AS source, target_path AS target, CASE length(source_path) % 3 WHEN 0 THEN 'imports' WHEN 1 THEN 'uses' ELSE 'calls' END AS relation, CASE length(target_path) % 2 WHEN 0 THEN 'EXTRACTED' ELSE 'ambiguous' END AS confidence FROM edges) SELECT * FROM l WHERE confidence = 'EXTRACTED' AND relation <> 'imports' ORDER BY source, target LIMIT 40")
def topk_arch(spark, sf):
    k = F.length("source") % 3
    links = edges(spark, sf).select(F.col("source_path").alias("source"), F.col("target_path").alias("target")).withColumn("relation", F.when(k == 0, "imports").when(k == 1, "uses").otherwise("calls")).withColumn("confidence", F.when(F.length("target") % 2 == 0, "EXTRACTED").otherwise("ambiguous"))
    return ops.surprising(links)


@query("arch_communities", "SELECT label AS community, count(*) AS size, count(DISTINCT vec_id % 7) AS sources FROM embeddings GROUP BY label")
def arch_communities(spark, sf):
    return ops.communities(table(spark, sf, "embeddings").select(F.col("label").alias("community"), (F.col("vec_id") % 7).alias("source")))


@query("trust_check", "SELECT doc_id FROM documents WHERE sha256(source || '|' || lang || '|update') NOT IN (SELECT sha256(source || '|' || lang || '|update') FROM documents JOIN labels USING (doc_id) WHERE quality = 1)")
def trust_check(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.col("lang").alias("path"), F.lit("update").alias("command"))
    good = d.join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select(ops.command_digest(F.col("name"), F.col("path"), F.col("command")).alias("digest"))
    return ops.untrusted(d, good).select("doc_id")


@query("capabilities", "SELECT 'source' AS capability, 'd' || count(DISTINCT source) AS value FROM documents UNION ALL SELECT 'lang', 'd' || count(DISTINCT lang) FROM documents UNION ALL SELECT 'ann', 'centroid-v1'")
def capabilities(spark, sf):
    one = table(spark, sf, "documents").agg(F.count_distinct("source").alias("s"), F.count_distinct("lang").alias("l"))
    m = F.create_map(F.lit("source"), F.concat(F.lit("d"), F.col("s").cast("string")), F.lit("lang"), F.concat(F.lit("d"), F.col("l").cast("string")))
    return status.capabilities(one.select(F.explode(m).alias("capability", "value")), {"ann": "centroid-v1", "lang": "none"})


@query("sort_nulls_last", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END ASC NULLS LAST, event_id) AS place FROM events")
def sort_nulls_last(spark, sf):
    v = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return ops.placed(table(spark, sf, "events"), "user_id", v, "event_id").select("event_id", "place")


@query("win_cumulative_budget", "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 20000")
def win_cumulative_budget(spark, sf):
    return ops.within_budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20000).select("doc_id")
