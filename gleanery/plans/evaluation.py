"""Queries of retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import evaluation as ops
from gleanery.plans.catalog import docs, query, table
from gleanery.plans.fusion import RANKED, _ranked

JUDGED = f"""{RANKED}, judged AS (SELECT q.q AS query_id, path AS doc_key, (doc_id % 4)::INT AS grade FROM docs JOIN (SELECT item_id AS q FROM benchmark) q ON doc_id % 10 = q.q % 10 WHERE (doc_id // 10 + q.q) % 5 = 0),
res AS (SELECT query_id, rank, lower(replace(file, '_', '-')) AS k FROM ranked WHERE list_idx = 0),
jk AS (SELECT query_id, lower(replace(doc_key, '_', '-')) AS k, max(grade) AS grade FROM judged GROUP BY ALL),
rel AS (SELECT query_id, rank, (grade IS NOT NULL)::INT AS rel, coalesce(grade, 0) AS grade, sum((grade IS NOT NULL)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM res LEFT JOIN jk USING (query_id, k)),
tot AS (SELECT query_id, count(*) AS total FROM jk GROUP BY query_id)"""


def _judged(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("tenth"))
    d = docs(spark, sf).withColumn("tenth", F.col("doc_id") % 10).join(asked, "tenth")
    return d.where((F.floor(F.col("doc_id") / 10) + F.col("query_id")) % 5 == 0).select("query_id", F.col("path").alias("doc_key"), (F.col("doc_id") % 4).cast("int").alias("grade"))


def _metrics(spark, sf):
    results = _ranked(spark, sf).where("list_idx = 0").select("query_id", "rank", F.col("file").alias("doc_key"))
    return ops.per_query(results, _judged(spark, sf))


def _at(k: int) -> str:
    return f"""m AS (SELECT t.query_id, min(rank) FILTER (rel = 1) AS first_rank, max(rel) FILTER (rank <= {k}) AS h, sum(rel) FILTER (rank <= {k}) AS r, count(*) FILTER (rank <= {k}) AS n,
 sum(seen::DOUBLE / rank) FILTER (rank <= {k} AND rel = 1) AS a, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1.0::DOUBLE)) FILTER (rank <= {k}) AS d, any_value(total) AS total FROM tot t LEFT JOIN rel USING (query_id) GROUP BY t.query_id),
 ig AS (SELECT query_id, sum((2.0::DOUBLE ** grade - 1) / log2(r + 1.0::DOUBLE)) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM judged QUALIFY r <= {k}) GROUP BY query_id),
 x AS (SELECT query_id, first_rank, coalesce(h, 0) AS hit, CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE / first_rank ELSE 0 END AS mrr, coalesce(r::DOUBLE / nullif(n, 0), 0) AS p, coalesce(r::DOUBLE / total, 0) AS rec, coalesce(a / total, 0) AS ap, coalesce(d, 0) AS dcg, CASE WHEN idcg > 0 THEN coalesce(d, 0) / idcg ELSE 0 END AS ndcg FROM m LEFT JOIN ig USING (query_id))"""


def _one(name: str, column: str, sql_column: str, k: int):
    @query(name, f"WITH {JUDGED}, {_at(k)} SELECT query_id, round({sql_column}, 6) AS value FROM x")
    def run(spark, sf):
        return _metrics(spark, sf).select("query_id", F.round(column, 6).alias("value"))


@query("first_rank", f"WITH {JUDGED}, {_at(10)} SELECT query_id, first_rank FROM x")
def first_rank(spark, sf):
    return _metrics(spark, sf).select("query_id", "first_rank")


for _name, _column, _sql in (("hit_at_k", "hit_5", "hit"), ("mrr_at_k", "mrr_5", "mrr"), ("dcg_at_k", "dcg_5", "dcg"), ("ndcg_at_k", "ndcg_5", "ndcg"), ("precision_at_k", "precision_5", "p"), ("recall_at_k", "recall_5", "rec"), ("ap_at_k", "ap_5", "ap")):
    _one(_name, _column, _sql, 5)


@query("win_running", f"WITH {JUDGED} SELECT query_id, rank, seen::BIGINT AS seen FROM rel")
def win_running(spark, sf):
    from pyspark.sql import Window

    results = _ranked(spark, sf).where("list_idx = 0").select("query_id", "rank", F.col("file").alias("doc_key"))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ops.joined(results, _judged(spark, sf)).select("query_id", "rank", F.sum("rel").over(run).alias("seen"))


@query("eval_report", f"WITH {JUDGED}, {_at(10)} SELECT count(*) AS queries, round(avg(hit), 6) AS hit_10, round(avg(mrr), 6) AS mrr_10, round(avg(p), 6) AS precision_10, round(avg(rec), 6) AS recall_10, round(avg(ap), 6) AS ap_10, round(avg(dcg), 6) AS dcg_10, round(avg(ndcg), 6) AS ndcg_10 FROM x")
def eval_report(spark, sf):
    return ops.report(_metrics(spark, sf)).select("queries", *[f"{m}_10" for m in ("hit", "mrr", "precision", "recall", "ap", "dcg", "ndcg")])


@query("eval_by_difficulty", f"WITH {JUDGED}, {_at(5)}, d AS (SELECT CASE query_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, hit, ndcg FROM x) SELECT coalesce(difficulty, 'overall') AS difficulty, count(*) AS queries, round(avg(hit), 6) AS hit_5, round(avg(ndcg), 6) AS ndcg_5 FROM d GROUP BY ROLLUP (difficulty)")
def eval_by_difficulty(spark, sf):
    m = _metrics(spark, sf)
    k = F.col("query_id") % 3
    tiers = m.select("query_id", F.when(k == 0, "easy").when(k == 1, "medium").otherwise("hard").alias("difficulty"))
    return ops.by_difficulty(m, tiers).select("difficulty", "queries", "hit_5", "ndcg_5")
