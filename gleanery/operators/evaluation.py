"""Retrieval metrics of ranked lists against graded judgments, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("_"), F.lit("-"))


def joined(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, rank, rel and grade of every result (query_id, rank, doc_key)."""
    j = judgments.select("query_id", key(F.col("doc_key")).alias("k"), "grade").groupBy("query_id", "k").agg(F.max("grade").alias("grade"))
    r = results.select("query_id", "rank", key(F.col("doc_key")).alias("k"))
    return r.join(j, ["query_id", "k"], "left").select("query_id", "rank", F.col("grade").isNotNull().cast("int").alias("rel"), F.coalesce("grade", F.lit(0)).alias("grade"))


def dcg(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ideal(judgments: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    top = judgments.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return top.groupBy("query_id").agg(F.sum(dcg(F.col("grade"), F.col("_r"))).alias(f"idcg{k}"))


def per_query(results: DataFrame, judgments: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row a query of the judgments: first rank, and hit, mrr, precision, recall, ap, dcg and ndcg at each k."""
    rows = joined(results, judgments)
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.sum("rel").over(run))
    aggs = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank")]
    for k in ks:
        within = F.col("rank") <= k
        aggs += [
            F.max(F.when(within, F.col("rel"))).alias(f"h{k}"),
            F.sum(F.when(within, F.col("rel"))).alias(f"r{k}"),
            F.count(F.when(within, 1)).alias(f"n{k}"),
            F.sum(F.when(within & (F.col("rel") == 1), F.col("seen") / F.col("rank"))).alias(f"a{k}"),
            F.sum(F.when(within, dcg(F.col("grade"), F.col("rank")))).alias(f"d{k}"),
        ]
    got = rows.groupBy("query_id").agg(*aggs)
    total = judgments.groupBy("query_id").agg(F.count_distinct(key(F.col("doc_key"))).alias("total"))
    out = total.join(got, "query_id", "left")
    for k in ks:
        out = out.join(ideal(judgments, k), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns = [F.col("query_id"), F.col("first_rank")]
    for k in ks:
        columns += [
            F.coalesce(f"h{k}", F.lit(0)).alias(f"hit_{k}"),
            zero(F.when(F.col("first_rank") <= k, 1.0 / F.col("first_rank"))).alias(f"mrr_{k}"),
            zero(F.when(F.col(f"n{k}") > 0, F.col(f"r{k}") / F.col(f"n{k}"))).alias(f"precision_{k}"),
            zero(F.col(f"r{k}") / F.col("total")).alias(f"recall_{k}"),
            zero(F.col(f"a{k}") / F.col("total")).alias(f"ap_{k}"),
            zero(F.col(f"d{k}")).alias(f"dcg_{k}"),
            zero(F.when(F.col(f"idcg{k}") > 0, F.col(f"d{k}") / F.col(f"idcg{k}"))).alias(f"ndcg_{k}"),
        ]
    return out.select(*columns)


def report(metrics: DataFrame) -> DataFrame:
    """Means over the queries, six decimals."""
    names = [c for c in metrics.columns if c not in ("query_id", "first_rank")]
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def by_difficulty(metrics: DataFrame, tiers: DataFrame) -> DataFrame:
    """Hit@3, Hit@5, MRR@10 and NDCG@5 by difficulty, and over all."""
    each = metrics.join(tiers, "query_id").rollup("difficulty").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_3", "hit_5", "mrr_10", "ndcg_5")])
    return each.withColumn("difficulty", F.coalesce("difficulty", F.lit("overall")))
