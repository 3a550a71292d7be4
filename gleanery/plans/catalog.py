"""Where queries and their SQL are registered, and the corpus views that queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(seconds) -> F.Column:
    return F.date_format(F.timestamp_seconds(seconds), ISO)


def iso_sql(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds})::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S.') || '000Z'"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as documents: collection, path, content hash and dates; one in ten is inactive."""
    d = table(spark, sf_dir, "documents")
    when = F.lit(1704067200) + F.col("doc_id") * 60
    return d.select("doc_id", F.col("source").alias("collection"), F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash"), F.col("text").alias("body"), "lang", iso(when).alias("modified_at"), (F.col("doc_id") % 10 != 9).alias("active"))


DOCS = f"""docs AS (SELECT doc_id, source AS collection, lang || '/doc_' || doc_id || '.md' AS path, sha256(text) AS hash, text AS body, lang,
  {iso_sql("1704067200 + doc_id * 60")} AS modified_at, doc_id % 10 <> 9 AS active FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents of one collection: each to the twentieth after it and to the sixtieth."""
    d = docs(spark, sf_dir).select("collection", F.col("path").alias("source_path"), "doc_id")
    t = docs(spark, sf_dir).select("collection", F.col("path").alias("target_path"), F.col("doc_id").alias("t"))
    jumps = d.withColumn("t", F.explode(F.array(F.col("doc_id") + 20, F.col("doc_id") + 60)))
    return jumps.join(t, ["collection", "t"]).select("collection", "source_path", "target_path")


EDGES = "edges AS (SELECT a.collection, a.path AS source_path, b.path AS target_path FROM docs a JOIN docs b ON a.collection = b.collection AND b.doc_id IN (a.doc_id + 20, a.doc_id + 60))"
