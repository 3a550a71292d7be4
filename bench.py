"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gleanery.plans import registry

HEADLINE = ("fts_search", "vec_exact", "hybrid_search", "rrf", "eval_report", "change_detect", "content_dedup", "ivf_search", "agg_usage_summary", "mem_exact_dedup", "chunk_chars", "snippet", "context_inherit", "tr_score")


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {"bm25_queries_per_s": round(asked / took["fts_search"], 2), "hybrid_queries_per_s": round(asked / took["hybrid_search"], 2), "ingest_docs_per_s": round(docs / took["content_dedup"], 1), "chunk_docs_per_s": round(docs / took["chunk_chars"], 1)}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
