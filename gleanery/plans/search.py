"""Queries of retrieval from end to end, over the corpus and its links, with the deterministic provider."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.providers import Deterministic
from gleanery.operators import chunking, retrieval
from gleanery.plans.catalog import docs, edges, query
from gleanery.plans.lexical import asked


@query("hybrid_search")
def hybrid_search(spark, sf):
    return retrieval.hybrid(asked(spark, sf, 4), retrieval.Corpus(docs(spark, sf)), edges(spark, sf))


@query("structured_search")
def structured_search(spark, sf):
    lines = F.concat(F.lit("lex: "), "text", F.lit("\nvec: "), "text", F.lit("\nhyde: Information about "), "text", F.lit("\nnothing"))
    return retrieval.structured(asked(spark, sf, 4).withColumn("text", lines), retrieval.Corpus(docs(spark, sf)))


@query("chunk_chars")
def chunk_chars(spark, sf):
    return chunking.chunks(docs(spark, sf), "doc_id", "body").select("doc_id", "seq", "pos", F.length("text").alias("n"))


@query("chunk_tokens")
def chunk_tokens(spark, sf):
    return chunking.chunks(docs(spark, sf), "doc_id", "body", by_tokens=True).select("doc_id", "seq", "pos", "tokens", F.length("text").alias("n"))


@query("embed_batch")
def embed_batch(spark, sf):
    v = retrieval.chunk_vectors(docs(spark, sf), Deterministic())
    return v.select(F.substring_index("vec_id", "_", 1).alias("hash"), F.substring_index("vec_id", "_", -1).cast("int").alias("seq"), F.round(F.col("embedding")[0], 6).alias("first"))
