"""Ingest as snapshots: every change is a function from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup(content: DataFrame) -> DataFrame:
    """One row per hash: the earliest date it was seen; equal hashes have equal texts."""
    return content.groupBy("hash").agg(F.min("created_at").alias("created_at"), F.any_value("doc").alias("doc"))


def changes(now: DataFrame, incoming: DataFrame) -> DataFrame:
    """collection, path and status (new, updated, title, unchanged, removed) of a snapshot against what comes in."""
    a = now.where("active").select("collection", "path", F.col("hash").alias("old_hash"), F.col("title").alias("old_title"), F.lit(True).alias("was"))
    b = incoming.select("collection", "path", F.col("hash").alias("new_hash"), F.col("title").alias("new_title"), F.lit(True).alias("comes"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("comes").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "updated").when(F.col("old_title") != F.col("new_title"), "title").otherwise("unchanged")
    return a.join(b, ["collection", "path"], "full_outer").select("collection", "path", status.alias("status"), "old_hash", "new_hash")


def upsert(now: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, versions): the snapshot with what comes in, reactivated, and the replaced versions."""
    new = incoming.select("collection", "path", F.struct("hash", "title", "modified_at").alias("new"))
    both = now.select("collection", "path", F.struct("hash", "title", "modified_at", "active").alias("old")).join(new, ["collection", "path"], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    active = F.col("new").isNotNull() | F.col("old.active")
    documents = both.select("collection", "path", pick("hash"), pick("title"), pick("modified_at"), active.alias("active"))
    versions = both.where(F.col("old.hash") != F.col("new.hash")).select("collection", "path", F.col("old.hash").alias("hash"), F.col("old.modified_at").alias("created_at"))
    return documents, versions


def deactivate(now: DataFrame, present: DataFrame) -> DataFrame:
    """Rows that are no longer present lose their active flag."""
    seen = present.select("collection", "path", F.lit(True).alias("_seen")).distinct()
    return now.join(seen, ["collection", "path"], "left").withColumn("active", F.col("active") & F.coalesce("_seen", F.lit(False))).drop("_seen")


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of each key the row that is latest by `at`, ties to the greatest row."""
    rest = [c for c in rows.columns if c not in keys and c != at]
    return rows.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_r")).select(*keys, "_r.*")


def replaced_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links of the sources that come in are those that come in; others stay."""
    touched = incoming.select("collection", "source_path").distinct()
    kept = links.join(touched, ["collection", "source_path"], "left_anti")
    return kept.unionByName(incoming.where("target_path is not null").select(*kept.columns)).distinct()


def orphans(content: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Content that neither a document nor a version refers to."""
    return content.join(documents.select("hash"), "hash", "left_anti").join(versions.select("hash"), "hash", "left_anti")


def orphan_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    return vectors.join(documents.where("active").select("hash"), "hash", "left_anti")


def needs_embedding(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active hashes without a first vector, with their smallest path."""
    done = vectors.where("seq = 0").select("hash")
    return documents.where("active").join(done, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path"))


def vector_parity(content_vectors: DataFrame, index: DataFrame) -> DataFrame:
    """One row: rows on each side, keys missing on each side, and a fingerprint of the keys."""
    a = content_vectors.select("hash_seq", F.lit(1).alias("a"))
    b = index.select("hash_seq", F.lit(1).alias("b"))
    both = a.join(b, "hash_seq", "full_outer")
    # an order-free fingerprint: sums of key hashes combine on the map side
    part = F.conv(F.substring(F.sha2("hash_seq", 256), 1, 8), 16, 10).cast("bigint")
    return both.agg(F.count("a").alias("content_rows"), F.count("b").alias("index_rows"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.sum(F.when(F.col("a").isNotNull(), part)).alias("content_fp"), F.sum(F.when(F.col("b").isNotNull(), part)).alias("index_fp"))


def renamed(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def version_list(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions of each path, newest first and the current one at 1; of equal hashes the newest counts."""
    every = versions.select("collection", "path", "hash", "created_at").unionByName(documents.select("collection", "path", "hash", F.col("modified_at").alias("created_at")))
    fresh = every.groupBy("collection", "path", "hash").agg(F.max("created_at").alias("created_at"))
    order = Window.partitionBy("collection", "path").orderBy(F.desc("created_at"), "hash")
    return fresh.withColumn("version", F.row_number().over(order))


def as_of(versions: DataFrame, at: DataFrame) -> DataFrame:
    """For each row of at (collection, path, ts) the hash of the latest version by then, null if there is none."""
    joined = at.join(versions.select("collection", "path", "hash", "created_at"), ["collection", "path"], "left")
    by_then = F.when(F.col("created_at") <= F.col("ts"), F.struct("created_at", "hash"))
    return joined.groupBy("collection", "path", "ts").agg(F.max(by_then).alias("_v")).select("collection", "path", "ts", F.col("_v.hash").alias("hash"))


def neighbours(links: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Active documents one link away from a query's candidates, in either direction, that are not candidates."""
    keys = ["query_id", "collection", "path"]
    out = candidates.join(links, [candidates["collection"] == links["collection"], candidates["path"] == links["source_path"]]).select("query_id", links["collection"], F.col("target_path").alias("path"))
    into = candidates.join(links, [candidates["collection"] == links["collection"], candidates["path"] == links["target_path"]]).select("query_id", links["collection"], F.col("source_path").alias("path"))
    near = out.union(into).distinct().join(candidates.select(*keys), keys, "left_anti")
    return near.join(documents.where("active").select("collection", "path"), ["collection", "path"], "left_semi").select(*keys)


def retitled(docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """docs with the titles of incoming (collection, path, title) where it has one; a document that comes twice gets the greatest."""
    new = incoming.groupBy("collection", "path").agg(F.max("title").alias("_new"))
    return docs.join(new, ["collection", "path"], "left").withColumn("title", F.coalesce("_new", "title")).drop("_new")


def attached(target: DataFrame, source: DataFrame, collections: list[str]) -> DataFrame:
    """target and what it lacks (by collection and path) of some collections of another index; the target's own rows hold."""
    wanted = source.where(F.col("collection").isin(*collections)).select(*target.columns)
    return target.unionByName(wanted.join(target, ["collection", "path"], "left_anti").select(*target.columns))


def cleared(rows: DataFrame) -> DataFrame:
    """A table of the same columns without rows, to be written over it."""
    return rows.limit(0)


def backlinks(links: DataFrame) -> DataFrame:
    """path and n: how many links (collection, source_path, target_path) lead to each path."""
    return links.groupBy(F.col("target_path").alias("path")).agg(F.count("*").alias("n"))


def linked(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents that a link begins or ends at."""
    ends = links.select("collection", F.explode(F.array("source_path", "target_path")).alias("path"))
    return docs.join(ends, ["collection", "path"], "left_semi")


def copied_in(docs: DataFrame, collection: str) -> DataFrame:
    """hash of each content that a collection holds, wherever else it is held too."""
    return docs.join(docs.where(F.col("collection") == collection).select("hash"), "hash", "left_semi").select("hash").distinct()


def with_content(docs: DataFrame, content: DataFrame) -> DataFrame:
    """Active documents with their content's columns (content: one row a hash, or equal rows); those without content are left out."""
    return docs.where("active").join(content.dropDuplicates(["hash"]), "hash")


def vector_documents(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Each vector (hash) with each active document that has its content."""
    return vectors.join(docs.where("active"), "hash")


def with_ingest(docs: DataFrame, ingests: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents, with what their ingest has left (ingests: one row a key), null where it has left nothing."""
    return docs.join(ingests, key, "left")


def lacking(docs: DataFrame, others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that another table does not know by key; a null key is known nowhere."""
    return docs.join(others.select(key), key, "left_anti")


def known_hashes(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """hash of every content that a document or an older version has, once."""
    return docs.select("hash").union(versions.select("hash")).distinct()


def facets(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct combinations of some columns."""
    return docs.select(*columns).distinct()


def cardinalities(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: the number of distinct values of some columns (name of the result: column); long texts meet as digests, not as texts."""
    text = lambda c: F.sha2(F.col(c), 256) if docs.schema[c].dataType.simpleString() == "string" else F.col(c)
    return docs.select(*[text(c).alias(f"_{name}") for name, c in columns.items()]).agg(*[F.count_distinct(f"_{name}").alias(name) for name in columns])
