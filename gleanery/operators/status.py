"""State of a corpus: counts by collection, what lacks vectors, staleness, ingest warnings, fingerprints, capabilities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collection_stats(docs: DataFrame) -> DataFrame:
    """collection, total, active and last_modified; rows without a collection are one of their own."""
    return docs.groupBy("collection").agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.max("modified_at").alias("last_modified"))


def _marked(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active documents, and whether their content (hash) has a vector."""
    done = vectors.select("hash").where("hash is not null").distinct().withColumn("_done", F.lit(True))
    return docs.where("active").join(done, "hash", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))


def status(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """collection, documents, last_modified and needs_embedding (documents whose content has no vector) of active documents."""
    return _marked(docs, vectors).groupBy("collection").agg(F.count("*").alias("documents"), F.max("modified_at").alias("last_modified"), F.count_if(~F.col("_done")).alias("needs_embedding"))


def index_health(docs: DataFrame, vectors: DataFrame, today: Column) -> DataFrame:
    """One row: needs_embedding (contents without a vector), total (active documents), days_stale since the last change; null for an empty corpus."""
    one = _marked(docs, vectors).agg(F.count_distinct(F.when(~F.col("_done"), F.col("hash"))).alias("needs_embedding"), F.count("*").alias("total"), F.max("modified_at").alias("_last"))
    return one.select("needs_embedding", "total", F.datediff(today, F.substring("_last", 1, 10).cast("date")).alias("days_stale"))


def counts(rows: DataFrame, label: Column, name: str) -> DataFrame:
    """A label under a name, and n, how many rows have it; null is a label too."""
    return rows.groupBy(label.alias(name)).agg(F.count("*").alias("n"))


def listed(rows: DataFrame, raw: Column, name: str) -> DataFrame:
    """The rows with each string of a JSON array under a name; rows whose text is no array, or an empty one, have none."""
    return rows.withColumn(name, F.explode(F.from_json(raw, "array<string>")))


def warning_counts(rows: DataFrame, raw: Column) -> DataFrame:
    """warning and n over rows whose warnings are a JSON array of strings; blank ones don't count."""
    each = listed(rows.select(raw.alias("_raw")), F.col("_raw"), "_w").select(F.trim("_w").alias("_w")).where("_w <> ''")
    return counts(each, F.col("_w"), "warning")


def reason(warning: Column, rules: list[tuple[str, str]], default: str = "none") -> Column:
    """The reason of the first rule (prefix, reason) that a warning begins with."""
    found = F.lit(default)
    for prefix, why in reversed(rules):
        found = F.when(F.startswith(warning, F.lit(prefix)), why).otherwise(found)
    return found


def diagnostics(rows: DataFrame, warning: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """warning, reason and n."""
    return counts(rows, warning, "warning").select("warning", reason(F.col("warning"), rules).alias("reason"), "n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """collection and fp: SHA-256 of its hashes in order, repeats included, joined by commas; null hashes don't count, nor do collections of these alone.

    A digest of a sequence is made in its order, so a collection's hashes pass through one task, sorted (on disk where they
    are many) and streamed: it holds one batch, never the collection. fingerprint_trees() splits a collection as well.
    """
    kind = docs.schema["collection"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, out = None, None, ([], [])

        def close() -> None:
            if made is not None:
                out[0].append(now)
                out[1].append(made.hexdigest())

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if made is None or name != now:
                    close()
                    now, made = name, hashlib.sha256(value.encode())
                else:
                    made.update(b"," + value.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch_type), pa.array(out[1], pa.string())], ["collection", "fp"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema["collection"].dataType)
    rows = docs.where("hash is not null").select("collection", "hash").repartition("collection").sortWithinPartitions("collection", "hash")
    return rows.mapInArrow(run, f"collection {kind}, fp string")


def fingerprint_trees(docs: DataFrame, digits: int = 3) -> DataFrame:
    """collection and fp: SHA-256 of the digests of its parts, joined by commas; a part holds the hashes that begin with the same digits, in order.

    Equal for equal hashes, in any order of rows. No group is larger than a part: of a collection of N documents about
    N / 16^digits, and 16^digits digests of 64 characters.
    """
    rows = docs.where("hash is not null").select("collection", "hash", F.substring("hash", 1, digits).alias("_part"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    parts = rows.groupBy("collection", "_part").agg(joined("hash").alias("_fp"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_part", "_fp"))), lambda x: x["_fp"])
    return parts.groupBy("collection").agg(F.sha2(F.array_join(ordered, ","), 256).alias("fp"))


def capabilities(found: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """capability and value: what was found (the greatest, of several), and the default of what was not."""
    own = found.where("capability is not null AND value is not null").groupBy("capability").agg(F.max("value").alias("value"))
    rest = found.sparkSession.createDataFrame(sorted(defaults.items()), "capability string, value string")
    return own.unionByName(rest.join(own.select("capability"), "capability", "left_anti"))


def manifest(docs: DataFrame) -> DataFrame:
    """collection and manifest, a JSON object of its documents, active ones and last change."""
    return collection_stats(docs).select("collection", F.to_json(F.struct(F.col("total").alias("documents"), "active", "last_modified")).alias("manifest"))
