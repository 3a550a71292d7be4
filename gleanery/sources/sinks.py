"""Result rows as JSON, CSV, Markdown, XML and file lists; snapshots with checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_field(x: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break."""
    return F.when(x.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def fence(body: Column) -> Column:
    """Backticks, one more than the longest run in the body and three at least."""
    runs = F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1)


def row_json(docid: Column, score: Column, file: Column, title: Column, snippet: Column) -> Column:
    return F.to_json(F.struct(F.concat(F.lit("#"), docid).alias("docid"), F.round(score, 2).alias("score"), file.alias("file"), title.alias("title"), snippet.alias("snippet")))


def row_csv(docid: Column, score: Column, file: Column, title: Column, context: Column, line: Column, snippet: Column) -> Column:
    return F.concat_ws(",", F.concat(F.lit("#"), docid), fixed(score, 4), csv_field(file), csv_field(title), csv_field(F.coalesce(context, F.lit(""))), line.cast("string"), csv_field(snippet))


def row_files(docid: Column, score: Column, file: Column, context: Column) -> Column:
    return F.concat_ws(",", F.concat(F.lit("#"), docid), fixed(score, 2), csv_field(file), csv_field(context))


def row_markdown(docid: Column, file: Column, title: Column, context: Column, content: Column) -> Column:
    more = F.when(context.isNotNull(), F.concat(F.lit("**context:** "), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("---\n# "), F.coalesce(F.nullif(title, F.lit("")), file), F.lit("\n\n**docid:** `#"), docid, F.lit("`\n"), more, F.lit("\n"), content, F.lit("\n"))


def row_xml(docid: Column, file: Column, title: Column, content: Column) -> Column:
    return F.concat(F.lit('<file docid="#'), docid, F.lit('" name="'), xml_escape(file), F.lit('" title="'), xml_escape(title), F.lit('">\n'), xml_escape(content), F.lit("\n</file>"))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and an order-free digest of all columns, to verify a snapshot by."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), F.lit(0)).alias("digest"))


def backup(df: DataFrame, path: str) -> None:
    """A snapshot in a new folder, and beside it what to verify it by; Spark's commit protocol makes either whole or absent."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    fingerprint(df).write.mode("errorifexists").json(f"{path}/manifest")


def verify(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Whether a snapshot holds just the rows of df."""
    return fingerprint(df).first() == fingerprint(spark.read.parquet(f"{path}/data")).first()


def intact(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot is there and is what its manifest says."""
    said = spark.read.schema("rows bigint, digest bigint").json(f"{path}/manifest").first()
    return said is not None and fingerprint(spark.read.parquet(f"{path}/data")).first() == said


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot, if it is whole."""
    if not intact(spark, path):
        raise ValueError(f"{path}: the snapshot is not what its manifest says")
    return spark.read.parquet(f"{path}/data")


def replay(results: DataFrame, path: str) -> None:
    """One line of JSON for each query of results (query_id, file, rank): its results in order."""
    each = results.groupBy("query_id").agg(F.count("*").alias("results"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]).alias("files"))
    each.select(F.to_json(F.struct("query_id", "results", "files")).alias("value")).write.mode("errorifexists").text(path)
