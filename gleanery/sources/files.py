"""Files, tables in files and other stores, read into document rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.text import strip_xml
from gleanery.sources.tables import ranked

# Folders that are never read, extensions that are, and the size above which a file is skipped.
IGNORED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")
EXTENSIONS = (".md", ".mdx", ".txt", ".org", ".rst", ".csv", ".json", ".html", ".xml", ".docx")
LARGEST = 25 * 1024 * 1024


def scan(spark: SparkSession, root: str, pattern: str = "*", ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, length, modificationTime and content of the files under root that match, without ignored folders, dot parts and empty files (which the reader leaves out); what is over LARGEST is listed but not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    # the length is known from the listing: the reader passes over files that the filter leaves out, and reads no content that isn't selected
    small, large = found.where(F.col("length") <= LARGEST), found.where(F.col("length") > LARGEST)
    files = small.unionByName(large.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content")))
    clean_root = root.rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + clean_root.replace("file://", "").replace(".", r"\.") + "/", "")
    parts = F.split(relative, "/")
    bad = F.exists(parts, lambda p: p.isin(*IGNORED, *ignore) | F.startswith(p, F.lit(".")))
    return files.withColumn("relative_path", relative).where(~bad)


def dispatch(files: DataFrame) -> DataFrame:
    """text and warning of each file (path, text) by its extension."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1))
    known = ext.isin(*EXTENSIONS)
    return files.withColumn("warning", F.when(~known, F.concat(F.lit("extractor_unsupported_extension:"), ext))).withColumn("text", F.when(known, F.col("text")).otherwise(""))


def read_text(files: DataFrame) -> DataFrame:
    """relative_path, text and warnings of scanned files: UTF-8 without byte order mark; large files are skipped with a warning."""
    large = F.col("length") > LARGEST
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^﻿", "")
    return files.select("relative_path", F.when(large, "").otherwise(text).alias("text"), F.when(large, F.array(F.lit("file_too_large"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def read_docx(files: DataFrame) -> DataFrame:
    """relative_path and text of scanned word-processor files; text is empty and a warning says so where the package can't be read."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as package:
                        out.append(package.read("word/document.xml").decode("utf-8", "replace"))
                except (zipfile.BadZipFile, KeyError):
                    out.append(None)
            yield pd.DataFrame({"relative_path": batch["relative_path"], "xml": out})

    raw = files.select("relative_path", "content").mapInPandas(unpack, "relative_path string, xml string")
    return raw.select("relative_path", F.coalesce(strip_xml(F.col("xml")), F.lit("")).alias("text"), F.when(F.col("xml").isNull(), F.array(F.lit("extractor_failed:docx_unzip"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def printable(content: Column, least: int = 4) -> Column:
    """The runs of printable ASCII characters, blanks and tabs in bytes, `least` and more of them, a line each."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[\\t\\x20-\\x7E]{{{least},}}"), F.lit(0))
    return F.array_join(runs, "\n")


def read_pdf(files: DataFrame, extracted: Column | None = None, strict: bool = False, enabled: bool = True) -> DataFrame:
    """relative_path, text, extractor and warnings of PDF files (relative_path, content).

    extracted: what an extractor made of each file, if there is one; null or blank where it failed. Such files give their printable
    strings with a warning, or nothing if `strict`; files without strings (and null contents) give an empty text.
    """
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    made = trimmed(extracted if extracted is not None else F.lit(None).cast("string"))
    strings = trimmed(printable(F.col("content")))
    none = F.array().cast("array<string>")
    # (when, text, extractor, warnings): the first that holds
    cases = [
        (F.lit(not enabled), F.lit(""), "disabled", F.array(F.lit("extractor_disabled:pdf"))),
        (made != "", made, "extractor", none),
        (F.lit(strict), F.lit(""), "extractor", F.array(F.lit("extractor_failed:pdf_pdftotext"))),
        (strings != "", strings, "strings_fallback", F.array(F.lit("extractor_degraded:pdf_strings_fallback"))),
        (F.lit(True), F.lit(""), "unavailable", F.array(F.lit("extractor_failed:pdf_no_output"))),
    ]
    first = F.coalesce(*[F.when(when, F.struct(text.alias("text"), F.lit(name).alias("extractor"), warnings.alias("warnings"))) for when, text, name, warnings in cases])
    return files.select("relative_path", first.alias("_of")).select("relative_path", "_of.text", "_of.extractor", "_of.warnings")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of quoted CSV with a header, all columns strings, cells trimmed."""
    return spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


_ITEMS = "array<string>"
_TYPED = "array<variant>"
_NAMED = "map<string, variant>"


def _js_type(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.isNull() | (kind == "VOID") | kind.rlike("^(ARRAY|OBJECT)"), "object").otherwise("number")


def json_blocks(files: DataFrame, key: str, text: str, per_block: int = 50) -> DataFrame:
    """key, block, body and warning of JSON files, one a row: their items in blocks, each with a line of the first item's types and one that says which items it holds.

    Items are those of a list, or of the first property that is a list, or the one value there is. Items keep the order of their properties and are
    written without blanks. Text that is no JSON gives one row with an empty body and a warning; an empty list gives no rows.
    """
    raw = F.col(text)
    # a lone value is read as a list of itself, so that all shapes come to lists: as texts, whose order of properties holds, and as variants, whose types are known
    listed = F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw)
    rows = files.select(F.col(key), raw.alias("_raw"), F.try_parse_json(raw).alias("_v"), F.from_json(raw, _NAMED).alias("_named"), listed.alias("_listed"))
    lists = F.filter(F.map_entries("_named"), lambda e: F.schema_of_variant(e["value"]).startswith("ARRAY"))
    # the property's own text: a map of texts gives it as it stands
    within = F.element_at(F.from_json("_raw", "map<string, string>"), F.get(lists, F.lit(0))["key"])
    source = F.when(F.col("_listed").isNotNull(), F.col("_listed")).when(F.size(lists) > 0, within).otherwise(F.concat(F.lit("["), F.col("_raw"), F.lit("]")))
    rows = rows.select(key, "_v", source.alias("_source")).select(key, "_v", F.from_json("_source", _ITEMS).alias("_texts"), F.from_json("_source", _TYPED).alias("_typed"))
    said = F.transform(F.arrays_zip("_texts", "_typed"), lambda x: F.when(_js_type(x["_typed"]) == "string", F.to_json(x["_typed"])).otherwise(F.coalesce(x["_texts"], F.lit("null"))))
    first = F.from_json(F.get("_texts", F.lit(0)), _NAMED)
    types = F.array_join(F.transform(F.map_entries(first), lambda e: F.concat(e["key"], F.lit(": "), _js_type(e["value"]))), ", ")
    rows = rows.select(key, F.col("_v").isNull().alias("bad"), said.alias("items"), F.coalesce(types, F.lit("")).alias("types"))
    good = rows.where("not bad").select(key, "items", "types", F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / per_block).cast("int"))).alias("block")).where("size(items) > 0")
    first_item = F.col("block") * per_block
    some = F.slice("items", first_item + 1, F.lit(per_block))
    body = F.concat(F.lit("Schema: "), F.col("types"), F.lit("\nItems "), (first_item + 1).cast("string"), F.lit("-"), (first_item + F.size(some)).cast("string"), F.lit(":\n"), F.array_join(some, "\n"))
    none = rows.where("bad").select(key, F.lit(0).alias("block"), F.lit("").alias("body"), F.lit("extractor_failed:json_error").alias("warning"))
    return good.select(key, "block", body.alias("body"), F.lit(None).cast("string").alias("warning")).unionByName(none)


def row_blocks(rows: DataFrame, order: str, columns: list[str], per_block: int, what: str) -> DataFrame:
    """block and body: rows in blocks of a fixed number, each with a line of schema and a line saying which rows it holds; `order` is unique.

    Rows are numbered in one written table (`ranked`), so that no task sees all of them.
    """
    numbered = ranked(rows, order, name="rows").withColumn("_rn", F.col("_at") + 1)
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in columns])
    block = F.floor((F.col("_rn") - 1) / per_block).alias("block")
    head = "Schema: " + ", ".join(f"{c}: string" for c in columns)
    grouped = numbered.groupBy(block).agg(F.min("_rn").alias("a"), F.max("_rn").alias("b"), F.array_sort(F.collect_list(F.struct("_rn", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit(f"{head}\n{what} "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(":\n"), F.array_join("lines.line", "\n"))
    return grouped.select("block", body.alias("body"))


def training_rows(lines: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """Training examples from JSON lines; a line without query or with an output of unknown kind fails the query."""
    row = F.from_json(line, "query string, output array<array<string>>")
    output = F.transform(row["output"], lambda o: F.struct(F.get(o, F.lit(0)).alias("kind"), F.get(o, F.lit(1)).alias("value")))
    good = F.coalesce((F.trim(row["query"]) != "") & (F.size(row["output"]) > 0) & F.forall(output, lambda o: o["kind"].isin("lex", "vec", "hyde")), F.lit(False))
    return lines.where(F.length(F.trim(line)) > 0).select(*keep, row["query"].alias("query"), output.alias("output"), F.assert_true(good, F.concat(F.lit("bad training line: "), F.substring(line, 1, 80))).alias("_ok")).where("_ok is null").drop("_ok")


def from_vector_store(embeddings: DataFrame, texts: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of another vector store (id, collection), with their texts and their metadata as columns."""
    wide = meta.groupBy("id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    return embeddings.join(texts, "id").join(wide, "id", "left")


def layered_text(files: DataFrame, budget: int) -> DataFrame:
    """scope and text: instruction files (scope, depth, text) from the root down, cut at a budget of bytes for each scope."""
    run = Window.partitionBy("scope").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum(F.octet_length("text")).over(run), F.lit(0)), F.lit(0)).cast("int")
    cut = files.withColumn("_left", left).withColumn("text", F.when(F.octet_length("text") <= F.col("_left"), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("_left"))))
    return cut.where("_left > 0").groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
