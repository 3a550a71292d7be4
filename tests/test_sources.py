import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.sources import files, sinks


def test_scan_and_text(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.md").write_bytes("﻿# Hi".encode())
    (tmp_path / "node_modules" / "y.md").write_text("no")
    rows = files.read_text(files.scan(spark, str(tmp_path), "*.md")).collect()
    assert [(r["relative_path"], r["text"]) for r in rows] == [("a/x.md", "# Hi")]


def test_docx(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>Three</w:t></w:p>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r["relative_path"]: (r["text"], r["warnings"]) for r in files.read_docx(files.scan(spark, str(tmp_path), "*.docx")).collect()}
    assert rows == {"a.docx": ("One & two\nThree", []), "b.docx": ("", ["extractor_failed:docx_unzip"])}


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x, ""y""", 2\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [('x, "y"', "2")]


def test_layers_within_a_budget(spark):
    rows = spark.createDataFrame([("s", 0, "aaaa"), ("s", 1, "bbbb"), ("s", 2, "cc")], "scope string, depth int, text string")
    assert files.layered_text(rows, 6).first()["text"] == "aaaa\n\nbb"


def test_backup_and_verify(spark, tmp_path):
    df = spark.range(100)
    sinks.backup(df, str(tmp_path / "b"))
    assert sinks.verify(spark, df, str(tmp_path / "b"))
    assert not sinks.verify(spark, spark.range(99), str(tmp_path / "b"))


@pytest.mark.parametrize("partitions", [8, 200])
def test_row_blocks_keep_all_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(0, 1_000_000, 1, 16).select(F.col("id").alias("row"), F.col("id").cast("string").alias("a"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("b"))
        blocks = files.row_blocks(rows, "row", ["a", "b"], 100, "Rows")
        found = blocks.select("block", F.regexp_extract("body", r"Rows (\d+)-(\d+):", 1).cast("long").alias("a"), F.regexp_extract("body", r"Rows (\d+)-(\d+):", 2).cast("long").alias("b"), F.size(F.split("body", "\n")).alias("lines"))
        good = (F.col("a") == F.col("block") * 100 + 1) & (F.col("b") == F.col("block") * 100 + 100) & (F.col("lines") == 102)
        assert tuple(found.agg(F.count("*"), F.count_if(good), F.count_distinct("block")).first()) == (10_000, 10_000, 10_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_seeds_are_all_there(spark):
    from gleanery.operators.vectors import ivf_seeds

    v = spark.range(0, 300_000, 1, 12).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.rand(1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    assert {r["centroid_id"]: int(r["embedding"][0]) for r in ivf_seeds(v).collect()} == {i: i * 300_000 // 64 for i in range(64)}
