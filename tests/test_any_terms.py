"""Any-term search against SQLite's full-text search, strings of binary files, and changes of contexts."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from gleanery.operators import lexical, lookup
from gleanery.sources import files


def asked_of(text):
    """The query as SQLite's full-text search takes it."""
    words = [w for w in text.split() if len(w) >= 2]
    if len(words) == 1:
        return f'"{words[0]}"'
    quoted = [f'"{w}"' for w in words]
    return f'("{text}") OR (NEAR({" ".join(quoted)}, 10)) OR ({" OR ".join(quoted)})'


@pytest.mark.parametrize("seed", [1, 2])
def test_any_terms_equal_sqlite(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["snake_case", "don't"]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([1, 6, 40, 120]))), " ".join(rng.choices(words, k=3))) for i in range(300)]
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(title, body, tokenize='unicode61')")
    base.executemany("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", [(i + 1, title, body) for i, body, title in texts])
    docs = spark.createDataFrame(texts, "doc_id bigint, body string, title string").repartition(5)
    queries = ["w1", "w1 w2", "w3 w4 w5", "w7 w7", "w8 w9 w8", "snake_case w1", "w2 don't w6", "w1 w2 w3 w4", "w1 x w2", "unknown w5", "unknown other"]
    q = spark.createDataFrame([*enumerate(queries), (90, ""), (91, "!! ?"), (92, None)], "query_id bigint, text string")
    index = lexical.index(docs, {"title": F.col("title"), "body": F.col("body")})
    ours = {}
    for r in lexical.search_any(q, *index, weights={"title": 3.0, "body": 1.0}, limit=None).collect():
        ours.setdefault(r["query_id"], {})[r["doc_id"]] = r["bm25"]
    for i, text in enumerate(queries):
        theirs = {row - 1: score for row, score in base.execute("SELECT rowid, bm25(t, 3.0, 1.0) FROM t WHERE t MATCH ?", (asked_of(text),))}
        assert ours.get(i, {}) == pytest.approx(theirs, abs=2e-6), text
    assert set(ours) <= set(range(len(queries)))


def test_near_comes_before_far(spark):
    far = " ".join(["pad"] * 30)
    texts = [(0, "red fox " + far), (1, "red a b c fox " + far), (2, f"red {far} fox a b c"), (3, "fox pad " + far), (4, "pad"), (5, ""), (6, None), (7, "none"), (8, "none"), (9, "none")]
    docs = spark.createDataFrame(texts, "doc_id bigint, body string")
    q = spark.createDataFrame([(1, "red fox")], "query_id bigint, text string")
    found = lexical.search_any(q, *lexical.index(docs, {"body": F.col("body")})).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [0, 1, 2, 3]
    assert all(0 < r["score"] < 1 for r in found)
    assert lexical.search_any(q, *lexical.index(docs.limit(0), {"body": F.col("body")})).count() == 0


def test_pdf_strings(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\x00\x01abc\xff  two words\there\x80\nab\nlast \xe9")
    (tmp_path / "b.pdf").write_bytes(b"\x00\x01abc\x02")
    (tmp_path / "c.pdf").write_bytes(b"\n")  # the reader lists no empty files
    found = files.scan(spark, str(tmp_path), "*.pdf")
    rows = {r["relative_path"]: (r["text"], r["warnings"]) for r in files.read_pdf(found).collect()}
    nothing = ("", ["extractor_failed:pdf_no_output"])
    assert rows == {"a.pdf": ("%PDF-1.4\n  two words\there\nlast", ["extractor_degraded:pdf_strings_fallback"]), "b.pdf": nothing, "c.pdf": nothing}
    assert {tuple(r["warnings"]) for r in files.read_pdf(found, strict=True).collect()} == {("extractor_failed:pdf_pdftotext",)}
    assert {tuple(r["warnings"]) for r in files.read_pdf(found, enabled=False).collect()} == {("extractor_disabled:pdf",)}
    made = F.when(F.col("relative_path") == "b.pdf", " read \n").when(F.col("relative_path") == "a.pdf", " \n")
    rows = {r["relative_path"]: (r["text"], r["extractor"]) for r in files.read_pdf(found, extracted=made).collect()}
    assert rows["b.pdf"] == ("read", "extractor") and rows["a.pdf"][1] == "strings_fallback" and rows["c.pdf"] == ("", "unavailable")


def test_contexts_change(spark):
    kind = "collection string, prefix string, context string"
    held = spark.createDataFrame([(None, "", "all"), ("a", "", "one"), ("a", "x/", "two"), ("b", "x/", "three")], kind)
    changes = spark.createDataFrame([(None, "", "new"), ("a", "x/", None), ("c", "", "added"), ("d", "", None), ("b", "x/", None), ("b", "x/", "kept")], kind)
    after = {tuple(r) for r in lookup.with_contexts(held, changes).collect()}
    assert after == {(None, "", "new"), ("a", "", "one"), ("b", "x/", "kept"), ("c", "", "added")}
    assert lookup.with_contexts(held, changes.limit(0)).count() == 4
    listed = [tuple(r)[:2] for r in lookup.listed_contexts(held).orderBy("place").collect()]
    assert listed == [("a", "x/"), ("a", ""), ("b", "x/")]
