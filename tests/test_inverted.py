import pytest
from pyspark.sql import functions as F

from gleanery.operators import inverted, lexical

def columns():
    return {"title": F.col("title"), "body": F.col("body")}



def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["bm25"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("doc "), F.col("lang")).alias("title"), F.col("text").alias("body"))


@pytest.fixture(scope="module")
def queries(spark):
    texts = ["the of", '"of the"', "running -and", '"the" "and"', 't', '"and"', 'thin onthe', '"ed the of"', "nosuchwordatall", "les de"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_equals_the_full_scan_before_and_after_updates(spark, docs, queries, tmp_path):
    index = inverted.TextIndex(spark, f"file://{tmp_path}/i", columns())
    full = lambda d: rows(lexical.search(lexical.parse(queries, stemmed=True), *lexical.index(d, columns(), stemmed=True), limit=7))
    mine = lambda: rows(index.search(index.parse(queries), 7))
    index.build(docs)
    assert mine() == full(docs)
    changed = docs.where("doc_id % 10 = 3").withColumn("body", F.concat(F.lit("and the of running "), "body"))
    fresh = docs.where("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)
    gone = docs.where("doc_id % 10 = 4").select("doc_id")
    index.update(changed.unionByName(fresh), gone)
    now = docs.where("doc_id % 10 not in (3, 4)").unionByName(changed).unionByName(fresh)
    assert mine() == full(now)
    index.build(now)
    assert mine() == full(now) and len(list((tmp_path / "i").glob("gen-*"))) == 1


def test_blocks_are_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 20)
    texts = [(i, f"doc {i}", ("alpha " * (40 if i < 40 else 1) + "beta " * (1 + i % 2)) * (i % 3 == 0) + "filler " * (i % 60)) for i in range(1200)]
    d = spark.createDataFrame(texts, "doc_id bigint, title string, body string")
    q = spark.createDataFrame([(0, '"alpha" "beta"'), (1, '"alpha"')], "query_id bigint, text string")
    index = inverted.TextIndex(spark, f"file://{tmp_path}/i", columns(), stemmed=False).build(d)
    found = rows(index.search(index.parse(q), 5))
    assert found == rows(lexical.search(lexical.parse(q), *lexical.index(d, columns()), limit=5))
    there, read = index.read_blocks
    assert read < there / 2


def test_only_buckets_of_the_terms_are_read(spark, docs, tmp_path):
    index = inverted.TextIndex(spark, f"file://{tmp_path}/i", columns()).build(docs)
    parsed = index.parse(spark.createDataFrame([(0, "thin")], "query_id bigint, text string"))
    wanted = index._buckets(parsed)
    assert len(wanted) == 1
    files = index._table("postings", wanted).inputFiles()
    plan = index._table("postings", wanted)._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_index_and_unfinished_generations(spark, docs, queries, tmp_path):
    index = inverted.TextIndex(spark, f"file://{tmp_path}/i", columns())
    assert index.search(index.parse(queries)).count() == 0
    index.build(docs.limit(0))
    assert index.search(index.parse(queries)).count() == 0
    index.update(docs.where("doc_id < 20"))
    before = rows(index.search(index.parse(queries)))
    (tmp_path / "i/gen-9").mkdir()
    assert rows(index.search(index.parse(queries))) == before and before


def test_building_reads_texts_once_and_keeps_a_row_for_a_term_and_block(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = [(i, "doc", "alpha beta alpha" + (" gamma" if i % 10 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(texts, "doc_id bigint, title string, body string").repartition(2)
    index = inverted.TextIndex(spark, f"file://{tmp_path}/i", columns(), stemmed=False).build(d.mapInArrow(count, d.schema))
    assert seen.value == 200
    assert index._table("postings").where("term = 'alpha'").count() <= spark.sparkContext.defaultParallelism
    assert {r["term"]: r["df"] for r in index.vocabulary().collect()} == {"doc": 200, "alpha": 200, "beta": 200, "gamma": 20}
    assert index.totals() == (200, 4.1)


def test_texts_ids_and_gone_documents_in_several_generations(spark, tmp_path, monkeypatch):
    """Ids of another kind, weights, empty texts, blocks cut by tokens, and documents that are taken away twice and come back."""
    monkeypatch.setattr(inverted, "TOKENS", 50)
    rows_of = lambda *r: spark.createDataFrame(list(r), "doc_id string, title string, body string")
    first = rows_of(*[(f"d{i}", "of", "the cat " * i) for i in range(30)])
    index = inverted.TextIndex(spark, f"file://{tmp_path}/i", columns(), stemmed=False, weights={"title": 2.5, "body": 0.5}).build(first)
    index.update(rows_of(("d3", "cat", "the dog"), ("d4", "", "")), rows_of(("d5", "", "")).select("doc_id"))
    index.update(rows_of(("d5", "the cat", "the cat")), rows_of(("d3", "", "")).select("doc_id"))
    now = first.where("doc_id not in ('d3', 'd4', 'd5')").unionByName(rows_of(("d4", "", ""), ("d5", "the cat", "the cat")))
    q = spark.createDataFrame([(0, '"the cat"'), (1, "ca"), (2, '"cat the" -dog'), (3, "dog")], "query_id bigint, text string")
    found = rows(index.search(index.parse(q), 100))
    assert found == rows(lexical.search(lexical.parse(q), *lexical.index(now, columns()), weights={"title": 2.5, "body": 0.5}, limit=100))
    assert {r[0] for r in found} == {0, 1, 2} and index.totals()[0] == 29
    assert {r["term"]: r["df"] for r in index.vocabulary().collect()} == {"of": 27, "the": 27, "cat": 27}
