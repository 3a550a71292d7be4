"""What searches move between tasks: terms and hits, but no pairs of query and document, and no pairs of term and document."""

import re

from pyspark.sql import functions as F

from gleanery.operators import lexical

WORDS = "ash birch cedar elm fir".split()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"([a-z_]+)#", keys)) for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


def _docs(spark, ids=range(60)):
    return spark.createDataFrame([(i, " ".join(WORDS[(i + k * k) % 5] for k in range(6))) for i in ids], "doc_id bigint, body string")


def test_scores_are_summed_where_documents_are(spark):
    index = lexical.index(_docs(spark), {"body": F.col("body")})
    asked = spark.createDataFrame([(q, f"{WORDS[q % 2]} {WORDS[2]} -{WORDS[4]}") for q in range(10)] + [(10, "ash ash")], "query_id bigint, text string")
    found = lexical.search(lexical.parse(asked), *index, limit=None)
    assert not any({"doc_id"} < keys for keys in exchanges(found))
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["bm25"], r["score"]))
    # queries of the same words give the same rows; a word that is asked for twice counts twice
    assert len({tuple(sorted(rows[q])) for q in range(0, 10, 2)}) == 1 and sorted(rows) == list(range(11))
    once = {r["doc_id"]: r["bm25"] for r in lexical.search(lexical.parse(asked.where("query_id = 10").withColumn("text", F.lit("ash"))), *index, limit=None).collect()}
    assert {d: s for _, d, s, _ in rows[10]} == {d: round(2 * s, 6) for d, s in once.items()} or all(abs(s - 2 * once[d]) < 2e-6 for _, d, s, _ in rows[10])


def test_phrases_are_found_by_pairs(spark):
    docs = _docs(spark)
    posts = lexical.index(docs, {"body": F.col("body")})[0]
    phrases = [" ".join(p) for p in (("ash", "birch"), ("ash", "birch", "ash"), ("fir", "fir"), ("elm",), ("birch", "ash", "ash", "birch"))]
    asked = spark.createDataFrame(list(enumerate(f'"{p}"' for p in phrases)), "query_id bigint, text string")
    pairs = lexical.phrase_starts(lexical.parse(asked.where("query_id in (0, 2)")), posts)
    assert not any("start" in keys and "n" not in keys for keys in exchanges(pairs))
    got = {(r["query_id"], r["doc_id"]): r["hits"] for r in lexical.hits(lexical.parse(asked), posts).collect()}
    want = {}
    for d, body in docs.collect():
        t = body.split()
        for q, p in enumerate(phrases):
            w = p.split()
            k = sum(t[i : i + len(w)] == w for i in range(len(t)))
            if k:
                want[q, d] = k
    assert got == want and len({q for q, _ in want}) == 3


def test_vocabulary_counts_terms_alone(spark):
    for ids in (range(20), [*range(20), 3, 3, 7]):
        docs = _docs(spark, ids)
        made = lexical.vocabulary(docs, {"body": F.col("body"), "title": F.lit("Ash x")})
        if len(ids) == 20:
            assert not any("doc_id" in keys for keys in exchanges(made))
        got = {r["term"]: (r["df"], r["tf"]) for r in made.collect()}
        rows = [(d, w) for d, b in docs.collect() for w in [*b.split(), "ash", "x"]]
        assert got == {w: (len({d for d, v in rows if v == w}), sum(v == w for _, v in rows)) for _, w in rows}
