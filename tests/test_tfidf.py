import math
from collections import Counter

import pytest

from gleanery.operators import lexical

DOCS = [(1, "a b b c"), (2, "a c d é"), (3, ""), (4, None), (5, "A, a; b"), (6, "x y z"), (7, "d d d a"), (8, "- -")]
ASK = [(0, "a b"), (1, "d é é nosuchword"), (2, None), (3, "nosuchword"), (4, "x a c"), (5, "B")]


def brute(asked, docs):
    words = lambda t: Counter("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    held = {}
    for i, t in docs:
        held.setdefault(i, Counter()).update(words(t))
    df = Counter(t for c in held.values() for t in c)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vector = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for q, text in asked:
        a = vector(words(text))
        for i, c in held.items():
            b = vector(c)
            if a.keys() & b.keys():
                out[q, i] = round(sum(a[t] * b[t] for t in a.keys() & b.keys()) / (size(a) * size(b)), 6)
    return out


@pytest.mark.parametrize("frequent, asked", [(300_000, 400_000), (2, 3), (0, 1)])
@pytest.mark.parametrize("copies", [[], [(1, "a z"), (7, "d d d a")]])
def test_cosines_equal_brute_force(spark, monkeypatch, frequent, asked, copies):
    # rare terms by a join, queries in blocks, rows that share an id
    monkeypatch.setattr(lexical, "FREQUENT", frequent)
    monkeypatch.setattr(lexical, "ASKED", asked)
    d = spark.createDataFrame(DOCS + copies, "doc_id bigint, body string")
    q = spark.createDataFrame(ASK, "query_id bigint, text string")
    got = {(r["query_id"], r["doc_id"]): r["cosine"] for r in lexical.tfidf_cosine(q, d).collect()}
    assert got == pytest.approx(brute(ASK, DOCS + copies), abs=1.1e-6)


def test_pairs_of_a_document_are_not_summed_by_shuffles(spark):
    d = spark.createDataFrame(DOCS, "doc_id bigint, body string")
    q = spark.createDataFrame(ASK, "query_id bigint, text string")
    plan = lexical.tfidf_cosine(q, d)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "Aggregate" not in plan
    assert lexical.tfidf_cosine(q.limit(0), d).count() == lexical.tfidf_cosine(q, d.limit(0)).count() == 0
