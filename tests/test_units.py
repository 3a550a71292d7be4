import random
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.functions import training as tr
from gleanery.functions.stem import fold, stem
from gleanery.operators import chunking, fusion, lexical, lookup
from gleanery.streaming import events


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab #`-\n1.", max_size=400), st.integers(20, 90))
def test_chunks_hold_all_text(text, size):
    parts = chunking.chunk(text, size, 10, 15)
    at = 0
    for place, part in parts:
        assert place <= at and text[place : place + len(part)] == part
        at = place + len(part)
    assert at == len(text)


def test_chunks_by_tokens_stay_small_and_whole():
    text = "word " * 4000
    parts = chunking.chunk_tokens(text)
    assert all(n <= chunking.TOKENS for _, _, n in parts)
    assert max(p + len(t) for p, t, _ in parts) == len(text)


def test_breaks_prefer_headings_outside_fences():
    text = "a" * 50 + "\n# Head\n" + "b" * 20 + "\n```\n# no\n```\n" + "c" * 60
    assert chunking.Cutter(text).cut(75, 80) == 50 and chunking.Cutter(text).cut(90, 20) == 78
    assert chunking.fences("```\nx\n```\ny\n```") == [(0, 9), (11, 15)]


def test_stems_equal_those_of_sqlite():
    words = "running runs relational hopping falling hissing ponies caresses happy sky agreed plastered probate controlling electriciti replacement adoption café naïve".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    for i, w in enumerate(words):
        db.execute("INSERT INTO f(rowid, t) VALUES (?, ?)", (i, w))
    assert {d: t for t, d in db.execute("SELECT term, doc FROM v")} == {i: stem(fold(w)) for i, w in enumerate(words)}


def test_bm25_equals_that_of_sqlite(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "alphabet"]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(filepath, title, body, tokenize='unicode61')")
    for i, t in enumerate(texts):
        db.execute("INSERT INTO f(rowid, filepath, title, body) VALUES (?, ?, ?, ?)", (i, f"p{i % 3}", words[i % 6], t))
    docs = spark.createDataFrame([(i, f"p{i % 3}", words[i % 6], t) for i, t in enumerate(texts)], "doc_id bigint, filepath string, title string, body string")
    columns = {c: F.col(c) for c in ("filepath", "title", "body")}
    asked = {1: ("alpha beta", '"alpha"* AND "beta"*'), 2: ('"beta gamma" -delta', '"beta gamma" NOT "delta"*'), 3: ("alph", '"alph"*')}
    q = spark.createDataFrame([(k, v[0]) for k, v in asked.items()], "query_id bigint, text string")
    found = lexical.search(lexical.parse(q), lexical.postings(docs, columns), lexical.doc_stats(docs, columns), limit=None)
    ours = {(r["query_id"], r["doc_id"]): r["bm25"] for r in found.collect()}
    theirs = {(k, i): round(s, 6) for k, (_, m) in asked.items() for i, s in db.execute("SELECT rowid, bm25(f, 10.0, 1.0) FROM f WHERE f MATCH ?", (m,))}
    assert ours.keys() == theirs.keys()
    assert all(abs(ours[k] - theirs[k]) < 2e-6 for k in ours)


def test_paths_become_handles(spark):
    given_ = ["My File!.MD", "a___b/C d.txt", "🐘 notes.md", "$route.md", "!!!.md", ""]
    rows = spark.createDataFrame([(x,) for x in given_], "p string").select("p", tx.handelize(F.col("p")).alias("h")).collect()
    assert {r["p"]: r["h"] for r in rows} == {"My File!.MD": "my-file.md", "a___b/C d.txt": "a/b/c-d.txt", "🐘 notes.md": "1f418-notes.md", "$route.md": "$route.md", "!!!.md": None, "": None}


def test_links_stay_inside(spark):
    body = "[a](./b.md#x) [[Home]] [[g.md|t]] [x](https://e.com) [e](../../../etc/passwd) [r](/top.md) ```\n[c](c.md)\n```"
    row = spark.createDataFrame([(body, "docs/sub/a.md")], "b string, p string").select(tx.internal_links(F.col("b"), F.col("p")).alias("l")).first()
    assert row["l"] == ["docs/sub/b.md", "top.md", "docs/sub/home.md", "docs/sub/g.md"]


def test_fusion_ranks_and_ties(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query_id int, list_idx int, file string, rank int")
    rows = fusion.rrf(lists, fusion.list_weights(lists, 1)).orderBy("rank").collect()
    assert [r["file"] for r in rows] == ["b", "a", "c"]
    assert abs(rows[0]["score"] - (2 / 62 + 1 / 61 + 0.05)) < 1e-8


def test_rerank_asks_once_and_uses_the_cache(spark):
    pairs = spark.createDataFrame([(1, "x", "red fox", "a red fox"), (1, "y", "red fox", "a red fox"), (1, "z", "red fox", "dog")], "query_id int, file string, query string, chunk string")
    rows = {r["file"]: r["rerank"] for r in fusion.rerank(pairs).collect()}
    assert rows == {"x": 1.0, "y": 1.0, "z": 0.0}


def test_globs():
    import re

    assert re.match(lookup.glob_regex("docs/**/*.md"), "docs/a/b.md") and re.match(lookup.glob_regex("**/x?.{md,txt}"), "x1.txt")
    assert not re.match(lookup.glob_regex("*.md"), "a/b.md")


def test_expansion_scores(spark):
    whole = "Docker is installed on Linux through the package manager of the system."
    rows = [
        (0, "install docker on linux", f'lex: docker "linux install"\nvec: how can docker be installed on a linux machine\nhyde: {whole}'),
        (1, "q", "nonsense"),
        (2, "what is docker", "lex: what is docker\nvec: explain the docker container engine"),
        (3, "docker /only:vec", "lex: docker"),
        (4, None, None),
    ]
    got = {r["i"]: r for r in tr.scored(spark.createDataFrame(rows, "i int, query string, expansion string"), ["i"]).collect()}
    assert got[0]["rating"] == "Excellent" and got[1]["rating"] == "Failed" and got[2]["percentage"] <= 50 and got[3]["total"] == 0
    assert tr.scored(spark.createDataFrame([], "i int, query string, expansion string"), ["i"]).count() == 0


def test_names_in_queries(spark):
    rows = [("Find TDS motorsports team, the C++ for node.js", {"tds", "motorsports", "team", "c++", "node.js"}), ("Bob deploys", {"bob", "deploys"}), ("install a JavaScript", {"javascript"}), ("", set())]
    df = spark.createDataFrame([(q,) for q, _ in rows], "q string").select("q", tr.entities(F.col("q")).alias("n"))
    assert {r["q"]: set(r["n"]) for r in df.collect()} == dict(rows)


def test_streams_equal_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = "tumbling_rows"
    run = events.tumbling(stream, late="1000 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r["start"].replace(tzinfo=None), r["event_type"], r["n"])
    assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, events.tumbling(batch).collect()))


def test_ingest_runs_each_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.parquet_stream(spark, str(tmp_path / "in"), batch.schema)
    seen = []
    run = events.ingest(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
    run.processAllAvailable()
    run.stop()
    assert sum(seen) == batch.count()


def test_words_far_into_a_text_have_vectors(spark):
    from gleanery.functions.providers import Deterministic
    from gleanery.operators import retrieval

    late = "filler " * 3000 + "zebra quagga okapi " * 150
    rows = [(i, "src", f"en/doc_{i}.md", f"h{i}", body, i != 3) for i, body in ((1, late), (2, "filler " * 3000), (3, late), (4, "plain words"))]
    rows.append((5, "src", "en/doc_5.md", "h1", late, True))
    corpus = spark.createDataFrame(rows, "doc_id bigint, collection string, path string, hash string, body string, active boolean")
    queries = spark.createDataFrame([(0, 7, "zebra quagga okapi")], "query_id bigint, list_idx int, text string")
    found = {r["file"]: (r["rank"], r["score"]) for r in retrieval.Corpus(corpus).by_vectors(queries).collect()}
    # the prompts of query and document have words of their own, so even the same words are not at distance 0
    assert found["src/en/doc_1.md"][0] == 1 and found["src/en/doc_5.md"][0] == 2 and found["src/en/doc_1.md"][1] > 0.6 > found["src/en/doc_2.md"][1]
    assert "en/doc_3.md" not in found
    ids = {r["vec_id"] for r in retrieval.chunk_vectors(corpus, Deterministic()).select("vec_id").collect()}
    parts = len(chunking.chunk(late))
    assert parts > 1 and {v for v in ids if v.startswith("h1_")} == {f"h1_{k}" for k in range(parts)}


def test_all_documents_are_diffed(spark, sf):
    from gleanery.plans import lookup as plans

    found = plans.line_diff(spark, sf).select("doc_id")
    assert sorted(found.collect()) == sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
