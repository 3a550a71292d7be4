import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.providers import Deterministic, hash_embedding
from gleanery.operators import retrieval, vectors

FILES = "doc_id bigint, collection string, path string, hash string, body string, active boolean"


def corpus_of(spark, texts, **more):
    rows = [(i, "c", f"d/{name}.md", f"{i:064x}", body, name != "gone") for i, (name, body) in enumerate(texts.items())]
    return retrieval.Corpus(spark.createDataFrame(rows, FILES), **more)


TEXTS = {
    "docker": "# Docker\nInstall docker on linux with the package manager and start the service.",
    "kubernetes": "# Kubernetes\nA cluster runs containers of docker images and schedules them.",
    "garden": "# Garden\nTomatoes need sun, water and warm soil.",
    "gone": "Install docker on linux, said the inactive file.",
    "empty": "",
}


def queries_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_hybrid_finds_active_files_with_snippets(spark):
    rows = retrieval.hybrid(queries_of(spark, "install docker", "warm soil"), corpus_of(spark, TEXTS)).collect()
    first = {r["query_id"]: r for r in rows if r["place"] == 1}
    assert first[0]["file"] == "c/d/docker.md" and first[1]["file"] == "c/d/garden.md" and "docker" in first[0]["snippet"].lower()
    assert not {r["file"] for r in rows} & {"c/d/gone.md"} and all(r["docid"] == "0" * 6 for r in rows)


def test_the_graph_adds_neighbours(spark):
    corpus = corpus_of(spark, TEXTS)
    edges = spark.createDataFrame([("c", "d/docker.md", "d/garden.md")], "collection string, source_path string, target_path string")
    files = lambda e: {r["file"] for r in retrieval.hybrid(queries_of(spark, '"install docker"'), corpus, e, candidates=1).collect()}
    assert files(None) == {"c/d/docker.md"} and files(edges) == {"c/d/docker.md", "c/d/garden.md"}


def test_providers_are_used(spark):
    class Other(Deterministic):
        """Expands every query to the garden and likes short texts."""

        def expand(self, query):
            return f"lex: tomatoes\nvec: tomatoes in warm soil beside {query}\nlex: {query} tomatoes"

        def rerank(self, query, texts):
            return [1.0 if "Tomatoes" in t else 0.0 for t in texts]

    query = queries_of(spark, "how to install docker on linux machines")
    plain = retrieval.hybrid(query, corpus_of(spark, TEXTS)).collect()
    other = retrieval.hybrid(query, corpus_of(spark, TEXTS, provider=Other())).collect()
    score = lambda rows: {r["file"]: r["score"] for r in rows}
    assert score(other)["c/d/garden.md"] > score(plain).get("c/d/garden.md", 0)


def test_structured_takes_each_line_by_its_type(spark):
    corpus = corpus_of(spark, TEXTS)
    words = retrieval.structured(queries_of(spark, "lex: tomatoes\nwhatever"), corpus).collect()
    assert [r["file"] for r in words] == ["c/d/garden.md"]
    both = retrieval.structured(queries_of(spark, "lex: tomatoes\nvec: docker cluster"), corpus).collect()
    assert {"c/d/garden.md", "c/d/kubernetes.md"} <= {r["file"] for r in both}
    assert retrieval.structured(queries_of(spark, "no type here"), corpus).count() == 0


def test_equal_paths_of_two_collections_are_two_files(spark):
    rows = [(1, "a", "d/x.md", "1" * 64, "Install docker on linux now.", True), (2, "b", "d/x.md", "2" * 64, "Docker runs in a cluster of machines.", True)]
    out = retrieval.hybrid(queries_of(spark, "docker", "linux"), retrieval.Corpus(spark.createDataFrame(rows, FILES))).collect()
    found = {(r["query_id"], r["file"]): (r["docid"], r["snippet"]) for r in out}
    assert len(found) == len(out) and {f for q, f in found if q == 0} == {"a/d/x.md", "b/d/x.md"}
    assert found[0, "a/d/x.md"][0] == "1" * 6 and "Install" in found[0, "a/d/x.md"][1] and found[0, "b/d/x.md"][0] == "2" * 6 and "cluster" in found[0, "b/d/x.md"][1]
    assert next(r["file"] for r in out if r["query_id"] == 1 and r["place"] == 1) == "a/d/x.md"


def test_words_meet_by_their_stems(spark):
    texts = {"a": "She was running home.", "b": "Connections of cafés", "c": "They run daily", "d": "nothing here"}
    corpus = corpus_of(spark, texts)
    asked = spark.createDataFrame([(0, 0, "running"), (1, 0, "connected"), (2, 0, "CAFE"), (3, 0, '"running homes"'), (4, 0, "runs -home")], "query_id bigint, list_idx int, text string")
    found = {}
    for r in corpus.by_words(asked).collect():
        found.setdefault(r["query_id"], set()).add(r["file"])
    assert found == {0: {"c/d/a.md", "c/d/c.md"}, 1: {"c/d/b.md"}, 2: {"c/d/b.md"}, 3: {"c/d/a.md"}, 4: {"c/d/c.md"}}


def test_stemmed_scores_equal_sqlite(spark, sf):
    import sqlite3

    from gleanery.operators import lexical

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='porter unicode61')")
    base.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", [(r["doc_id"] + 1, r["text"]) for r in docs.collect()])
    words = ["running", "thinking and", "tions", '"of the"', "ation", "onthe", "les élève"]
    q = spark.createDataFrame(list(enumerate(words)), "query_id bigint, text string")
    ours = {}
    for r in lexical.search(lexical.parse(q, stemmed=True), *lexical.index(docs, {"body": F.col("text")}, stemmed=True), limit=None).collect():
        ours.setdefault(r["query_id"], {})[r["doc_id"]] = r["bm25"]
    for i, text in enumerate(words):
        match = text if text.startswith('"') else " ".join(f'"{w}"*' for w in text.split())
        theirs = {i - 1: s for i, s in base.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert ours.get(i, {}) == pytest.approx(theirs, abs=2e-6), text


def test_empty_corpus_and_queries(spark):
    corpus = corpus_of(spark, TEXTS)
    assert retrieval.hybrid(queries_of(spark, "x").limit(0), corpus).count() == 0
    assert retrieval.hybrid(queries_of(spark, "x"), corpus_of(spark, {"gone": "x"})).count() == 0


@pytest.mark.parametrize("k", [1, 7])
def test_vectors_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    q = v.where("vec_id % 50 = 1").withColumnRenamed("vec_id", "query_id")
    size = lambda a: np.sqrt((a * a).sum())
    for found, pick in ((vectors.exact(q, v, k), None), (vectors.fanout(q, v, 1, k), None)):
        mine = {}
        for r in found.collect():
            mine.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["vec_id"])
        for i, got in mine.items():
            a = np.array(dict(rows)[i])
            want = []
            for j, b in rows:
                if b is not None:
                    b, n = np.array(b), min(len(a), len(b))
                    s = size(a) * size(b)
                    want.append((round(float(np.clip(1 - a[:n] @ b[:n] / s, 0, 2)) if s > 1e-9 else 1.0, 6), j))
            assert [got[p][1] for p in range(1, k + 1)] == [j for _, j in sorted(want)[:k]] and pick is None


def test_queries_in_blocks_give_what_all_at_once_give(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, f"g{i % 7}", x.tolist()) for i, x in enumerate(rng.normal(size=(150, 4)))], "vec_id bigint, g string, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    centres, members = vectors.ivf_build(v, 8)
    every = lambda: [sorted(map(tuple, df.collect())) for df in (vectors.exact(q, v, 3), vectors.fanout(q, v, 4, 3), vectors.ivf_search(q, members, centres, 3, 3), vectors.by_group(q, v, "g").select("query_id", "g", "n", F.round("total", 6), "least"))]
    whole = every()
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 40 * 4 * 8)
    assert every() == whole and len(whole[0]) == 450


def test_many_queries_are_answered(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 2))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id bigint, embedding array<double>")
    v = q.where("query_id < 50").withColumnRenamed("query_id", "vec_id")
    assert vectors.exact(q, v, 1).count() == 20_000


def test_probing_all_centroids_is_exact(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 6)))], "vec_id bigint, embedding array<double>")
    q = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    centres, members = vectors.ivf_build(v, 8)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect())
    assert rows(vectors.ivf_search(q, members, centres, 10, probes=8)) == rows(vectors.exact(q, v, 10))
    some = vectors.recall(vectors.ivf_search(q, members, centres, 10, probes=3), vectors.exact(q, v, 10)).first()["recall"]
    assert 0.3 < some <= 1
    probes = vectors.calibrated(v, members, centres, 10)
    assert 3 < probes <= 8 and vectors.recall(vectors.ivf_search(q, members, centres, 10, probes=probes), vectors.exact(q, v, 10)).first()["recall"] >= 0.9
    assert hash_embedding([""]).shape == (1, 64)


def test_recall_of_the_queries(spark, sf):
    from gleanery.plans.registry import queries

    assert queries()["ivf_recall"](spark, sf).first()["recall"] >= 0.9
