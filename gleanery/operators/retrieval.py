"""Retrieval from end to end over a batch of queries: lists by words and by vectors, fusion, graph, chunks, rerank, blend, snippets.

A corpus is a table of files (doc_id, collection, path, hash, body, active); a file is named by its collection and path
(`file`: collection/path, collections hold no slash), in lists, chunks and results alike. Vectors are those of its chunks
(vec_id: hash_seq, embedding), written by whoever indexes. Models are those of a provider; the default is
deterministic and needs no network.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.functions.providers import Deterministic, ModelProvider
from gleanery.operators import chunking, content, fusion, lexical, vectors
from gleanery.sources.tables import spread, written

# Fixed value: the model whose prompts are put before texts.
MODEL = "embeddinggemma"
LIST = 20


def embedded(rows: DataFrame, key: str, text: str, provider: ModelProvider) -> DataFrame:
    """key and embedding, in Arrow batches; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": list(provider.embed(list(b[text].fillna(""))))})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def chunk_vectors(corpus: DataFrame, provider: ModelProvider, model: str = MODEL) -> DataFrame:
    """vec_id (hash_seq) and embedding of every chunk of every content of active files, with its title and prompt; equal contents are embedded once, under the title of the first path."""
    active = corpus.where("active and hash is not null").select("hash", "body", "path")
    contents = active.groupBy("hash").agg(F.min_by(F.struct("body", "path"), "path").alias("c")).select("hash", "c.body", tx.stem_of(F.col("c.path")).alias("title"))
    parts = chunking.chunks(contents.select("hash", "body"), "hash", "body").join(contents.select("hash", "title"), "hash")
    said = vectors.format_document(F.col("text"), F.col("title"), F.lit(model))
    return embedded(parts.select(F.concat_ws("_", "hash", "seq").alias("vec_id"), said.alias("text")), "vec_id", "text", provider)


class Corpus:
    """What searches over a corpus share: postings and vectors, each written once, and the active files."""

    def __init__(self, files: DataFrame, vectors_: DataFrame | None = None, provider: ModelProvider | None = None):
        self.provider = provider or Deterministic()
        self.files = files.where("active").withColumn("file", F.concat_ws("/", "collection", "path"))
        columns = {"filepath": F.col("file"), "title": tx.stem_of(F.col("path")), "body": F.col("body")}
        self.posts, self.stats = lexical.index(self.files, columns, stemmed=True)
        self.vectors = vectors_ if vectors_ is not None else written(chunk_vectors(files, self.provider), "vectors")

    def by_words(self, asked: DataFrame, limit: int = LIST) -> DataFrame:
        """query_id, list_idx, file, rank and score for each list (query_id, list_idx, text)."""
        named = asked.withColumn("q", F.struct("query_id", "list_idx")).select(F.to_json("q").alias("query_id"), "text")
        hits = lexical.search(lexical.parse(named, stemmed=True), self.posts, self.stats, limit=limit).join(self.files.select("doc_id", "file"), "doc_id")
        return _of_lists(hits, asked)

    def by_vectors(self, asked: DataFrame, limit: int = LIST) -> DataFrame:
        """The same by vectors: a file counts by its nearest chunk among the three times `limit` nearest."""
        named = asked.withColumn("q", F.struct("query_id", "list_idx")).select(F.to_json("q").alias("query_id"), vectors.format_query(F.col("text"), F.lit(MODEL)).alias("text"))
        near = vectors.exact(written(embedded(named, "query_id", "text", self.provider), "asked"), self.vectors, 3 * limit)
        owners = self.files.select(F.col("hash").alias("vec_id"), "file")
        return _of_lists(vectors.to_documents(near.withColumn("vec_id", F.substring_index("vec_id", "_", 1)), owners, limit), asked)

    def lists(self, asked: DataFrame, limit: int = LIST) -> DataFrame:
        """Lists of all types: lex by words, vec and hyde by vectors."""
        return self.by_words(asked.where("type = 'lex'"), limit).unionByName(self.by_vectors(asked.where("type <> 'lex'"), limit))


def _of_lists(hits: DataFrame, asked: DataFrame) -> DataFrame:
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, list_idx int"
    return hits.withColumn("q", F.from_json("query_id", kind)).select("q.query_id", "q.list_idx", "file", "rank", "score")


def generated(queries: DataFrame, provider: ModelProvider) -> DataFrame:
    """query_id and the provider's expansion, as lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "text": [provider.expand(q or "") for q in b["text"]]})

    return queries.select("query_id", "text").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, text string")


def _scorer(provider: ModelProvider):
    """None for the default, whose scores are column expressions."""
    if type(provider) is Deterministic:
        return None

    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=queries.index)
        for query, at in queries.groupby(queries).groups.items():
            out[at] = provider.rerank(query, list(texts[at]))
        return out

    return score


def finished(lists: DataFrame, queries: DataFrame, corpus: Corpus, doubled: int, edges: DataFrame | None = None, candidates: int = 40, least: float = 0.0, limit: int = 10) -> DataFrame:
    """query_id, place, file, docid, score and snippet from lists: fusion, neighbours in the graph of links, best chunks, rerank, blend, the first `limit` of least score."""
    found = written(lists, "lists")
    fused = fusion.top(fusion.rrf(found, fusion.list_weights(found, doubled)), candidates)
    if edges is not None:
        seeds = fused.join(corpus.files.select("collection", "path", "file"), "file").select("query_id", "collection", "path")
        near = content.neighbours(edges, seeds, corpus.files).select("query_id", F.concat_ws("/", "collection", "path").alias("file"))
        fused = fusion.with_neighbours(fused, near)
    fused = written(fused, "fused")
    wanted = spread(corpus.files).join(fused.select("file").distinct(), "file", "left_semi")
    parts = chunking.chunks(wanted.select("file", "body"), "file", "body")
    parts = written(parts, "chunks")
    best = fusion.best_chunk(fused, parts, queries).select("query_id", "file", F.col("text").alias("chunk"))
    pairs = written(best.join(queries.select("query_id", F.col("text").alias("query")), "query_id"), "pairs")
    scored = fusion.rerank(pairs, scorer=_scorer(corpus.provider)).select("query_id", "file", "rerank")
    blended = fused.join(scored, ["query_id", "file"]).withColumn("score", F.round(fusion.blend(F.col("rank"), F.col("rerank")), 6))
    top = fusion.final(blended.select("query_id", "file", "score"), least, limit)
    said = top.join(pairs, ["query_id", "file"]).join(corpus.files.select("file", F.substring("hash", 1, 6).alias("docid")), "file")
    return said.select("query_id", "place", "file", "docid", "score", tx.snippet_text(tx.snippet(F.col("chunk"), F.col("query"))).alias("snippet"))


def _numbered(rows: DataFrame, first: int, order: list[str]) -> DataFrame:
    at = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("list_idx", (F.row_number().over(at) + F.lit(first - 1)).cast("int"))


def hybrid(queries: DataFrame, corpus: Corpus, edges: DataFrame | None = None, candidates: int = 40, least: float = 0.0, limit: int = 10) -> DataFrame:
    """Results of queries (query_id, text): see finished().

    List 0 is the query by words. Unless that is a strong signal, the query is expanded: lex lines are lists by
    words, vec and hyde lines lists by vectors after the query's own. The first two lists that hold anything count double.
    """
    probe = written(corpus.by_words(queries.select("query_id", F.lit(0).alias("list_idx"), "text")), "probe")
    strong = lexical.strong_signal(probe).where("strong").select("query_id")
    weak = written(queries.select("query_id", "text").join(strong, "query_id", "left_anti"), "weak")
    more = written(fusion.expansion(weak, generated(weak, corpus.provider)), "expanded")
    lex = _numbered(more.where("type = 'lex'"), 1, ["text"]).select("query_id", "list_idx", "type", "text")
    own = queries.select("query_id", F.lit(1000).alias("list_idx"), F.lit("vec").alias("type"), "text")
    vec = _numbered(more.where("type <> 'lex'"), 1001, ["type", "text"]).select("query_id", "list_idx", "type", "text")
    return finished(probe.unionByName(corpus.lists(lex.unionByName(own).unionByName(vec))), queries, corpus, 2, edges, candidates, least, limit)


def structured(queries: DataFrame, corpus: Corpus, candidates: int = 40, least: float = 0.0, limit: int = 10) -> DataFrame:
    """Results of queries (query_id, text) of typed lines, lex: by words, vec: and hyde: by vectors, in their order; the first list counts double, its text is what chunks are picked and reranked by. Other lines are passed over."""
    lines = fusion.structured(queries).where("type <> ''")
    asked = written(lines.select("query_id", F.col("line").cast("int").alias("list_idx"), "type", "text"), "asked")
    first = asked.groupBy("query_id").agg(F.min_by("text", "list_idx").alias("text"))
    return finished(corpus.lists(asked), first, corpus, 1, None, candidates, least, limit)


