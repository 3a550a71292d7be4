"""An inverted index that lasts: written once, read by the terms of a query, updated by document.

In a folder, each generation holds postings and gone, the documents whose older generations no longer count. Documents are taken in blocks, each where
it is read. A row of the postings is a term in a block: the number of documents that have it, its greatest frequency and its least length, so that bounds
are read without the lists; then these documents as a list and, packed as bytes (PACKED), their lengths, weighted frequencies and numbers of places, and
of all places together column and position. Rows lie in folders by bucket, a hash of the first two characters of a term, sorted by term. The row without
a term, in bucket -1, holds all documents of a block.
index.json names the generations; it is put in place last, so a generation that was broken off is not part of the index.

A search reads the folders of the buckets that its terms and prefixes can be in, and nothing of the texts. Queries of whole terms alone,
on an index of one generation, read less: the bounds of the blocks say which can hold one of the best. Blocks with the highest bounds
are scored first, twice as many each round, and others only as long as their bound reaches the score of the last place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import lexical
from gleanery.sources.tables import get_state, put_state, removed, written

# A block ends at so many documents or tokens. A generation's tasks take up to MERGED splits of the input each, as long as there are TASKS for each core.
BUCKETS, BLOCK, TOKENS, FIRST, TASKS, MERGED, FEW = 64, 4096, 1 << 21, 2, 4, 8, 500_000
PACKED = {"dl": np.dtype("<i4"), "f": np.dtype("<f8"), "k": np.dtype("<i4"), "col": np.dtype("<i2"), "pos": np.dtype("<i4")}
_ROWS = "term string, block bigint, n bigint, most double, least int, doc_id array<{0}>, " + ", ".join(f"{c} binary" for c in PACKED)
_TABLES = {"postings": f"{_ROWS}, bucket int", "gone": "doc_id {0}"}


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(buckets)).cast("int")


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows and so large a sum of sizes at most, or of one row."""
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def _packed(name: str, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values from each of the ends to the next as bytes."""
    kind = PACKED[name]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _unpacked(name: str, column: pa.Array) -> np.ndarray:
    """The values of all rows of a column together."""
    if not len(column):
        return np.zeros(0, PACKED[name])
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy().view(PACKED[name])


def _inverted(docs: pa.RecordBatch, weights: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block of documents: doc_id, dl and the tokens of each column."""
    ids, texts, n = docs.column(0), docs.columns[2:], len(docs)
    dl = pc.fill_null(docs.column(1), -1).to_numpy(zero_copy_only=False)
    least = np.where(dl < 0, np.iinfo(np.int32).max, dl)
    names = ["term", "block", "n", "most", "least", "doc_id", *PACKED]

    def made(terms: pa.Array, most: np.ndarray, low: np.ndarray, ends: np.ndarray, which: np.ndarray, f: np.ndarray, k: np.ndarray, places: np.ndarray, col: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(which)))
        scalars = [terms, pa.array(np.full(len(terms), block)), pa.array(np.diff(ends)), pa.array(most), pa.array(low, pa.int32()), listed]
        return pa.RecordBatch.from_arrays([*scalars, _packed("dl", dl[which], ends), _packed("f", f, ends), _packed("k", k, ends), _packed("col", col, places), _packed("pos", pos, places)], names)

    none = np.zeros(0)
    yield made(pa.array([None], pa.string()), np.zeros(1), least.min(keepdims=True), np.array([0, n]), np.arange(n), np.zeros(n), np.zeros(n), np.zeros(2, int), none, none)
    # tokens by column, document and place; then by term and document, in which that order stays
    size = [pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False) for t in texts]
    doc = np.concatenate([np.repeat(np.arange(n), s) for s in size])
    if not len(doc):
        return
    col = np.repeat(np.arange(len(texts), dtype=np.int16), [s.sum() for s in size])
    pos = np.concatenate([(np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)).astype(np.int32) for s in size])
    coded = pa.concat_arrays([t.flatten() for t in texts]).dictionary_encode()
    key = coded.indices.to_numpy() * np.int64(n) + doc
    order = np.argsort(key, kind="stable")
    key, col, pos = key[order], col[order], pos[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of a term's places in a document
    f = np.add.reduceat(weights[col], first)
    code, doc = np.divmod(key[first], n)
    top = np.flatnonzero(np.diff(code, prepend=-1))  # of a term's documents
    words = coded.dictionary.take(pa.array(code[top]))
    k, ends, places = np.diff(np.append(first, len(key))), np.append(top, len(code)), np.append(first[top], len(key))
    yield made(words, np.maximum.reduceat(f, top), np.minimum.reduceat(least[doc], top), ends, doc, f, k, places, col, pos)


def _each(rows: DataFrame, places: bool = False) -> DataFrame:
    """Rows of the postings by document: dl and f, or by place: dl, col and pos; with the other columns that there are before doc_id."""
    packed = ["dl", "k", "col", "pos"] if places else ["dl", "f"]
    kept = rows.columns[: rows.columns.index("doc_id")]
    rows = rows.select(*kept, "doc_id", *packed)
    kind = rows.schema["doc_id"].dataType.elementType.simpleString()
    out = [c for c in packed if c != "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            sizes = pc.binary_length(batch.column("pos")) if places else pc.list_value_length(lists)
            for some in _slices(batch, sizes.to_numpy(zero_copy_only=False), 1 << 16, 1 << 20):
                lists = some.column(len(kept))
                of = np.repeat(np.arange(len(some)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                got, ids = {c: _unpacked(c, some.column(c)) for c in packed}, lists.flatten()
                if places:
                    which = np.repeat(np.arange(len(of)), got["k"])
                    of, ids, got["dl"] = of[which], ids.take(pa.array(which)), got["dl"][which]
                made = {c: pa.array(got[c], mask=got[c] < 0 if c == "dl" else None) for c in out}
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([*[some.column(i).take(at) for i in range(len(kept))], ids, *made.values()], [*kept, "doc_id", *out])

    kinds = {"dl": "int", "f": "double", "col": "smallint", "pos": "int"}
    return rows.mapInArrow(run, ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"doc_id {kind}"] + [f"{c} {kinds[c]}" for c in out]))


def _postings(docs: DataFrame, columns: dict[str, Column], stemmed: bool, weights: dict[str, float]) -> DataFrame:
    """The rows of the postings but for the bucket; a block at a time, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    most, size, weight = BLOCK, TOKENS, np.array([weights.get(c, 1.0) for c in columns], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in _slices(batch, pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False), most, size):
                yield from _inverted(block, weight, at)
                at += 1

    assert columns
    tokens = [F.get("cols", F.lit(i))["terms"].alias(f"_{i}") for i in range(len(columns))]
    return lexical.tokenized(docs, columns, stemmed).select("doc_id", "dl", *tokens).mapInArrow(run, _ROWS.format(kind))


def _known(gone: DataFrame) -> DataFrame:
    """Rows by document, marked for broadcast where there are few, so that postings are not shuffled to meet them."""
    return F.broadcast(gone) if gone.count() <= FEW else gone


class TextIndex:
    """The index of a folder. columns makes the texts of documents (with doc_id) that come in; it is the same for all of them."""

    def __init__(self, spark: SparkSession, root: str, columns: dict[str, Column], stemmed: bool = True, weights: dict[str, float] | None = None):
        self.spark, self.root, self.columns, self.stemmed = spark, root.rstrip("/"), columns, stemmed
        self.weights = weights or lexical.WEIGHTS

    def _state(self) -> dict:
        return get_state(self.spark, f"{self.root}/index.json") or {"generations": [], "next": 0, "buckets": BUCKETS, "kind": "bigint"}

    def build(self, docs: DataFrame, buckets: int = BUCKETS) -> TextIndex:
        """The index of these documents alone."""
        state = self._state()
        self._add(dict(state, generations=[], buckets=buckets, kind=docs.schema["doc_id"].dataType.simpleString()), docs, None)
        for number in state["generations"]:
            removed(self.spark, f"{self.root}/gen-{number}")
        return self

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """Documents that come in or have changed, and ids (doc_id) of those that have gone; what is written grows with these."""
        ids = docs.select("doc_id") if gone is None else docs.select("doc_id").unionByName(gone.select("doc_id"))
        self._add(dict(self._state(), kind=docs.schema["doc_id"].dataType.simpleString()), docs, ids.distinct())
        return self

    def _add(self, state: dict, docs: DataFrame, gone: DataFrame | None) -> None:
        number = state["next"]
        place = f"{self.root}/gen-{number}"
        # each task writes the postings of its documents; few large tasks make few files
        tasks, cores = docs.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism
        some = docs.coalesce(max(TASKS * cores, -(-tasks // MERGED))) if tasks > TASKS * cores else docs
        rows = _postings(some, self.columns, self.stemmed, self.weights)
        rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), state["buckets"])))
        rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/postings")
        (docs.select("doc_id").limit(0) if gone is None else gone).write.mode("overwrite").parquet(f"{place}/gone")
        put_state(self.spark, f"{self.root}/index.json", dict(state, generations=[*state["generations"], number], next=number + 1))

    def _read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name].format(self._state()["kind"])).parquet(f"{self.root}/gen-{number}/{name}")

    def _table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of all generations, with the generation; postings of terms, or of some buckets."""
        out = None
        for number in self._state()["generations"]:
            rows = self._read(number, name)
            if name == "postings":
                rows = rows.where(F.col("bucket") >= 0 if buckets is None else F.col("bucket").isin(buckets))
            rows = rows.withColumn("generation", F.lit(number))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _left(self, rows: DataFrame) -> DataFrame:
        """Rows of generation, doc_id and more, without documents that a later generation has taken away."""
        generations = self._state()["generations"]
        if len(generations) < 2:
            return rows
        gone = None
        for number in generations[1:]:
            ids = self._read(number, "gone").select("doc_id", F.lit(number).alias("last"))
            gone = ids if gone is None else gone.unionByName(ids)
        return rows.join(_known(gone.groupBy("doc_id").agg(F.max("last").alias("last"))), "doc_id", "left").where("last is null or generation >= last").drop("last")

    def totals(self) -> tuple[int, float]:
        """Number of documents and their average length."""
        row = self._left(_each(self._table("postings", [-1]).select("generation", "doc_id", "dl", "f"))).agg(F.count("*"), F.avg("dl")).first()
        return row[0], row[1] or 0.0

    def vocabulary(self) -> DataFrame:
        """term and df of every term; of an index of several generations from its lists."""
        posts = self._table("postings")
        if len(self._state()["generations"]) == 1:
            return posts.groupBy("term").agg(F.sum("n").alias("df"))
        return self._left(posts.select("generation", "term", F.explode("doc_id").alias("doc_id"))).groupBy("term").agg(F.count("*").alias("df"))

    def _buckets(self, parsed: DataFrame) -> list[int] | None:
        """The buckets in which terms of the queries can be; None for all, where a prefix is one character long."""
        n = self._state()["buckets"]
        terms = parsed.select("prefix", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
        open_ = F.col("prefix") & (F.col("at") == F.col("n") - 1)
        found = terms.select(F.when(open_ & (F.length("term") < 2), -1).otherwise(bucket_of(F.col("term"), n)).alias("b")).distinct().collect()
        wanted = sorted(r["b"] for r in found)
        return None if -1 in wanted else wanted

    def parse(self, queries: DataFrame) -> DataFrame:
        return lexical.parse(queries, self.stemmed)

    def search(self, parsed: DataFrame, limit: int = 20) -> DataFrame:
        """query_id, doc_id, bm25, score and rank, as lexical.search() over the same documents gives them."""
        state = self._state()
        parsed = written(parsed, "parsed")
        if not state["generations"]:
            return lexical.ranked_scores(parsed.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0.0).alias("bm25")).limit(0), limit)
        rows, avgdl = self.totals()
        if len(state["generations"]) > 1:
            return self._full(parsed, rows, avgdl, limit)
        whole = parsed.groupBy("query_id").agg(F.bool_and((F.size("terms") == 1) & ~F.col("prefix") & ~F.col("negated")).alias("whole"))
        parsed = written(parsed.join(whole, "query_id"), "parsed")
        pruned, full = parsed.where("whole").drop("whole"), parsed.where("not whole").drop("whole")
        found = None
        if not full.isEmpty():
            found = self._full(full, rows, avgdl, limit)
        if found is None or not pruned.isEmpty():
            best = self._pruned(pruned, rows, avgdl, limit)
            found = best if found is None else found.unionByName(best)
        return found

    def _full(self, parsed: DataFrame, rows: int, avgdl: float, limit: int) -> DataFrame:
        posts = self._table("postings", self._buckets(parsed)).select("generation", "term", "doc_id", *PACKED)
        # the few words asked for are sent to the rows; the terms that they stand for grow with the index
        wanted, sizes = lexical.keys_of(parsed)
        met = lambda some: lexical.keyed(posts, sizes).join(some, ["size", "key"])
        single = self._left(_each(met(wanted.where("n = 1").select("phrase_id", "size", "key")).select("phrase_id", "generation", "doc_id", *PACKED)))
        single = single.groupBy("phrase_id", "doc_id").agg(F.sum("f").alias("f"), F.any_value("dl").alias("dl"))
        placed = _each(met(wanted.where("n > 1")).select("phrase_id", "n", "at", "generation", "doc_id", *PACKED), places=True)
        placed = placed.withColumn("start", F.col("pos") - F.col("at"))
        hits = self._left(placed).groupBy("phrase_id", "n", "doc_id", "dl", "col", "start").agg(F.count("at").alias("k")).where("k = n")
        weight = F.array(*[F.lit(float(self.weights.get(c, 1.0))) for c in self.columns])
        several = hits.groupBy("phrase_id", "doc_id").agg(F.sum(F.get(weight, F.col("col").cast("int"))).alias("f"), F.any_value("dl").alias("dl"))
        f = written(single.unionByName(several.select(*single.columns)), "hits")
        return lexical.scored(parsed, f, rows, avgdl, limit)

    def _pruned(self, parsed: DataFrame, rows: int, avgdl: float, limit: int) -> DataFrame:
        """Queries of whole terms: blocks by their bounds."""
        buckets = self._buckets(parsed)
        asked = parsed.select("query_id", "phrase", F.col("terms")[0].alias("term"))
        bounds = self._table("postings", buckets).select("term", "block", "n", "most", "least").join(asked.select("term").distinct(), "term", "left_semi")
        idf = lexical.idf_of(F.lit(float(rows)), F.col("df"))
        terms = written(bounds.groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", idf), "terms")
        n = asked.groupBy("query_id").agg(F.count("*").alias("phrases"))
        each = asked.join(terms, "term").join(bounds, "term").withColumn("s", lexical.part_of(F.col("idf"), F.col("most"), F.col("least"), F.lit(avgdl)))
        bound = each.groupBy("query_id", "block").agg(F.sum("s").alias("bound"), F.count("*").alias("k")).join(n, "query_id").where("k = phrases").select("query_id", "block", "bound")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        bound = written(bound.withColumn("turn", F.row_number().over(order)), "bounds")

        def scores(some: DataFrame) -> DataFrame:
            wanted = asked.join(terms, "term").join(n, "query_id").join(some, "query_id").select("query_id", "phrase", "term", "idf", "phrases", "block")
            # postings are cut down to the blocks that are asked for before they are moved
            need = lexical._sized(wanted.select("term", "block").distinct(), "need")
            posts = _each(self._table("postings", buckets).join(need, ["term", "block"], "left_semi").select("term", "block", "doc_id", *PACKED))
            one = lexical.part_of(F.col("idf"), F.col("f"), F.col("dl"), F.lit(avgdl))
            parts = posts.join(wanted, ["term", "block"]).groupBy("query_id", "phrases", "doc_id").agg((-F.sum(one)).alias("bm25"), F.count("*").alias("k"))
            return parts.where("k = phrases").select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))

        best = Window.partitionBy("query_id").orderBy("bm25", "doc_id")
        found, low, step, read = None, 0, FIRST, 0
        while True:
            some = bound.where((F.col("turn") > low) & (F.col("turn") <= low + step))
            if found is not None:
                last = found.where(F.col("_r") == limit).select("query_id", F.col("bm25").alias("last"))
                some = some.join(last, "query_id", "left").where(F.col("last").isNull() | (F.round(-F.col("bound"), 6) <= F.col("last")))
            some = written(some.select("query_id", "block"), "open")
            n_open = some.count()
            if not n_open and found is not None:  # later blocks have lower bounds still
                break
            read += n_open
            every = scores(some) if found is None else found.drop("_r").unionByName(scores(some))
            found = written(every.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit), "best")
            low, step = low + step, 2 * step
        self.read_blocks = (bound.count(), read)
        return lexical.ranked_scores(found.drop("_r"), limit)
