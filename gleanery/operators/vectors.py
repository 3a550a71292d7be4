"""Exact and cluster-pruned nearest neighbours by cosine, shards and their states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.tables import folder, ranked, written


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """To unit length; a vector of length zero or not a number stays."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n), F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column, eps: float = 1e-9) -> Column:
    n = norm(a) * norm(b)
    return F.when(n <= eps, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / n)))


BLOCK_BYTES, MOST_CENTROIDS = 32 << 20, 4096


def _rows(column) -> np.ndarray:
    """Vectors of an Arrow column as a matrix of doubles; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(column):
        return np.zeros((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == sizes[0]).all():
        return flat.reshape(len(column), -1)
    out = np.zeros((len(column), sizes.max()))
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def _collected(rows: DataFrame, key: str, *more: str) -> tuple:
    """Keys and vectors of a table whose size the caller has bounded, and some more columns as lists, smallest key first."""
    found = rows.where("embedding is not null").select(key, "embedding", *more).orderBy(key).toArrow()
    return found[key].to_pylist(), _rows(found["embedding"]), *(found[c].to_pylist() for c in more)


def _by_blocks(queries: DataFrame, search: Callable[..., DataFrame], *more: str) -> DataFrame:
    """search(names, vectors, *more columns) of all queries (query_id, embedding): at once where their vectors take BLOCK_BYTES at most, else
    block by block of that size, the results of each written before the next is taken; so no number of queries is too large."""
    rows = queries.where("embedding is not null").select("query_id", "embedding", *more)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n * width * 8 <= BLOCK_BYTES:
        return search(*_collected(rows, "query_id", *more))
    most = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    block = F.floor(F.col("_at") / most).cast("int")
    dealt = written(ranked(rows, "query_id", name="queries").select(block.alias("block"), "query_id", "embedding", *more), "blocks", ["block"])
    path, schema = folder(queries.sparkSession, "answers"), None
    for number in range(-(-n // most)):
        part = search(*_collected(dealt.where(F.col("block") == number), "query_id", *more))
        part.write.mode("append").parquet(path)
        schema = part.schema
    return queries.sparkSession.read.schema(schema).parquet(path)


def _distances(a: np.ndarray, b: np.ndarray, digits: int) -> np.ndarray:
    """Cosine distances of all rows of a to all of b, over the shorter length; 1 where a length is next to nothing."""
    n = min(a.shape[1], b.shape[1])
    size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.clip(1 - (a[:, :n] @ b[:, :n].T) / size, 0.0, 2.0)
    return np.round(np.where(size <= 1e-9, 1.0, far), digits)


# Distances that a task holds at once, and candidates that wait to be settled.
HELD = 1 << 21


class _Nearest:
    """The k nearest of each query so far, ties to the smaller id: flat arrays, settled whenever as many candidates wait as are held."""

    def __init__(self, queries: int, k: int):
        self.k, self.edge = k, np.full(queries, np.inf)
        self.row, self.far, self.ids = np.zeros(0, np.int32), np.zeros(0), None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, far: np.ndarray, ids: np.ndarray, open_: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """Distances of all queries (or those in which) to some ids; open_ tells which of them count."""
        edge = self.edge if which is None else self.edge[which]
        if far.shape[1] > self.k and far.shape[0]:
            seen = far if open_ is None else np.where(open_, far, np.inf)
            edge = np.minimum(edge, np.partition(seen, self.k - 1, axis=1)[:, self.k - 1])
        hit = ~(far > edge[:, None])
        if open_ is not None:
            hit &= open_
        row, at = np.nonzero(hit)
        self.waiting.append(((row if which is None else which[row]).astype(np.int32), far[row, at], ids[at]))
        self.count += len(row)
        if self.count > max(HELD, len(self.row)):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        parts = self.waiting if self.ids is None else [(self.row, self.far, self.ids), *self.waiting]
        row, far, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        name = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((name, far, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.k]
        self.edge[row[place == self.k - 1]] = far[order[place == self.k - 1]]
        # a distance that is no number is the last of all
        self.edge[np.isnan(self.edge)] = np.inf
        self.row, self.far, self.ids = row[place < self.k], far[kept], ids[kept]
        self.waiting, self.count = [], 0


def _searched(vectors: DataFrame, names: list, asked: np.ndarray, k: int, query_type: str, part: Column | None = None, probed: np.ndarray | None = None, own: np.ndarray | None = None) -> DataFrame:
    """query_id, part, vec_id and distance: the k nearest within each task (and part). Vectors meet the queries in slices of HELD distances, as one product of matrices; no pair leaves a task but these.

    probed[i, p] tells whether query i looks at part p; own[i] is the only part that query i looks at.
    """
    step = max(1, HELD // max(len(names), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        kind = None
        mine = {int(p): np.flatnonzero(own == p) for p in np.unique(own)} if own is not None else {}
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)) if names else ():
            kind = batch.schema.field(0).type
            ids = batch.column(0).to_numpy(zero_copy_only=False) if pa.types.is_integer(kind) and not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
            parts, x = batch.column(2).to_numpy(), _rows(batch.column(1))
            if own is not None:
                for p in np.unique(parts).tolist():
                    if p in mine:
                        there = parts == p
                        held.setdefault(-1, _Nearest(len(names), k)).add(_distances(asked[mine[p]], x[there], 6), ids[there], which=mine[p])
                continue
            far = _distances(asked, x, 6)
            for p in np.unique(parts) if probed is None else [-1]:
                there = parts == p if probed is None else slice(None)
                held.setdefault(int(p), _Nearest(len(names), k)).add(far[:, there], ids[there], None if probed is None else probed[:, parts])
        queries = pa.array(names, pa.int64() if query_type == "bigint" else None)
        for p, best in held.items():
            best.settle()
            for at in range(0, len(best.row), 1 << 16):
                row = best.row[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(row)), pa.array(np.full(len(row), p, np.int64)), pa.array(best.ids[at : at + len(row)], kind), pa.array(best.far[at : at + len(row)])], ["query_id", "part", "vec_id", "distance"])

    rows = vectors.where("embedding is not null").select("vec_id", "embedding", (F.lit(0) if part is None else part).cast("bigint").alias("part"))
    return rows.mapInArrow(run, f"query_id {query_type}, part bigint, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, distance double")


def nearest(pairs: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy("distance", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance and rank: the k nearest of each query, ties to the smaller id."""
    kind = queries.schema["query_id"].dataType.simpleString()
    return _by_blocks(queries, lambda names, asked: nearest(_searched(vectors, names, asked, k, kind).select("query_id", "vec_id", "distance"), k))


def of_scope(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """exact() of each query among the vectors of its own scope, a column of both; scopes are told by 64 bits of hash, no scope is none of others."""
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = vectors.where("scope is not null")

    def search(names: list, asked: np.ndarray, own: list) -> DataFrame:
        found = _searched(rows, names, asked, k, kind, F.xxhash64("scope"), own=np.array(own, np.int64))
        return nearest(found.select("query_id", "vec_id", "distance"), k)

    return _by_blocks(queries.where("scope is not null").withColumn("own", F.xxhash64("scope")), search, "own")


def by_group(queries: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """query_id, group, n, total and least of the distances of each query to all vectors of each group; a task sums up what it has seen, no distance leaves it alone."""
    query_kind, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[group].dataType.simpleString()
    schema = f"query_id {query_kind}, `{group}` {kind}, n bigint, total double, least double"

    def search(names: list, asked: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            types = None

            def flushed() -> pa.RecordBatch:
                keys = list(held)
                parts = [np.concatenate([held[g][i] for g in keys]) for i in range(3)]
                which = [g for g in keys for _ in names]
                out = [pa.array(names * len(keys), pa.int64() if query_kind == "bigint" else None), pa.array(which, types), pa.array(parts[0].astype(np.int64)), pa.array(parts[1]), pa.array(parts[2])]
                held.clear()
                return pa.RecordBatch.from_arrays(out, ["query_id", group, "n", "total", "least"])

            for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
                types = batch.schema.field(0).type
                values, own = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
                order = np.argsort(own, kind="stable")
                starts = np.searchsorted(own[order], np.arange(len(values)))
                far = _distances(asked, _rows(batch.column(1)), 6)[:, order]
                sums, least, n = np.add.reduceat(far, starts, 1), np.minimum.reduceat(far, starts, 1), np.diff(np.append(starts, len(order)))
                for i, value in enumerate(values.tolist()):
                    a, b, c = held.get(value, (0, 0.0, np.inf))
                    held[value] = (a + np.full(len(names), n[i]), b + sums[:, i], np.minimum(c, least[:, i]))
                if len(held) * len(names) > 1_000_000:
                    yield flushed()
            if held and names:
                yield flushed()

        rows = vectors.where(F.col("embedding").isNotNull() & F.col(group).isNotNull()).select(group, "embedding")
        return rows.mapInArrow(run, schema).groupBy("query_id", group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"))

    return _by_blocks(queries, search)


def to_documents(matches: DataFrame, owners: DataFrame, limit: int) -> DataFrame:
    """Matches (query_id, vec_id, distance) as files of owners (vec_id, file): the best of each file, score 1 - distance."""
    best = matches.join(owners, "vec_id").groupBy("query_id", "file").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "file")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "file", F.round(1 - F.col("distance"), 6).alias("score"), "rank")


def variants(results: DataFrame, least: float, limit: int) -> DataFrame:
    """Results of several variants of a query (query_id, file, score): each file at its best, of least score, the first `limit`."""
    best = results.groupBy("query_id", "file").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def shard_of(key: Column, shards: int) -> Column:
    """The first four bytes of the SHA-256, as a number, modulo the shards."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % shards


def fanout(queries: DataFrame, vectors: DataFrame, shards: int, limit: int) -> DataFrame:
    """The nearest of each shard, then of all: shards keep max(4, ceil(3 limit / shards)) each."""
    keep = max(4, -(-3 * limit // shards))
    kind = queries.schema["query_id"].dataType.simpleString()

    def search(names: list, asked: np.ndarray) -> DataFrame:
        found = _searched(vectors, names, asked, keep, kind, shard_of(F.col("vec_id").cast("string"), shards))
        own = Window.partitionBy("query_id", "part").orderBy("distance", "vec_id")
        return nearest(found.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= keep).drop("_r", "part"), limit)

    return _by_blocks(queries, search)


def ivf_seeds(vectors: DataFrame, centroids: int = 64) -> DataFrame:
    """centroid_id and embedding: vectors evenly spaced in the order of their ids. Only ids are sorted; vectors are read for the chosen ones."""
    ids = ranked(vectors.where("embedding is not null").select("vec_id"), "vec_id", name="ids")
    n = ids.count()
    k = min(centroids, n)
    if not k:
        return vectors.where("false").select(F.col("vec_id").cast("bigint").alias("centroid_id"), "embedding")
    # the number i with floor(i n / k) = at, if there is one
    i = F.ceil(F.col("_at") * k / n)
    chosen = ids.select("vec_id", i.alias("centroid_id"), "_at").where((i < k) & (F.floor(i * n / k) == F.col("_at"))).select("vec_id", "centroid_id")
    # `centroids` rows at most; of rows that share an id the least vector counts
    return vectors.where("embedding is not null").select("vec_id", "embedding").join(F.broadcast(chosen), "vec_id").groupBy("centroid_id").agg(F.min("embedding").alias("embedding"))


def assigned(vectors: DataFrame, ids: list, centres: np.ndarray) -> DataFrame:
    """vec_id, embedding and centroid_id, the nearest centroid, the smaller id at a tie; narrow, a product of matrices a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _distances(_rows(batch.column(1)), centres, 9).argmin(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(ids, np.int64)[best], pa.int64())], ["vec_id", "embedding", "centroid_id"])

    rows = vectors.where("embedding is not null").select("vec_id", "embedding")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInArrow(run, f"{kinds}, centroid_id bigint")


def recentred(vectors: DataFrame, ids: list, centres: np.ndarray) -> np.ndarray:
    """Means of the members; a centroid without members stays. A task gives one sum a centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centres), np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                best = _distances(x, centres, 9).argmin(1)
                np.add.at(sums, best, x)
                n += np.bincount(best, minlength=len(ids))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(n[there], pa.int64()), pa.array(list(sums[there]), pa.list_(pa.float64()))], ["at", "n", "sums"])

    parts = vectors.where("embedding is not null").select("embedding").mapInArrow(run, "at bigint, n bigint, sums array<double>")
    out, count = np.zeros_like(centres), np.zeros(len(ids))
    for row in parts.toLocalIterator():
        out[row["at"]] += row["sums"]
        count[row["at"]] += row["n"]
    return np.where(count[:, None] > 0, out / np.maximum(count, 1)[:, None], centres)


def ivf_build(vectors: DataFrame, centroids: int = 64, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(centroids, members): members (vec_id, embedding, centroid_id) are those of before the last update. Centroids, MOST_CENTROIDS at most, are worked out on the driver from a sum a task."""
    if centroids > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    spark = vectors.sparkSession
    ids, centres = _collected(ivf_seeds(vectors, centroids), "centroid_id")
    held = vectors.where("false").select("vec_id", "embedding", F.lit(0).cast("bigint").alias("centroid_id"))
    for _ in range(passes if ids else 0):
        held = assigned(vectors, ids, centres)
        centres = recentred(vectors, ids, centres)
    return spark.createDataFrame([(i, c.tolist()) for i, c in zip(ids, centres, strict=True)], "centroid_id bigint, embedding array<double>"), held


def _order(asked: np.ndarray, ids: list, centres: np.ndarray) -> np.ndarray:
    """Places of the centroids in ids, nearest first, for each query; ties to the smaller id."""
    return np.lexsort((np.tile(ids, (len(asked), 1)), _distances(asked, centres, 9)), axis=1)


def calibrated(vectors: DataFrame, members: DataFrame, centroids: DataFrame, k: int, sample: int = 50, target: float = 0.95) -> int:
    """How many centroids a search has to probe for a share `target` of true neighbours, measured on `sample` vectors (by the digest of their ids) whose neighbours one pass over all rows finds."""
    asked = vectors.where("embedding is not null").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(sample).select(F.col("vec_id").alias("query_id"), "embedding")
    names, x = _collected(asked, "query_id")
    ids, centres = _collected(centroids, "centroid_id")
    if not names or not ids:
        return 1
    place = np.argsort(_order(x, ids, centres), axis=1)  # of each centroid in each query's order
    at, by_name = {c: i for i, c in enumerate(ids)}, {q: i for i, q in enumerate(names)}
    truth = exact(asked, vectors, k).join(members.select("vec_id", "centroid_id"), "vec_id").select("query_id", "centroid_id").collect()
    needed = sorted(int(place[by_name[r["query_id"]], at[r["centroid_id"]]]) + 1 for r in truth)
    return needed[-(-len(needed) * round(target * 100) // 100) - 1]


def ivf_search(queries: DataFrame, members: DataFrame, centroids: DataFrame, k: int, probes: int) -> DataFrame:
    """The k nearest among the members (vec_id, embedding, centroid_id) of the `probes` nearest centroids of each query; calibrated() tells how many are enough.

    The centroids that any query of a block probes are known before members are read: a table in folders by centroid_id
    is read in these folders alone.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    ids, centres = _collected(centroids, "centroid_id")

    def search(names: list, asked: np.ndarray) -> DataFrame:
        probed = np.zeros((len(names), max(ids, default=0) + 1), bool)
        if names and ids:
            np.put_along_axis(probed, np.array(ids)[_order(asked, ids, centres)[:, :probes]], True, axis=1)
        wanted = members.where(F.col("centroid_id").isin(np.flatnonzero(probed.any(0)).tolist()))
        found = _searched(wanted, names, asked, k, kind, F.col("centroid_id"), probed)
        return nearest(found.select("query_id", "vec_id", "distance"), k)

    return _by_blocks(queries, search)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true neighbours that were found."""
    hit = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))


def format_query(text: Column, model: Column) -> Column:
    qwen = model.rlike("(?i)qwen.*embed|embed.*qwen")
    return F.when(qwen, F.concat(F.lit("Instruct: Retrieve relevant documents for the given query\nQuery: "), text)).otherwise(F.concat(F.lit("task: search result | query: "), text))


def format_document(text: Column, title: Column, model: Column) -> Column:
    qwen = model.rlike("(?i)qwen.*embed|embed.*qwen")
    titled = F.when(title.isNotNull() & (title != ""), title)
    return F.when(qwen, F.concat_ws("\n", titled, text)).otherwise(F.concat(F.lit("title: "), F.coalesce(titled, F.lit("none")), F.lit(" | text: "), text))
