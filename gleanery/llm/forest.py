"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (SAMPLE vectors, in the order of a hash of the id); every vector
is then indexed by all trees.  A query walks all trees through one shared priority queue, nearest
split first, until the leaves taken hold a budget of entries.  The budget is calibrated: for PROBES
vectors the exact neighbours are found by one pass over all rows, and it is set to what a share TARGET
of those neighbours takes to come up.  Where vectors are clustered that is a small part of the index;
where they are isotropic, as in the given tables, no index has closer structure to use and it is most
of the table, so that the work grows with queries times rows.  Candidates in the leaves are ranked by
exact distance.

Equal vectors are indexed once and stand for their k+1 smallest ids, so one very common vector is one
entry.  Leaves are packed into blocks of BLOCK_ROWS entries, a large leaf is dealt over several blocks;
a query goes once to each block with the leaves it wants there, and the queries of a block are dealt in
groups of about GROUP, so that a task holds one block and one group whatever the number of either.

Vectors that are null, zero or of another length than most, or that hold nulls or non-finite numbers,
take no part; neither do rows without id. Rows that repeat id and vector count once. Equal distances go
to the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

TREES, LEAF, SAMPLE, PROBES, TARGET, BLOCK_ROWS, GROUP, EVERY, K = 4, 32, 20_000, 100, 0.95, 16_384, 1024, 100, 10


class Forest:
    """Inner nodes of all trees in arrays; a child is an inner node, or a leaf as -1 - its number."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        normals, cuts, kids, self.roots, self.leaves = [], [], [], [], 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                    side = sample[rows] @ normal
                    cut = float(np.median(side))
                    low = side <= cut
                    if 0 < low.sum() < len(rows):
                        node = len(normals)
                        normals.append(normal)
                        cuts.append(cut)
                        kids.append([0, 0])
                        kids[node] = [grow(rows[low]), grow(rows[~low])]
                        return node
            self.leaves += 1
            return -self.leaves

        self.firsts = []  # number of the first leaf of each tree
        for _ in range(trees):
            self.firsts.append(self.leaves)
            self.roots.append(grow(np.arange(len(sample))))
        self.normals = np.array(normals) if normals else np.zeros((0, sample.shape[1]))
        self.cuts, self.kids = np.array(cuts), np.array(kids, np.int64).reshape(-1, 2)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root, np.int64)
            while len(inner := np.flatnonzero(node >= 0)):
                at = node[inner]
                right = np.einsum("ij,ij->i", vectors[inner], self.normals[at]) > self.cuts[at]
                node[inner] = self.kids[at, right.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def search(self, vector: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
        """Leaves in the order of the shared queue, until they hold `budget` entries."""
        margins = (self.normals @ vector - self.cuts).tolist() if len(self.cuts) else []
        kids, queue, out, held = self.kids.tolist(), [(0.0, r) for r in self.roots], [], 0
        heapq.heapify(queue)
        while queue and held < budget:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near, other = (kids[node][1], kids[node][0]) if m > 0 else kids[node]
                heapq.heappush(queue, (max(far, abs(m)), other))
                node = near
            out.append(-1 - node)
            held += int(sizes[-1 - node])
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def participants(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def routes(sizes: np.ndarray, firsts: list[int], block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each leaf: small leaves of one tree share blocks, large ones are dealt over several."""
    first, count, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if n > block_rows:
            block, held = block + (held > 0), 0
            first[leaf], count[leaf] = block, -(-n // block_rows)
            block += int(count[leaf])
            continue
        if held and (held + n > block_rows or leaf in firsts):
            block, held = block + 1, 0
        first[leaf] = block
        held += n
    return first, count


def _best(square: np.ndarray, k: int) -> np.ndarray:
    """Places of the k+1 least values, and of those that rounding might have kept from being among them."""
    if len(square) > k + 1:
        edge = np.partition(square, k)[k]
        square = np.where(square <= edge + 1e-9 * (1 + abs(edge)), square, np.inf)
    return np.flatnonzero(np.isfinite(square))


def calibrated(index: DataFrame, forest: Forest, sizes: np.ndarray, k: int = K, probes: int = PROBES, target: float = TARGET) -> float:
    """How many entries a query has to take for a share `target` of true neighbours, measured on `probes` vectors of index (head, embedding) against all."""
    asked = index.orderBy(F.xxhash64("head", F.lit(1)), "head").limit(probes).toArrow()
    x, own = _matrix(asked["embedding"]), asked["head"].to_numpy()
    if not len(x):
        return 0.0
    vector = index.schema["embedding"].dataType.simpleString()

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, x.shape[1])))] * len(x)
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, data = batch.column(0).to_numpy(), _matrix(batch.column(1))
            far = ((data * data).sum(1) - 2 * (x @ data.T)) + (x * x).sum(1)[:, None]
            for i, (before, names, rows) in enumerate(held):
                square = np.where(heads == own[i], np.inf, far[i])
                some = _best(square, k)
                both = np.concatenate((before, square[some])), np.concatenate((names, heads[some])), np.concatenate((rows, data[some]))
                order = np.lexsort((both[1], both[0]))[:k]
                held[i] = both[0][order], both[1][order], both[2][order]
        which = np.repeat(np.arange(len(x)), [len(h[0]) for h in held])
        rows = np.concatenate([h[2] for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["probe", "square", "head", "embedding"])

    near = index.select("head", "embedding").mapInArrow(nearby, "probe bigint, square double, head bigint, embedding array<double>")
    first = Window.partitionBy("probe").orderBy("square", "head")
    truth = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("probe", "embedding").toArrow()
    if not truth.num_rows:
        return float(sizes.sum())
    leaves, needed = forest.leaves_of(_matrix(truth["embedding"])), []
    probe = truth["probe"].to_numpy()
    for i in np.unique(probe):
        order = forest.search(x[i], sizes, np.inf)
        before = np.full(len(sizes), np.inf)
        before[order] = np.cumsum(sizes[order])
        needed += before[leaves[probe == i]].min(1).tolist()
    return float(np.quantile(needed, target, method="higher"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries (vec_id, embedding) against all rows of vectors but those of its own id."""
    spark = vectors.sparkSession
    ids = Window.partitionBy("embedding").orderBy("vec_id")
    some = vectors.withColumn("_r", F.dense_rank().over(ids)).where(F.col("_r") <= k + 1)
    index = written(spark, some.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("head", F.col("ids")[0]), "vectors")
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    distinct = written(spark, asked.groupBy("embedding").agg(F.min("query_id").alias("asked")), "queries")
    groups = max(1, -(-distinct.count() // GROUP))

    picked = index.orderBy(F.xxhash64("head"), "head").limit(sample).select("embedding").toArrow()
    forest = Forest(_matrix(picked["embedding"]), trees)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(max(forest.leaves, 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(forest.leaves_of(_matrix(batch.column(0))).ravel(), minlength=len(n))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(n[there], pa.int64())], ["leaf", "n"])

    # one row for each leaf of the forest, whose number the sample bounds
    sizes = np.zeros(max(forest.leaves, 1), np.int64)
    for row in index.select("embedding").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row["leaf"]] = row["n"]
    first, blocks = routes(sizes, forest.firsts, BLOCK_ROWS)
    most = calibrated(index, forest, sizes, k, target=target)
    vector = index.schema["embedding"].dataType.simpleString()
    kind = np.float32 if vector == "array<float>" else np.float64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = forest.leaves_of(_matrix(batch.column(0)))
            turn = batch.column(1).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for t in range(leaves.shape[1]):
                leaf = leaves[:, t]
                block = first[leaf] + (turn % blocks[leaf].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(leaf, pa.int64()), *batch.columns], ["block", "leaf", "embedding", "head"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: list[tuple[int, int, list[int]]] = []
            for i, x in enumerate(_matrix(batch.column(0))):
                wanted: dict[int, list[int]] = {}
                for leaf in forest.search(x, sizes, most):
                    for block in range(int(first[leaf]), int(first[leaf] + blocks[leaf])):
                        wanted.setdefault(block, []).append(leaf)
                rows += [(i, block, leaves) for block, leaves in wanted.items()]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), batch.column(1).take(which), batch.column(0).take(which), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["block", "asked", "embedding", "leaves"])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        """A block in one row: leaves, heads and vectors as bytes."""
        parts = [rows["leaf"].to_numpy().tobytes(), rows["head"].to_numpy().tobytes(), _matrix(rows["embedding"]).astype(kind).tobytes()]
        return pa.table({"block": [key[0].as_py()], **{n: pa.array([p], pa.binary()) for n, p in zip(("leaf", "head", "data"), parts, strict=True)}})

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        """A group of queries of a block in one row."""
        lists = rows["leaves"].to_pylist()
        parts = [rows["asked"].to_numpy().tobytes(), _matrix(rows["embedding"]).astype(kind).tobytes(), np.repeat(np.arange(len(lists)), list(map(len, lists))).tobytes(), np.concatenate(lists).astype(np.int64).tobytes()]
        return pa.table({"block": [key[0].as_py()], **{n: pa.array([p], pa.binary()) for n, p in zip(("asked", "questions", "who", "wanted"), parts, strict=True)}})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                leaf, head, data, asked_, questions, who, wanted = (np.frombuffer(batch.column(n)[row].as_py(), d) for n, d in (("leaf", np.int64), ("head", np.int64), ("data", kind), ("asked", np.int64), ("questions", kind), ("who", np.int64), ("wanted", np.int64)))
                data, questions = data.reshape(len(leaf), -1).astype(np.float64), questions.reshape(len(asked_), -1).astype(np.float64)
                names, own = np.unique(leaf, return_inverse=True)
                open_ = np.zeros((len(asked_), len(names)), bool)
                there = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                hit = names[there] == wanted
                open_[who[hit], there[hit]] = True
                lengths, out = (data * data).sum(1), []
                for at in range(0, len(asked_), 128):
                    q = questions[at : at + 128]
                    square = np.where(open_[at : at + 128][:, own], (q * q).sum(1)[:, None] + lengths - 2 * (q @ data.T), np.inf)
                    for i, x in enumerate(q):
                        found = _best(square[i], k)
                        exact = np.sqrt(((data[found] - x) ** 2).sum(1))
                        order = np.lexsort((head[found], exact))[: k + 1]
                        out.append((np.full(len(order), asked_[at + i]), head[found][order], exact[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], ["asked", "head", "score"])

    entries = index.select("embedding", "head").mapInArrow(deal, f"block bigint, leaf bigint, embedding {vector}, head bigint")
    packed = entries.groupBy("block").applyInArrow(pack, "block bigint, leaf binary, head binary, data binary")
    questions = distinct.select("embedding", "asked").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(walk, f"block bigint, asked bigint, embedding {vector}, leaves array<bigint>")
    grouped = questions.groupBy("block", F.pmod(F.xxhash64("asked"), F.lit(groups)).alias("part")).applyInArrow(gather, "block bigint, asked binary, questions binary, who binary, wanted binary")
    found = packed.join(grouped.hint("merge"), "block").mapInArrow(rank, "asked bigint, head bigint, score double")
    # an entry comes up in several trees
    pairs = found.groupBy("asked", "head").agg(F.min("score").alias("score"))
    best = Window.partitionBy("asked").orderBy("score", "head")
    top = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    each = top.join(index.select("head", F.explode("ids").alias("vec_id")), "head").select("asked", "vec_id", "score")
    answers = asked.join(distinct, "embedding").select("query_id", "asked").join(each, "asked").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, against all others; who takes no part is told above."""
    vectors = participants(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
