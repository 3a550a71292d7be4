"""Nearest neighbours by layered proximity graphs, one for each shard of vectors.

Vectors are dealt by a hash of their ids to shards of a bounded size, so that a task holds one shard.  In a shard equal vectors are
one node.  A node is in layer l with probability 1 / M^l, told by a hash of its smallest id; in each layer nodes are linked to
neighbours that are nearer to them than to each other (M at most, and with links back twice M), and parts that are not
connected get a link to their nearest other part.  A search begins at all nodes of the top layer, of which there are few, walks down
with a narrow beam and ends with a best-first search of width `ef` in layer 0.  A shard's graph is one row of a written table:
a search reads the graphs without any shuffle and sends back `ef` candidates at most for each query and shard.

Vectors that are null, empty or hold null or non-finite numbers are left out, as are rows without id; of rows that share an id
each counts; vectors of another length than most are left out; an empty table gives an empty graph.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import vectors as ops
from gleanery.sources.tables import written

M, CANDIDATES, SHARD_ROWS, SHARD_BYTES, BEAM, TOP = 16, 48, 20_000, 16 << 20, 8, 64
_GRAPH = "shard bigint, ids binary, starts binary, vectors binary, width int, layers array<struct<nodes: binary, starts: binary, links: binary>>"


def _near(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the `most` nearest others of each row of unit vectors, nearest first, in blocks."""
    n = len(x)
    most = min(most, n - 1)
    places, far = np.empty((n, most), np.int64), np.empty((n, most))
    for at in range(0, n, 512):
        d = 1 - x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        some = np.argpartition(d, most - 1, axis=1)[:, :most]
        here = np.take_along_axis(d, some, 1)
        order = np.argsort(here, axis=1, kind="stable")
        places[at : at + 512], far[at : at + 512] = np.take_along_axis(some, order, 1), np.take_along_axis(here, order, 1)
    return places, far


def _spread(x: np.ndarray, places: np.ndarray, far: np.ndarray, m: int) -> list[int]:
    """Of a node's neighbours, nearest first, those that no kept one is nearer to than the node is; then the nearest others, m in all."""
    between = 1 - x[places] @ x[places].T
    kept: list[int] = []
    for i in range(len(places)):
        if len(kept) == m:
            break
        if all(between[i, j] > far[i] for j in kept):
            kept.append(i)
    rest = [i for i in range(len(places)) if i not in kept][: m - len(kept)]
    return places[kept + rest].tolist()


def linked(x: np.ndarray, m: int = M, candidates: int = CANDIDATES) -> list[list[int]]:
    """Neighbours of each row of unit vectors, 2m at most but for the links that connect parts."""
    n = len(x)
    if n < 2:
        return [[] for _ in range(n)]
    places, far = _near(x, candidates)
    out = [_spread(x, p, f, m) for p, f in zip(places, far, strict=True)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, links in enumerate(out):
        for j in links:
            back[j].append(i)
    for i in range(n):
        every = list(dict.fromkeys(out[i] + back[i]))
        if len(every) > 2 * m:
            d = 1 - x[every] @ x[i]
            every = [every[j] for j in np.argsort(d, kind="stable")[: 2 * m]]
        out[i] = every
    part, parts = np.full(n, -1), 0
    for first in range(n):  # parts that can be reached from one another, links taken both ways
        if part[first] < 0:
            part[first], stack = parts, [first]
            while stack:
                i = stack.pop()
                for j in out[i] + back[i]:
                    if part[j] < 0:
                        part[j] = parts
                        stack.append(j)
            parts += 1
    for p in range(1, parts):
        own = np.flatnonzero(part == p)
        others = np.flatnonzero(part != p)
        d = 1 - x[own[:64]] @ x[others].T
        i, j = np.unravel_index(d.argmin(), d.shape)
        out[own[i]].append(int(others[j]))
        out[others[j]].append(int(own[i]))
    return out


def _levels(heads: np.ndarray, m: int) -> np.ndarray:
    """The top layer of each node, from a hash of its smallest id."""
    with np.errstate(over="ignore"):
        h = heads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(u) / np.log(m)).astype(np.int64)


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0, *map(len, lists)]).astype(np.int64), np.fromiter((x for some in lists for x in some), np.int64)


def packed(ids: np.ndarray, x: np.ndarray, m: int = M) -> dict:
    """A shard's graph as bytes: nodes are its distinct unit vectors, in the order of their smallest ids."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = (x / np.where(size > 1e-9, size, 1)).astype(np.float32)
    x[size[:, 0] <= 1e-9] = 0
    distinct, own = np.unique(x, axis=0, return_inverse=True)
    own = own.ravel()
    order = np.lexsort((ids, own))
    groups = np.split(ids[order], np.flatnonzero(np.diff(own[order])) + 1) if len(ids) else []
    heads = np.array([g[0] for g in groups], np.int64)
    by_head = np.argsort(heads, kind="stable")
    groups, nodes = [groups[i] for i in by_head], distinct[by_head]
    level, wide, layers = _levels(heads[by_head], m), nodes.astype(np.float64), []
    for top in range(64):
        members = np.flatnonzero(level >= top)
        if top and not len(members):
            break
        starts, links = _flat(linked(wide[members], m))
        layers.append({"nodes": members.astype(np.int64).tobytes(), "starts": starts.tobytes(), "links": links.tobytes()})
        if len(members) <= TOP:
            break
    starts, every = _flat(groups)
    return {"ids": every.tobytes(), "starts": starts.tobytes(), "vectors": nodes.tobytes(), "width": nodes.shape[1], "layers": layers}


class Graph:
    """A packed graph, opened for searches."""

    def __init__(self, row: dict):
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["width"]).astype(np.float64)
        self.layers = []
        for layer in row["layers"]:
            nodes, starts, links = (np.frombuffer(layer[c], np.int64) for c in ("nodes", "starts", "links"))
            self.layers.append((nodes, starts, nodes[links], {int(v): i for i, v in enumerate(nodes)} if len(nodes) < len(self.x) else None))

    def _walk(self, q: np.ndarray, layer: int, begin: list[tuple[float, int]], ef: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first search of a layer finds."""
        _, starts, links, place = self.layers[layer]
        seen = {v for _, v in begin}
        queue, best = list(begin), [(-d, v) for d, v in begin]
        heapq.heapify(queue)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while queue:
            d, v = heapq.heappop(queue)
            if len(best) == ef and d > -best[0][0]:
                break
            i = v if place is None else place[v]
            new = [u for u in links[starts[i] : starts[i + 1]].tolist() if u not in seen]
            if not new:
                continue
            seen.update(new)
            for far, u in zip((1 - self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-far, u))
                elif far < -best[0][0]:
                    heapq.heapreplace(best, (-far, u))
                else:
                    continue
                heapq.heappush(queue, (far, u))
        return [(-d, v) for d, v in best]

    def search(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        """Nodes near a unit vector, at least k of them where there are as many."""
        if not len(self.x):
            return []
        top = self.layers[-1][0]
        found = list(zip((1 - self.x[top] @ q).tolist(), top.tolist(), strict=True))
        for layer in range(len(self.layers) - 1, 0, -1):
            found = self._walk(q, layer, sorted(found)[:BEAM], BEAM)
        return [v for _, v in self._walk(q, 0, sorted(found)[:BEAM], max(ef, k))]


def participants(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x).where(F.col("vec_id").isNotNull() & fine)
    common = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(x) == (common["n"] if common else 0))


def hnsw_build(vectors: DataFrame, m: int = M) -> DataFrame:
    """The graphs of vectors (vec_id, embedding), a row a shard, as a written table."""
    rows = participants(vectors)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    shards = max(1, -(-n // max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * width)))))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        row = packed(table["vec_id"].to_numpy(), ops._rows(table["embedding"]), m)
        schema = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("starts", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("layers", pa.list_(pa.struct([("nodes", pa.binary()), ("starts", pa.binary()), ("links", pa.binary())])))])
        return pa.Table.from_pylist([{"shard": key[0].as_py(), **row}], schema=schema)

    dealt = rows.withColumn("shard", ops.shard_of(F.col("vec_id").cast("string"), shards))
    return written(dealt.groupBy("shard").applyInArrow(build, _GRAPH), "graphs")


def hnsw_search(queries: DataFrame, graphs: DataFrame, k: int, ef: int) -> DataFrame:
    """query_id, vec_id, distance and rank: the k nearest found by cosine of each query (query_id, embedding), ties to the smaller id; calibrated() tells what ef is enough."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def search(names: list, asked: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = np.linalg.norm(asked, axis=1, keepdims=True) if len(names) else np.ones((0, 1))
            unit = asked / np.where(size > 1e-9, size, 1) if len(names) else asked
            for batch in batches:
                for row in batch.to_pylist():
                    graph = Graph(row)
                    for name, q in zip(names, unit, strict=True):
                        q = np.pad(q[: graph.x.shape[1]], (0, max(0, graph.x.shape[1] - len(q))))
                        nodes = graph.search(q, k, ef)
                        far = np.round(np.clip(1 - graph.x[nodes] @ q, 0, 2), 6)
                        pairs = sorted((d, i) for d, v in zip(far.tolist(), nodes, strict=True) for i in graph.ids[graph.starts[v] : graph.starts[v + 1]][:k].tolist())[:k]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), pa.int64() if kind == "bigint" else None), pa.array([i for _, i in pairs], pa.int64()), pa.array([d for d, _ in pairs], pa.float64())], ["query_id", "vec_id", "distance"])

        return ops.nearest(graphs.mapInArrow(run, f"query_id {kind}, vec_id bigint, distance double"), k)

    return ops._by_blocks(queries, search)


def calibrated(vectors: DataFrame, graphs: DataFrame, k: int, sample: int = 50, target: float = 0.95) -> int:
    """The least ef, by doubling, that finds a share `target` of the true neighbours of `sample` vectors (by the digest of their ids); distances decide, so that ties are no misses."""
    asked = written(participants(vectors).orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(sample).select(F.col("vec_id").alias("query_id"), "embedding"), "asked")
    far = lambda df: [r["distance"] for r in df.orderBy("query_id", "rank").collect()]
    truth, ef = far(ops.exact(asked, participants(vectors), k)), max(16, k)
    while truth and ef < SHARD_ROWS:
        found = far(hnsw_search(asked, graphs, k, ef))
        if len(found) == len(truth) and np.mean([a <= b + 1e-6 for a, b in zip(found, truth, strict=True)]) >= target:
            break
        ef *= 2
    return ef


def indexed(queries: DataFrame, vectors: DataFrame, k: int, centroids: int = 64) -> DataFrame:
    """The k nearest by centroids, or by graphs where that takes half of the centroids or more to find enough."""
    rows = participants(vectors)
    centres, members = ops.ivf_build(rows, centroids)
    members = written(members, "members", ["centroid_id"]).select("vec_id", "embedding", F.col("centroid_id").cast("bigint").alias("centroid_id"))
    probes = ops.calibrated(rows, members, centres, k)
    if 2 * probes < min(centroids, centres.count()):
        return ops.ivf_search(queries, members, centres, k, probes)
    graphs = hnsw_build(rows)
    return hnsw_search(queries, graphs, k, calibrated(rows, graphs, k))
