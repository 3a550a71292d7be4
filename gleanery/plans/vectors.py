"""Queries of vector retrieval: every row whose id is divisible by 100 asks, against all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleanery.operators import lookup, proximity, shards
from gleanery.operators import vectors as ops
from gleanery.plans.catalog import query, table, vectors
from gleanery.sources.tables import written

Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
COS = "greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))))"
D = f"d AS (SELECT query_id, vec_id, label, round({COS.format(a='q', b='e')}, 6) AS distance FROM q, v)"
TOP = "{} AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM {} QUALIFY rank <= {})"


def _queries(spark, sf):
    return vectors(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vec_exact", f"WITH {Q}, {D}, {TOP.format('t', 'd', 20)} SELECT * FROM t")
def vec_exact(spark, sf):
    return ops.exact(_queries(spark, sf), vectors(spark, sf), 20)


@query("join_cross", f"WITH {Q}, {D} SELECT query_id, label, count(*) AS n, round(avg(distance), 4) AS mean FROM d GROUP BY ALL")
def join_cross(spark, sf):
    return ops.by_group(_queries(spark, sf), vectors(spark, sf), "label").select("query_id", "label", "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


OWNED = "m AS (SELECT query_id, 'f' || vec_id % 97 AS file, min(distance) AS distance FROM t GROUP BY ALL)"


def _owners(spark, sf):
    return vectors(spark, sf).select("vec_id", F.concat(F.lit("f"), (F.col("vec_id") % 97).cast("string")).alias("file"))


@query("vec_map_docs", f"WITH {Q}, {D}, {TOP.format('t', 'd', 60)}, {OWNED} SELECT query_id, file, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, file) AS rank FROM m QUALIFY rank <= 20")
def vec_map_docs(spark, sf):
    return ops.to_documents(ops.exact(_queries(spark, sf), vectors(spark, sf), 60), _owners(spark, sf), 20)


@query("search_vec", f"WITH {Q}, {D}, {TOP.format('t', 'd', 60)}, {OWNED} SELECT query_id, count(*) AS files, max(round(1 - distance, 6)) AS best FROM m GROUP BY query_id")
def search_vec(spark, sf):
    m = ops.to_documents(ops.exact(_queries(spark, sf), vectors(spark, sf), 60), _owners(spark, sf), 1000)
    return m.groupBy("query_id").agg(F.count("*").alias("files"), F.max("score").alias("best"))


@query("win_top_per_group", f"WITH {Q}, {D} SELECT query_id, label, min(distance) AS distance FROM d GROUP BY ALL")
def win_top_per_group(spark, sf):
    return ops.by_group(_queries(spark, sf), vectors(spark, sf), "label").select("query_id", "label", F.col("least").alias("distance"))


@query("vsearch", f"WITH {Q}, {D}, g AS (SELECT (query_id // 100) % 3 AS query_id, 'f' || vec_id % 97 AS file, max(round(1 - distance, 6)) AS score FROM d GROUP BY ALL) SELECT query_id, file, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS rank FROM g WHERE score >= 0.3 QUALIFY rank <= 10")
def vsearch(spark, sf):
    owned = vectors(spark, sf).withColumn("file", F.concat(F.lit("f"), (F.col("vec_id") % 97).cast("string")))
    near = ops.by_group(_queries(spark, sf), owned, "file")
    return ops.variants(near.select((F.floor(F.col("query_id") / 100) % 3).alias("query_id"), "file", F.round(1 - F.col("least"), 6).alias("score")), 0.3, 10)


@query("cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    v = vectors(spark, sf)
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(ops.cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(n, lambda x: x * x)), 6) AS length, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings))")
def l2_normalize(spark, sf):
    n = ops.normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    return vectors(spark, sf).select("vec_id", n.alias("n")).select("vec_id", F.round(ops.dot(F.col("n"), F.col("n")), 6).alias("length"), F.round(F.col("n")[0], 6).alias("first"))


@query("shard_hash", "SELECT doc_id, ('0x' || substr(sha256(sha256(text)), 1, 8))::BIGINT % 8 AS shard FROM documents")
def shard_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.shard_of(F.sha2("text", 256), 8).alias("shard"))


@query("shard_fanout", f"WITH {Q}, {D}, s AS (SELECT query_id, vec_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id, ('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % 8 ORDER BY distance, vec_id) <= 4), {TOP.format('t', 's', 10)} SELECT * FROM t")
def shard_fanout(spark, sf):
    return ops.fanout(_queries(spark, sf), vectors(spark, sf), 8, 10)


@query("shard_sync_query", "SELECT hash, seq, min(path) AS path, min(title) AS title FROM (SELECT sha256(text) AS hash, 0 AS seq, lang || '/doc_' || doc_id || '.md' AS path, 'doc_' || doc_id AS title FROM documents) GROUP BY ALL")
def shard_sync_query(spark, sf):
    n = F.col("doc_id").cast("string")
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), F.concat("lang", F.lit("/doc_"), n, F.lit(".md")).alias("path"), F.concat(F.lit("doc_"), n).alias("title"), F.lit(True).alias("active"))
    return shards.shard_rows(d.select("hash", F.lit(0).alias("seq")), d)


@query("embed_format", "SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'Instruct: Retrieve relevant documents for the given query' || chr(10) || 'Query: ' || text ELSE 'task: search result | query: ' || text END AS as_query, CASE item_id % 2 WHEN 0 THEN 't' || chr(10) || text ELSE 'title: none | text: ' || text END AS as_document FROM benchmark")
def embed_format(spark, sf):
    even = F.col("item_id") % 2 == 0
    model = F.when(even, "hf:Qwen3-Embedding").otherwise("embeddinggemma")
    return table(spark, sf, "benchmark").select("item_id", ops.format_query(F.col("text"), model).alias("as_query"), ops.format_document(F.col("text"), F.when(even, "t"), model).alias("as_document"))


SEEDS = "n AS (SELECT count(*) AS n, least(64, count(*)) AS k FROM embeddings), o AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings), c0 AS (SELECT i AS centroid_id, e AS c FROM (SELECT unnest(range(0, k)) AS i, n, k FROM n) s JOIN o ON o.at = (s.i * s.n) // s.k)"


def _assign_sql(name: str, centres: str) -> str:
    return f"{name} AS (SELECT vec_id, e, centroid_id FROM o, {centres} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({COS.format(a='e', b='c')}, 9), centroid_id) = 1)"


def _mean_sql(name: str, members: str, old: str) -> str:
    return f"{name}p AS (SELECT centroid_id, i, avg(x) AS x FROM (SELECT centroid_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {members}) GROUP BY ALL), {name}m AS (SELECT centroid_id, list(x ORDER BY i) AS m FROM {name}p GROUP BY centroid_id), {name} AS (SELECT centroid_id, coalesce(m, c) AS c FROM {old} LEFT JOIN {name}m USING (centroid_id))"


IVF = f"{SEEDS}, {_assign_sql('a1', 'c0')}, {_mean_sql('c1', 'a1', 'c0')}, {_assign_sql('a2', 'c1')}, {_mean_sql('c2', 'a2', 'c1')}"


@query("ivf_build", f"WITH {IVF} SELECT vec_id, centroid_id FROM a2")
def ivf_build(spark, sf):
    return ops.ivf_build(vectors(spark, sf))[1].select("vec_id", "centroid_id")


# 95 of 100 neighbours of the fifty vectors of smallest digest lie in the centroids that are probed
PROBES = f"""cq AS (SELECT vec_id AS query_id, e AS q FROM o ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 50),
ct AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, round({COS.format(a='q', b='e')}, 6) AS distance FROM cq, o) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10),
co AS (SELECT query_id, centroid_id, row_number() OVER (PARTITION BY query_id ORDER BY round({COS.format(a='q', b='c')}, 9), centroid_id) AS place FROM cq, c2),
cn AS (SELECT place, row_number() OVER (ORDER BY place) AS i, count(*) OVER () AS n FROM ct JOIN a2 USING (vec_id) JOIN co USING (query_id, centroid_id)),
probes AS (SELECT place AS p FROM cn WHERE i = (n * 95 + 99) // 100),
pr AS (SELECT query_id, q, centroid_id FROM q, c2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({COS.format(a='q', b='c')}, 9), centroid_id) <= (SELECT p FROM probes)),
p AS (SELECT query_id, vec_id, round({COS.format(a='q', b='e')}, 6) AS distance FROM pr JOIN a2 USING (centroid_id))"""


def _ivf(spark, sf):
    v = vectors(spark, sf)
    centres, members = ops.ivf_build(v)
    members = written(members, "members", ["centroid_id"]).select("vec_id", "embedding", F.col("centroid_id").cast("bigint").alias("centroid_id"))
    return ops.ivf_search(_queries(spark, sf), members, centres, 10, ops.calibrated(v, members, centres, 10))


@query("ivf_search", f"WITH {Q}, {IVF}, {PROBES}, {TOP.format('t', 'p', 10)} SELECT * FROM t")
def ivf_search(spark, sf):
    return _ivf(spark, sf)


@query("ivf_recall", f"WITH {Q}, {D}, {TOP.format('t', 'd', 10)}, {IVF}, {PROBES}, {TOP.format('f', 'p', 10)} SELECT count(f.vec_id)::DOUBLE / count(*) AS recall FROM t LEFT JOIN f USING (query_id, vec_id)")
def ivf_recall(spark, sf):
    return ops.recall(_ivf(spark, sf), ops.exact(_queries(spark, sf), vectors(spark, sf), 10))


def _hnsw(spark, sf):
    v = vectors(spark, sf)
    graphs = proximity.hnsw_build(v)
    return proximity.hnsw_search(_queries(spark, sf), graphs, 10, proximity.calibrated(v, graphs, 10))


@query("hnsw_build", "SELECT vec_id, true AS held FROM embeddings")
def hnsw_build(spark, sf):
    """Every vector is a node of the graph of its shard."""
    def ids(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = pa.array(np.frombuffer(raw, np.int64))
                yield pa.RecordBatch.from_arrays([found, pa.array([True] * len(found))], ["vec_id", "held"])

    return proximity.hnsw_build(vectors(spark, sf)).select("ids").mapInArrow(ids, "vec_id bigint, held boolean")


@query("hnsw_search")
def hnsw_search(spark, sf):
    return _hnsw(spark, sf)


@query("hnsw_recall")
def hnsw_recall(spark, sf):
    return ops.recall(_hnsw(spark, sf), ops.exact(_queries(spark, sf), vectors(spark, sf), 10))


SHARDED = "s AS (SELECT vec_id, label, ('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % 8 AS shard FROM embeddings)"


def _sharded(spark, sf):
    return vectors(spark, sf).select("vec_id", "label", ops.shard_of(F.col("vec_id").cast("string"), 8).alias("shard"))


@query("ann_state", f"WITH {SHARDED} SELECT shard, count(*) AS vectors, CASE WHEN shard = 3 THEN 'missing' WHEN count(*) FILTER (label = 0) > 8 THEN 'stale' ELSE 'ready' END AS state FROM s GROUP BY shard")
def ann_state(spark, sf):
    state = F.when(F.col("shard") == 3, "missing").when(F.count_if(F.col("label") == 0) > 8, "stale").otherwise("ready")
    return _sharded(spark, sf).groupBy("shard").agg(F.count("*").alias("vectors"), state.alias("state"))


@query("shard_parity", f"WITH {SHARDED} SELECT count(*) AS sampled, count(*) FILTER (shard = 3) AS missing FROM (SELECT * FROM s ORDER BY vec_id LIMIT 32)")
def shard_parity(spark, sf):
    return _sharded(spark, sf).orderBy("vec_id").limit(32).agg(F.count("*").alias("sampled"), F.count_if(F.col("shard") == 3).alias("missing"))


@query("shard_health", f"WITH {SHARDED}, w AS (SELECT shard, CASE WHEN label < 3 THEN 'parity' WHEN label < 6 THEN 'ann' ELSE 'queue' END AS family, label % 3 AS severity FROM s) SELECT family, max(severity) AS severity, count(*) AS n, count(DISTINCT shard) AS shards FROM w GROUP BY family")
def shard_health(spark, sf):
    family = F.when(F.col("label") < 3, "parity").when(F.col("label") < 6, "ann").otherwise("queue")
    return _sharded(spark, sf).groupBy(family.alias("family")).agg(F.max(F.col("label") % 3).alias("severity"), F.count("*").alias("n"), F.count_distinct("shard").alias("shards"))


@query("shard_queue", "SELECT count(DISTINCT vec_id) AS total, count(*) FILTER (vec_id < 300) AS processed, greatest(0, count(DISTINCT vec_id) - count(*) FILTER (vec_id < 300)) AS pending FROM embeddings")
def shard_queue(spark, sf):
    v = vectors(spark, sf).select("vec_id")
    return shards.queue_state(v, v.where("vec_id < 300"))


@query("limit_topk", f"WITH {Q}, {D} SELECT vec_id, min(distance) AS distance FROM d GROUP BY vec_id ORDER BY distance, vec_id LIMIT 25")
def limit_topk(spark, sf):
    near = ops.exact(_queries(spark, sf), vectors(spark, sf), 25)
    return near.groupBy("vec_id").agg(F.min("distance").alias("distance")).orderBy("distance", "vec_id").limit(25)


@query("sort_multi", "SELECT vec_id, label, row_number() OVER (ORDER BY label DESC, vec_id) AS place FROM embeddings QUALIFY place <= 50")
def sort_multi(spark, sf):
    return lookup.first_rows(vectors(spark, sf).select("vec_id", "label"), [F.desc("label"), F.col("vec_id")], 50)
