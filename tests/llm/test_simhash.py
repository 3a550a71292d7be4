import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, brute_components, brute_fingerprint, documents

from gleanery.llm import simhash


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    of = brute_components(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(least.get(of[p], i), i)
    rows = simhash.op1_simhash_dedup(spark, sf).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == sorted((i, f"{p:016x}", least[of[p]]) for i, p in prints.items())


@pytest.mark.parametrize(("block", "sets", "partitions"), [(2048, 8, 4), (7, 3, 16), (16, 1, 40)])
def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch, block, sets, partitions):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SETS", sets)
    rng = np.random.default_rng(block)
    # chains around a few centres: hot keys, and components that only links between blocks join
    prints = set()
    for _ in range(3):
        p = int(rng.integers(0, 2**62))
        for _ in range(150):
            p ^= 1 << int(rng.integers(0, 20))
            prints.add(p)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in sorted(prints)], "fingerprint bigint")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["node"] % 2**64: r["label"] for r in simhash.components(simhash.links(nodes)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = brute_components(sorted(prints))
    groups = lambda d: sorted(sorted(p for p in prints if d.get(p, p) == v) for v in {d.get(p, p) for p in prints})
    assert groups(found) == groups(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_one_of_each_group_stays_however_ids_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
    docs = documents(spark, [*ODD, (None, "other words"), (None, None)]).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    rows = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] or -1 for r in rows) == [-1, -1, -1, 1, 4, 5, 6, 8] and all(r["m"] == {1: 2} for r in rows)
