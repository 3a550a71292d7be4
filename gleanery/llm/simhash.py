"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of at most 23 bits.  If two fingerprints differ in at most
three bits, then two of their three segments differ in at most one bit each (three errors over three
segments: the two least touched have at most one).  The perfect Golay code tells the codeword nearest
to a segment; a segment has one to six codewords at distance four or less (the keys), and among them
are the codewords of all its neighbours at distance one.  For each of the three pairs of segments a
fingerprint emits (own codeword, each key) and (each key, own codeword), 24 bits; two fingerprints
that differ by at most one bit in either segment share one of these.  Fingerprints that share a key
are candidates and are verified on all 64 bits.

Equal fingerprints are one node, so exact copies never meet each other.  A bucket is streamed in the
order of its key: blocks of a bounded number of fingerprints are verified by array operations and
leave only a spanning forest of their links, never all pairs; a bucket of several blocks passes them
on, and pairs of sets of blocks are verified elsewhere.  There are three times 2^24 keys, so the
candidates to verify grow with the square of the distinct fingerprints once these are many more than
the keys (over some hundred millions); each costs one operation on a word.  Components are found by alternating star
contractions, each round written to a table in the shared folder.

Null and empty texts have fingerprint zero and are linked like any other.  Rows without doc_id take
part; a component's id is the smallest doc_id that is not null.  Repeated rows give repeated results;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import bounded_batches, stretches, table, unlike, written

BITS, WORDS, SEED, BLOCK, SETS, BROADCAST_IDS = 3, 3, 42, 2048, 8, 2_000_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
# Fixed value: generator polynomial of the (23, 12) Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011


def fingerprint(data: bytes) -> int:
    """64 bits of a UTF-8 text: a bit is 1 where more than half of the shingles' hashes have it."""
    import xxhash

    words = data.lower().split()  # of bytes: A-Z alone are lowered, and the six ASCII blanks alone split
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= WORDS:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - WORDS + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        spans = zip(begins[at : min(at + 65536, n)].tolist(), ends[at + WORDS - 1 : min(at + 65536, n) + WORDS - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[b:e], SEED) for b, e in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed number); no shuffle."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole, 1)):
            found = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias(unlike(["doc_id"]))).mapInArrow(rows, f"doc_id {kind}, fingerprint bigint")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial."""
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1, GENERATOR << (bit - 11), 0)
    return left


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the error pattern of weight three or less first, then those of weight four; and how many there are.

    A word of 23 bits less each pattern of its syndrome is a codeword at that distance; codewords at
    distance four are listed only where the nearest one is at three, as only then neighbours reach them.
    """
    single = 1 << np.arange(23, dtype=np.int64)
    leader = np.full(2048, -1, np.int64)
    leader[0] = 0
    layers = [np.zeros(1, np.int64)]
    for _ in range(3):
        layers.append(np.unique([p | s for p in layers[-1] for s in single if not p & s]))
        leader[_syndromes(layers[-1])] = layers[-1]
    weight = np.array([int(x).bit_count() for x in leader])
    patterns = np.full((2048, 6), -1, np.int64)
    patterns[:, 0] = leader
    of_single = _syndromes(single)
    for s in np.flatnonzero(weight == 3):
        others = leader[s ^ of_single] ^ single
        others = np.unique(others[others != leader[s]])
        patterns[s, 1 : 1 + len(others)] = others
    return patterns, (patterns >= 0).sum(1)


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Codeword indices of segment values, six columns: the nearest first, -1 where there are fewer."""
    patterns, _ = golay()
    found = patterns[_syndromes(values)]
    # the upper 12 bits of a codeword of a cyclic code name it
    return np.where(found >= 0, (values[:, None] ^ found) >> 11, -1)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, its key): pair of segments and two codeword indices in one number."""
    keys = [segment_keys(((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    which, out = [], []
    for k, (i, j) in enumerate(PAIRS):
        for column in range(6):
            there = np.flatnonzero(keys[j][:, column] >= 0)
            which.append(there)
            out.append((k << 24) | (keys[i][there, 0] << 12) | keys[j][there, column])
            if column:
                there = np.flatnonzero(keys[i][:, column] >= 0)
                which.append(there)
                out.append((k << 24) | (keys[i][there, column] << 12) | keys[j][there, 0])
    return np.concatenate(which), np.concatenate(out)


def forest(a: np.ndarray, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links (BITS or fewer) within a, or between a and b; by breadth, a row of distances at a time."""
    full = a if b is None else np.concatenate((a, b))
    side = np.zeros(len(full), bool)
    side[len(a) :] = True
    open_, edges = np.ones(len(full), bool), []
    for root in range(len(full)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            near = open_ & (np.bitwise_count(full ^ full[x]) <= BITS)
            if b is not None:
                near &= side != side[x]
            found = np.flatnonzero(near)
            open_[found] = False
            edges += [(x, int(y)) for y in found]
            queue += found.tolist()
    return [(int(full[x]), int(full[y])) for x, y in edges]


def _links(pairs: list[tuple[int, int]]) -> tuple[pa.Array, pa.Array]:
    flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.array(flat.min(1) if len(flat) else [], pa.int64()), pa.array(flat.max(1) if len(flat) else [], pa.int64())


def _small_links(prints: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Links in buckets too small to be worth a search of their own: neighbours 1, 2, ... places apart, all buckets at once."""
    out, sizes = [], ends - begins
    place = np.concatenate([np.arange(b, e) for b, e in zip(begins, ends, strict=True)]) if len(begins) else np.zeros(0, np.int64)
    last = np.repeat(ends, sizes)
    for step in range(1, int(sizes.max(initial=1))):
        there = place + step < last
        x, y = prints[place[there]], prints[place[there] + step]
        hit = np.bitwise_count(x ^ y) <= BITS
        out.append(np.stack((x[hit], y[hit]), axis=1))
    return out


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the blocks of each bucket; the blocks of buckets that have several, or may go on in another task, are passed on.

    Rows come in the order of key and fingerprint; a bucket may go on beyond either end.
    """
    key_now, held, passed, at_end, number = None, np.zeros(0, np.uint64), 0, True, TaskContext.get().partitionId() << 32

    def rows(links=(), block=None):
        a, b = _links(list(links))
        n = len(a)
        if block is None:
            return pa.RecordBatch.from_arrays([a, b, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], ["a", "b", "key", "block", "members"])
        key, at, members = block
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([at], pa.int64()), pa.array([members.view(np.int64)], pa.list_(pa.int64()))], ["a", "b", "key", "block", "members"])

    def close(last: bool):
        nonlocal passed, number
        if len(held) > 1:
            yield rows(forest(held))
        if len(held) and (passed or not last or at_end):
            yield rows(block=(key_now, number, held))
            passed, number = passed + 1, number + 1

    for batch in batches:
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        begins, ends = edges[:-1], edges[1:]
        if not len(keys):
            continue
        # the first run may go on from the batch before, and the last into the next
        sizes = ends - begins
        middle = np.arange(1, len(begins) - 1)
        small = middle[(sizes[middle] > 1) & (sizes[middle] <= 8)]
        links = [tuple(x) for part in _small_links(prints, begins[small], ends[small]) for x in part.tolist()]
        for k in middle[(sizes[middle] > 8) & (sizes[middle] <= BLOCK)]:
            links += forest(prints[begins[k] : ends[k]])
        if links:
            yield rows(links)
        for k in [0, *middle[sizes[middle] > BLOCK], *([len(begins) - 1] if len(begins) > 1 else [])]:
            if keys[begins[k]] != key_now:
                yield from close(True)
                at_end, key_now, held, passed = key_now is None, int(keys[begins[k]]), np.zeros(0, np.uint64), 0
            for at in range(begins[k], ends[k], BLOCK):
                held = np.concatenate((held, prints[at : min(at + BLOCK, ends[k])]))
                while len(held) > BLOCK:
                    rest, held = held[BLOCK:], held[:BLOCK]
                    yield from close(False)
                    held = rest
    at_end = True
    yield from close(True)


def _between(key: tuple, blocks: pa.Table) -> pa.Table:
    """Links between two sets of blocks of a bucket, or within one set if the two are the same."""
    members = lambda side: [np.asarray(m, np.int64).view(np.uint64) for m in blocks.filter(pc.equal(blocks["of"], side))["members"].to_pylist()]
    low, high = key[1].as_py(), key[2].as_py()
    sets = [np.concatenate(x) if (x := members(side)) else np.zeros(0, np.uint64) for side in dict.fromkeys((low, high))]
    found, other = _links(forest(*sets))
    return pa.table({"a": found, "b": other})


def links(nodes: DataFrame) -> DataFrame:
    """a < b: links between distinct fingerprints that connect all within BITS of each other, few more than a forest.

    Keys are dealt by ranges of (key, fingerprint), so a bucket of any size lies in as many tasks as its
    share asks for. What a task can't settle alone, blocks of large buckets and of the buckets at its two
    ends, is dealt again by pairs of sets of about SETS blocks.
    """
    spark = nodes.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(prints), 4096):
                part = prints[at : at + 4096]
                which, keys = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(part[which].view(np.int64), pa.int64())], ["key", "fingerprint"])

    keys = nodes.select("fingerprint").mapInArrow(keyed, "key bigint, fingerprint bigint")
    dealt = keys.repartitionByRange("key", "fingerprint").sortWithinPartitions("key", "fingerprint")
    found = written(spark, dealt.mapInArrow(_within, "a bigint, b bigint, key bigint, block bigint, members array<bigint>"), "links")
    blocks = found.where("key is not null").select("key", "block", "members")
    several = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / SETS).alias("sets"))
    of = blocks.join(several, "key").withColumn("of", F.pmod(F.xxhash64("block"), F.col("sets")))
    sides = of.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sets") - 1)))
    pairs = sides.select("key", F.least("of", "other").alias("low"), F.greatest("of", "other").alias("high"), "of", "members")
    far = pairs.groupBy("key", "low", "high").applyInArrow(_between, "a bigint, b bigint")
    return found.where("a is not null").select("a", "b").unionByName(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component), for every node of edges (a, b). Alternating star contractions."""
    spark = edges.sparkSession
    now = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    while True:
        # large star: every larger neighbour to the smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, to the smallest of them
        tops = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(tops, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tops.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = written(spark, small, "stars")
        # finished when every node hangs on one centre and no centre hangs on another
        state = after.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        centres = after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        now = after
        if state["n"] == state["nodes"] and not centres:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def assign(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed) and component_id for every row."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, text), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    labels = components(links(nodes))
    labelled = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(ids, "label").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs of the smallest doc_id in each component, one of rows that repeat it; rows without doc_id stay.

    Rows without id stay where they are. The others are told from the ids that go, which are broadcast up to
    BROADCAST_IDS of them and joined beyond; only rows that repeat an id are grouped by it.
    """
    spark = docs.sparkSession
    found = written(spark, assign(docs, text).where("doc_id is not null").select("doc_id", "component_id"), "components")
    dropped = found.where("doc_id <> component_id").select("doc_id")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    gone = written(spark, dropped.distinct().unionByName(repeated), "gone")
    again = written(spark, repeated, "repeated")
    sized = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = docs.where("doc_id is not null")
    kept = docs.where("doc_id is null").unionByName(named.join(sized(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))
    # one of the rows that share an id: the first by hash of the text, then by digest of the whole row, so that only equal rows tie
    rows = named.join(sized(again), "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col(f"`{text}`").alias("text"))
    one = rows.groupBy("id").agg(F.min_by("row", F.struct(F.xxhash64("text"), F.md5(F.to_json("row")))).alias("row"))
    return kept.unionByName(one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and empty texts have fingerprint zero."""
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
