"""Benchmark decontamination: n-gram seeds joined with test items, then Smith-Waterman alignment.

One pass reads the training texts.  It looks the texts' n-grams of words up in a bit filter of the items'
seeds, of bounded size, and writes the passages around what it finds (false hits of the filter cost space
and change nothing).  Seeds of passages are then joined with seeds of items, each passage is aligned with
the items that it shares a seed with, by words, and the score is the alignment's share of what the item
scores against itself.  Passages that have too few of the item's words for the least score are passed
over, which changes no result.  Items may be of any number and length: up to INLINE_WORDS words in all they
are broadcast and joined where the passages are found, and only leaks leave a task; beyond that passages
are written, as long as the items of their length class ask for, and joined with the items by shuffles.

Rare seeds: a seed that more than COMMON items have is left to those of them that have no other; pass
common=None to join all seeds whatever it costs. Seeds are never left out for being frequent in the texts,
and copies of a text are aligned once. An alignment without SEED_WORDS words in a row is not found; of 200
copies each with a tenth to three tenths of their words replaced at random, all that reach the least score
were (tests/llm/test_decontaminate.py holds them to full alignment). seed_words=2 or 1 finds the rest.

Null texts are empty, and empty texts and items without words align with nothing.  Items shorter than
a seed are matched by exact runs of their words.  Repeated rows of texts give repeated results, repeated
items one; items without id are passed over; of places of equal score the first counts; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import bounded_batches, stretches, table, written

SEED_WORDS, COMMON = 3, 64
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
FILTER_BITS = 29
INLINE_WORDS = 1_000_000
BROADCAST_BYTES = 64 << 20
# Words are runs of bytes that are neither blanks, controls nor these; A-Z are lowered.
_BETWEEN = b".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"
_PIECE = 1 << 19


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are between words; a random number for each byte; powers of an odd number and of its inverse, modulo 2^64."""
    between = np.zeros(256, bool)
    between[:33] = between[127] = True
    between[list(_BETWEEN)] = True
    mix = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
    mix[65:91] = mix[97:123]
    mix[between] = 0
    odd, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    power = lambda x: np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * _PIECE, x, np.uint64))), dtype=np.uint64)
    return between, mix, power(odd), power(back)


BETWEEN, MIX, UP, DOWN = _tables()
ODD = np.random.default_rng(6).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, where it starts), of at most a million bytes."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(BETWEEN[raw], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(MIX[raw] * UP[: len(raw)], dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * DOWN[starts], starts


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of bounded size, cut between words; only a word of over half a piece may be cut."""
    at = 0
    while len(data) - at > _PIECE:
        gaps = np.flatnonzero(BETWEEN[np.frombuffer(data[at + _PIECE // 2 : at + _PIECE], np.uint8)])
        end = at + _PIECE // 2 + int(gaps[-1]) if len(gaps) else at + _PIECE
        yield data[at:end]
        at = end
    yield data[at:]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, how many each text has)."""
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    out, sizes, at = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while at < len(parts):
        some, held = [], 0
        while at < len(parts) and (not some or held + len(parts[at][1]) <= _PIECE):
            some.append(parts[at])
            held += len(parts[at][1]) + 1
            at += 1
        hashes, starts = word_hashes(b"\n".join(p for _, p in some))
        begins = np.cumsum([0] + [len(p) + 1 for _, p in some])
        np.add.at(sizes, [i for i, _ in some], np.diff(np.searchsorted(starts, begins)))
        out.append(hashes)
    return np.concatenate(out), sizes


def seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of n words."""
    m = max(len(words) - n + 1, 0)
    key = np.full(m, n, np.uint64)
    for k in range(n):
        key = key * ODD[0] + words[k : k + m] * ODD[k % 7 + 1]
    return (key ^ (key >> np.uint64(31))) * ODD[0]


def length_class(n: int, seed_words: int) -> int:
    """Items of fewer words than a seed are a class for each number of words; longer ones by powers of four."""
    return n if n < seed_words else seed_words + (n.bit_length() + 1) // 2


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, where it ends in text), by words, gaps of linear cost.

    Row by row over the item; the gap along a row is a running maximum of what lies to the left.
    """
    ramp = np.arange(len(text)) * -GAP
    row, best, end = np.zeros(len(text), np.int64), 0, 0
    for word in item:
        cell = np.where(text == word, MATCH, MISMATCH)
        cell[1:] += row[:-1]
        cell = np.maximum(np.maximum(cell, row + GAP), 0)
        row = np.maximum.accumulate(cell + ramp) - ramp
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


def margin(longest: int) -> int:
    """How many words on either side of a seed an alignment may reach."""
    return longest + 3 * (longest // 2 + 2) // 2 + 1


class Filter:
    """Seeds and words of the items of one class as bits; what it says no to is not there."""

    def __init__(self, n: int, shortest: int, longest: int, seeds: np.ndarray, words: np.ndarray):
        self.n, self.shortest, self.margin, self.seeds, self.words = n, shortest, margin(longest), seeds, words

    @staticmethod
    def places(values: np.ndarray, bits: int) -> np.ndarray:
        return (values * ODD[1] >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def has(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = Filter.places(values, (len(bitmap) * 8).bit_length() - 1)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def passages(self, words: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, first word, words, places of seeds, seeds) of each passage; words that no item has are 0."""
        if len(words) < self.n:
            return
        ends = np.cumsum(sizes)
        seeds = seeds_of(words, self.n)
        left = np.repeat(ends, sizes)[: len(seeds)] - np.arange(len(seeds))
        hits = np.flatnonzero(self.has(self.seeds, seeds) & (left >= self.n))
        if not len(hits):
            return
        known = self.has(self.words, words)
        count = np.concatenate(([0], np.cumsum(known)))
        text = np.searchsorted(ends, hits, "right")
        low = np.maximum(hits - self.margin, ends[text] - sizes[text])
        high = np.minimum(hits + self.n + self.margin, ends[text])
        enough = count[high] - count[low] >= least * self.shortest
        hits, text, low, high = hits[enough], text[enough], low[enough], high[enough]
        if not len(hits):
            return
        fresh = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (low[1:] > high[:-1]))))
        for a, b in zip(fresh, [*fresh[1:], len(hits)], strict=True):
            begin, end = low[a], high[b - 1]
            yield int(text[a]), int(begin - (ends[text[a]] - sizes[text[a]])), np.where(known[begin:end], words[begin:end], np.uint64(0)), hits[a:b] - begin, seeds[hits[a:b]]


def may_reach(text: np.ndarray, bag: tuple[np.ndarray, np.ndarray], n: int, least: float) -> bool:
    """Whether text has enough of an item's words for a score of least; no alignment matches more words than both have."""
    words, counts = bag
    where = np.minimum(np.searchsorted(words, text), len(words) - 1)
    both = np.minimum(np.bincount(where[words[where] == text], minlength=len(words)), counts).sum()
    return both / n >= least


def best_alignment(text: np.ndarray, item: np.ndarray, begins: list[int], least: float) -> tuple[float, int, int]:
    """(share, first word, end word) of the best of the alignments near where the item may begin in text."""
    bag, slack = np.unique(item, return_counts=True), len(item) // 2 + 2
    best, seen = (0.0, 0, 0), None
    for begin in sorted(begins):
        # hits of one copy start at nearly the same place: one alignment serves them
        if seen is not None and begin <= seen + slack // 2:
            continue
        seen = begin
        low, high = max(0, begin - slack), min(len(text), begin + len(item) + slack + slack // 2)
        if not may_reach(text[low:high], bag, len(item), least):
            continue
        score, end = align(text[low:high], item)
        share = score / (MATCH * len(item))
        if share > best[0]:
            best = (share, max(low, low + end + 1 - len(item)), low + end + 1)
    return best


def item_words(items: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """item (a number), item_id, class, n and words (their hashes, as bytes) of the distinct items that have words; a written table."""
    kind = items.schema["item_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole, 1)):
            words, sizes = words_of([t.as_py() for t in batch.column(1)])
            lists = np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([length_class(int(n), seed_words) for n in sizes], pa.int32()), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in lists], pa.binary())], ["item_id", "class", "n", "words"])

    rows = items.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    found = rows.mapInArrow(hashed, f"item_id {kind}, class int, n bigint, words binary").where("n > 0")
    return written(items.sparkSession, found.withColumn("item", F.monotonically_increasing_id()), "items")


def item_seeds(found: DataFrame, seed_words: int = SEED_WORDS, common: int | None = COMMON) -> DataFrame:
    """class, seed, item, n and inside: the places of the items' seeds; of seeds that more than `common` items have, only those of items without a rarer one."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, kind, n, words in zip(*(batch.column(c).to_pylist() for c in ("item", "class", "n", "words")), strict=True):
                seeds = seeds_of(np.frombuffer(words, np.uint64), min(n, seed_words))
                m = len(seeds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind), pa.int32()), pa.array(seeds.view(np.int64)), pa.array(np.full(m, item)), pa.array(np.full(m, n)), pa.array(np.arange(m))], ["class", "seed", "item", "n", "inside"])

    spark = found.sparkSession
    every = written(spark, found.select("item", "class", "n", "words").mapInArrow(exploded, "class int, seed bigint, item bigint, n bigint, inside bigint"), "seeds")
    if common is None:
        return every
    of = every.groupBy("class", "seed").agg(F.count_distinct("item").alias("items")).where(F.col("items") > common)
    if not of.limit(1).count():
        return every
    marked = written(spark, every.join(of, ["class", "seed"], "left").withColumn("rare", F.col("items").isNull()).drop("items"), "seeds")
    with_rare = marked.where("rare").select("item").distinct()
    return marked.where("rare").unionByName(marked.where("not rare").join(with_rare, "item", "left_anti")).drop("rare")


def _bitmap(values: DataFrame, n: int) -> np.ndarray:
    """Bits of a column of numbers, of which there are about n: sixteen bits each as far as FILTER_BITS allows."""
    bits = min(max(16, (16 * n).bit_length()), FILTER_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = Filter.places(batch.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(out, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in values.coalesce(4).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def filters_of(found: DataFrame, seeds: DataFrame, seed_words: int = SEED_WORDS) -> dict[int, Filter]:
    """A filter for each class of items, of which there are about a dozen however many items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words)], ["word"])

    out = {}
    for r in found.groupBy("class").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("n")).orderBy("class").collect():
        own = F.col("class") == r["class"]
        words = found.where(own).select("words").mapInArrow(each, "word bigint")
        out[r["class"]] = Filter(min(r["shortest"], seed_words), r["shortest"], r["longest"], _bitmap(seeds.where(own).select("seed"), r["n"]), _bitmap(words, r["n"]))
    return out


def _sized(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its values take BROADCAST_BYTES at most; 64 bytes a row count besides texts and bytes."""
    long = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(F.sum(sum(long, F.lit(64)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Index:
    """Seeds and words of a bounded number of items, in memory: what the shuffled joins do, for one class in one task."""

    def __init__(self, items: list, seeds: list):
        self.items = {r["item"]: (r["item_id"], np.frombuffer(r["words"], np.uint64)) for r in items}
        order = sorted(seeds, key=lambda r: r["seed"])
        self.seeds, self.item, self.inside = (np.array([r[c] for r in order], np.int64) for c in ("seed", "item", "inside"))

    def candidates(self, places: np.ndarray, seeds: np.ndarray) -> dict[int, set[int]]:
        """item: where it may begin in the passage."""
        low, high = (np.searchsorted(self.seeds, seeds.view(np.int64), side) for side in ("left", "right"))
        found: dict[int, set[int]] = {}
        for place, a, b in zip(places.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in range(a, b):
                found.setdefault(int(self.item[k]), set()).add(place - int(self.inside[k]))
        return found


_LEAK = [("text_key", "string"), ("item_id", None), ("score", "double"), ("first_word", "bigint"), ("end_word", "bigint")]


def _leak_batch(rows: list[tuple], item_id: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), item_id, pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [n for n, _ in _LEAK])


class _Texts:
    """The texts of a task's batches that may leak, each once: words, passages and keys."""

    def __init__(self, filters: dict[int, Filter], least: float):
        self.filters, self.least, self.seen = filters, least, set()

    def passages(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """For each stretch of a batch: (text_key, class, first word, words, places of seeds, seeds)."""
        for batch in (part for whole in batches for part in stretches(whole, 0)):
            texts = [v.as_py() or b"" for v in batch.column(0)]
            words, sizes = words_of(texts)
            rows, keys = [], {}
            for kind, of in self.filters.items():
                for text, first, passage, places, own in of.passages(words, sizes, self.least):
                    if text not in keys:
                        keys[text] = hashlib.md5(texts[text]).hexdigest()  # noqa: S324
                    rows.append((keys[text], kind, first, passage, places, own))
            # a copy of a text that this task has had gives nothing new
            yield list({r[:3]: r for r in rows if r[0] not in self.seen}.values())
            self.seen = set(keys.values()) if len(self.seen) > 200_000 else self.seen | set(keys.values())


def found_in_texts(docs: DataFrame, items: DataFrame, least: float = LEAST, seed_words: int = SEED_WORDS, common: int | None = COMMON) -> DataFrame:
    """text_key (MD5), item_id, score, first_word, end_word: the items that align with a text, each at its best place; a written table."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = item_words(items, seed_words)
    seeds = item_seeds(known, seed_words, common)
    filters = filters_of(known, seeds, seed_words)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    schema = ", ".join(f"{n} {t or items.schema['item_id'].dataType.simpleString()}" for n, t in _LEAK)
    if (known.agg(F.sum("n").alias("n")).first()["n"] or 0) <= INLINE_WORDS:
        aligned = _aligned_inline(spark, texts, known, seeds, filters, least, schema)
    else:
        aligned = _aligned_by_joins(spark, texts, known, seeds, filters, least, schema)
    best = aligned.groupBy("text_key", "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "first_word", "end_word")).alias("b"))
    return written(spark, best.select("text_key", "item_id", (-F.col("b.s")).alias("score"), "b.first_word", "b.end_word"), "leaks")


def _aligned_inline(spark: SparkSession, texts: DataFrame, known: DataFrame, seeds: DataFrame, filters: dict[int, Filter], least: float, schema: str) -> DataFrame:
    items, places = known.select("class", "item", "item_id", "words").collect(), seeds.select("class", "seed", "item", "inside").collect()
    kind = known.select("item_id").limit(0).toArrow().schema.field("item_id").type
    index = {c: Index([r for r in items if r["class"] == c], [r for r in places if r["class"] == c]) for c in filters}
    shared = spark.sparkContext.broadcast((filters, index))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters_, index_ = shared.value
        for passages in _Texts(filters_, least).passages(batches):
            rows = []
            for key, c, first, words, at, own in passages:
                for item, begins in index_[c].candidates(at, own).items():
                    item_id, item_words_ = index_[c].items[item]
                    share, begin, end = best_alignment(words, item_words_, begins, least)
                    if share >= least:
                        rows.append((key, item_id, share, first + begin, first + end))
            yield _leak_batch(rows, kind)

    return texts.mapInArrow(find, schema)


def _aligned_by_joins(spark: SparkSession, texts: DataFrame, known: DataFrame, seeds: DataFrame, filters: dict[int, Filter], least: float, schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(filters)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for passages in _Texts(shared.value, least).passages(batches):
            rows = [(key, c, first, words.tobytes(), at, own.view(np.int64)) for key, c, first, words, at, own in passages]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["text_key", "class", "first", "words", "places", "seeds"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole, 2)):
            rows = []
            for key, first, passage, begins, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("text_key", "first", "words", "begins", "item_id", "item_words")), strict=True):
                share, begin, end = best_alignment(np.frombuffer(passage, np.uint64), np.frombuffer(item, np.uint64), begins, least)
                if share >= least:
                    rows.append((key, item_id, share, first + begin, first + end))
            yield _leak_batch(rows, batch.schema.field("item_id").type)

    passages = written(spark, texts.mapInArrow(find, "text_key string, class int, first bigint, words binary, places array<bigint>, seeds array<bigint>"), "passages")
    place = ["text_key", "class", "first"]
    # copies of a text have the same passages
    slim = passages.select(*place, "places", "seeds").dropDuplicates(place).select(*place, F.explode(F.arrays_zip("places", "seeds")).alias("s"))
    near = slim.select(*place, F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")).join(_sized(seeds), ["class", "seed"])
    near = near.groupBy(*place, "item").agg(F.sort_array(F.collect_set(F.col("place") - F.col("inside"))).alias("begins"))
    asked = written(spark, near, "candidates")
    once = passages.join(asked.select(*place).distinct(), place, "left_semi").select(*place, "words").dropDuplicates(place)
    own = known.select("item", "item_id", F.col("words").alias("item_words"))
    pairs = asked.join(once, place).join(_sized(own), "item").select("text_key", "first", "words", "begins", "item_id", "item_words")
    return pairs.mapInArrow(compare, schema)


def _text_key() -> F.Column:
    return F.md5(F.col("text").cast("binary"))


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, seed_words: int = SEED_WORDS, common: int | None = COMMON) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: the items that align with a text, each at its best place."""
    found = found_in_texts(docs, items, least, seed_words, common)
    return docs.select("doc_id", _text_key().alias("text_key")).join(_sized(found), "text_key").drop("text_key")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, seed_words: int = SEED_WORDS, common: int | None = COMMON) -> DataFrame:
    """The rows of docs in which no item aligns; any further columns pass through."""
    leaking = written(docs.sparkSession, found_in_texts(docs, items, least, seed_words, common).select("text_key").distinct(), "leaking")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _text_key().alias("text_key"))
    kept = rows.join(_sized(leaking), "text_key", "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score and place of each benchmark item in each document that holds a copy, exact or edited."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
