"""Groups of spelling variants: words at edit distance one, joined on their three rarest positional bigrams.

An edit touches at most two bigrams of either word.  With the bigrams of each word in one global order (rarest first, by the number of
words that hold them; ties by bigram, then position), the first bigram that an edit leaves alone is among the first three of both
words, at positions that differ by one at most.  So the three rarest of each word find every near pair.  Bigrams of
words are few (the letters bound them), so their order is a small table on the driver.

Many words share a frequent bigram and position.  What a near pair has to share besides goes into the key: the edit lies to
one side of the shared bigram, so all of the other side is equal; and of the side of the edit, of length s in the shorter word, either the first s // 2
characters are equal or the last s - s // 2 (the longer word is keyed as if it had s there, which is the limit of positions and
lengths).  Every pair that meets is verified by its Levenshtein distance; both words are whole in the row, no group is
gathered anywhere, and equal keys only make an equality join, which Spark splits where it is skewed.

Words are counted in each task before the shuffle.  A word's form is its near word of largest count, if that is twice its own at
least; counts so double along a chain of forms, whose ends are found by pointer jumping in a logarithm of its length.

Null texts have no words; a null doc_id counts as an empty one in the hash; repeated rows count as often as they stand; extra columns
are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import bounded_batches, stretches, table, written

SHORTEST, LEAST, EVERY, RATIO, PREFIX, HELD = 5, 3, 97, 2, 3, 300_000
# Latin-1 bytes of letters, A-Z lower-cased; all else becomes a space
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def occurrences(text: str, doc_id: str, every: int = EVERY) -> Counter:
    """Counts of the words of a text (Latin-1 bytes), after the deletions that the hash of id and word asks for; runs are cut at all other characters, so texts are read as Latin-1."""
    start = zlib.crc32(f"{doc_id}:".encode())
    found = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    words = list(found)
    plain = words if text.isascii() else [w if w.isascii() else w.decode("latin-1").encode() for w in words]
    # what a deletion leaves is no run of the text: it is added last, so that no other deletion takes it for one
    left: list[tuple[bytes, int]] = []
    for word, h in zip(words, map(zlib.crc32, plain, repeat(start)), strict=True):
        if h % every == 0:
            at = h % len(word)
            left.append((word[:at] + word[at + 1 :], found.pop(word)))
    for word, n in left:
        found[word] += n
    return found


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n: the distinct words of all texts of at least `shortest` characters and `least` occurrences."""
    bounded_batches(docs.sparkSession)

    def flushed(held: Counter) -> pa.RecordBatch:
        kept = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= shortest]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in (part for whole in batches for part in stretches(whole, 1)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    for word, n in occurrences(text, doc_id or "").items():
                        held[word] += n
                    if len(held) > HELD:
                        yield flushed(held)
        yield flushed(held)

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rarest(word: str, order: dict[str, int], most: int = PREFIX) -> list[int]:
    """Positions of the word's rarest bigrams, rarest first."""
    return sorted(range(len(word) - 1), key=lambda i: (order[word[i : i + 2]], i))[:most]


def keys(word: str, order: dict[str, int]) -> tuple[list[str], list[str]]:
    """(keys of the word as the shorter one or one of equal length, keys as the longer one)."""
    own, longer = [], []
    for at in rarest(word, order):
        # the edit is right of the bigram: all up to its end is equal; or left of it: all from its start on is
        for side, same, rest in (("r", word[: at + 2], word[at + 2 :]), ("l", word[at:], word[:at])):
            for out, s in ((own, len(rest)), (longer, len(rest) - 1)):
                if s >= 0:
                    half = s // 2
                    out.append(f"{side}<{s}{same}:{rest[:half]}")
                    out.append(f"{side}>{s}{same}:{rest[len(rest) - (s - half) :]}")
    return own, longer


def near_pairs(found: DataFrame) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words (word, n; distinct words) at distance one."""
    gram = F.expr("explode(array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))))")
    counted = found.where(F.length("word") > 1).select(gram.alias("gram")).groupBy("gram").count().orderBy("count", "gram").collect()
    order = {r["gram"]: i for i, r in enumerate(counted)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh64_intdigest
        for batch in (whole.slice(at, 8192) for whole in batches for at in range(0, whole.num_rows, 8192)):
            which, key, role = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                for long, some in enumerate(keys(word, order)):
                    hashed = {of(k) - (1 << 63) for k in some}
                    which += [i] * len(hashed)
                    key += hashed
                    role += [bool(long)] * len(hashed)
            at = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(role), *(c.take(at) for c in batch.columns)], ["key", "longer", "word", "n"])

    keyed = found.select("word", "n").mapInArrow(spread, "key bigint, longer boolean, word string, n bigint")
    left = keyed.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    lengths = F.length("b") - F.length("a")
    fits = F.when(F.col("longer"), lengths == 1).otherwise((lengths == 0) & (F.col("a") < F.col("b")))
    pairs = left.join(right.hint("merge"), "key").where(fits & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for rows of word and form (null: a root itself): pointers jump to the pointer of what they point at until none moves."""
    spark = forms.sparkSession
    # only words with a form can move; the rest are roots
    at = written(spark, forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        then = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = written(spark, at.join(then, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text)."""
    spark = docs.sparkSession
    found = written(spark, words(docs), "words")
    best = near_pairs(found).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= RATIO * F.col("n")
    formed = found.join(best, "word", "left").select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n"))
    formed = written(spark, formed, "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form, its root and the number of its near words."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
