"""Token counts by a map-side lookup in two tiers, without any shuffle of pre-tokens.

The first tier is a broadcast table of the lengths, in tokens, of the most frequent pre-tokens: TABLE entries at most, as one
string and one byte an entry.  They come from a random sample of about SAMPLE texts, which costs one more scan of the texts but no shuffle;
only tasks that hold sampled texts send anything, TABLE entries each at most.  The sample decides what is found quickly and
changes no count.  The second tier is a cache in each worker, of CACHE entries, filled by the library itself.

A text is cut at each lone space between two other characters.  Vocabularies whose pre-tokens never run across such a space (`chunked`)
give the same tokens for the parts, each with its space, as for the whole; texts of other vocabularies go to the library whole.
Added tokens hold no space, so their strings inside texts are met whole and are handled as the library does by default.

Null texts count as empty; an empty text has no tokens and no bytes; repeated rows give repeated results; null ids pass
through; kept columns that share a name with a result are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import bounded_batches, stretches, table, unlike

TABLE, CACHE, LONGEST, SAMPLE, LIMIT = 65_536, 400_000, 64, 4_000, 512
_TWO_SPACES, _LONE_SPACE = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
_MARKS = frozenset(".,;:!?")


class Vocabulary:
    """A vocabulary file of tokenizers (.json) or sentencepiece (.model): counts of whole texts, and whether texts may be cut at lone spaces."""

    def __init__(self, path: str):
        self.marks = False  # whether a mark after letters is always a token of its own
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = map(model.id_to_piece, range(model.get_piece_size()))
            # no piece holds a space after another character, and a text gets a space in front
            self.chunked, self.lead = not any("▁" in p.lstrip("▁") for p in pieces) and model.encode("a", out_type=str)[0].startswith("▁"), ""
            self.count = lambda text: len(model.encode(text))
            return
        import json

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        kind, made = config.get("pre_tokenizer") or {}, config.get("normalizer")
        spaced = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and made is None
        # such a vocabulary reads "<space>word" as one pre-token, which begins at the space whatever is before it
        self.chunked = spaced and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"])
        self.lead = " "
        self.count = lambda text: len(own.encode(text, add_special_tokens=False).ids)
        self.marks = self.chunked and not any(set(t["content"]) & _MARKS for t in config["added_tokens"]) and all(self.count(m) == 1 for m in _MARKS)


class Counts(dict):
    """Tokens of a chunk by its text: the broadcast table first, then what this worker has met; when full it takes no more."""

    def __init__(self, vocabulary: Vocabulary, known: dict[str, int], most: int = CACHE):
        super().__init__(known)
        self.vocabulary, self.most = vocabulary, most + len(known)

    def __missing__(self, chunk: str) -> int:
        v = self.vocabulary
        if v.marks and chunk[-1:] in _MARKS and chunk[:-1].isascii() and chunk[:-1].isalpha():
            n = self[chunk[:-1]] + 1  # the mark is a pre-token of its own
        else:
            n = v.count(v.lead + chunk)
        if len(self) < self.most and len(chunk) <= LONGEST:
            self[chunk] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.vocabulary.chunked:
            return self.vocabulary.count(text)
        first, *rest = chunks(text)
        return self.vocabulary.count(first) + sum(map(self.__getitem__, rest))


def chunks(text: str) -> list[str]:
    """The text cut at its lone spaces, which stand between two characters that are no white space."""
    if text[0].isspace() or text[-1].isspace() or _TWO_SPACES.search(text):
        return _LONE_SPACE.split(text)
    return text.split(" ")


@lru_cache(maxsize=2)
def loaded(path: str) -> Vocabulary:
    return Vocabulary(path)


_worker: dict = {}


def _counts(path: str, stamp: str, known) -> Counts:
    """The counts of this worker, kept from task to task of one query."""
    if _worker.get("stamp") != (path, stamp):
        names, lengths = known.value
        _worker.update(stamp=(path, stamp), counts=Counts(loaded(path), dict(zip(names.split(" "), lengths)) if lengths else {}))  # noqa: B905
    return _worker["counts"]


def frequent(df: DataFrame, path: str, text: str, most: int = TABLE, sample: int = SAMPLE) -> tuple[str, bytes]:
    """The table of the first tier: chunks joined by spaces, and a byte for each with its tokens (chunks of over 255 are left out)."""
    if not loaded(path).chunked or not most:
        return "", b""
    part = df.select(F.col(f"`{text}`").alias("t"))
    share = min(1.0, sample / max(part.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, read = Counter(), 0
        for batch in (p for whole in batches for p in stretches(whole, 0)):
            for value in batch.column(0).to_pylist():
                found.update(c for c in islice(chunks(value) if value else (), 1, None) if len(c) <= LONGEST and " " not in c)
            read += batch.num_rows
            if len(found) > 8 * most:
                found = Counter(dict(found.most_common(4 * most)))
        if read:
            top = found.most_common(most)
            yield pa.RecordBatch.from_arrays([pa.array([[c for c, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["chunk", "n"])

    merged: Counter = Counter()
    for batch in part.sample(share, seed=11).mapInArrow(count, "chunk array<string>, n array<bigint>").toArrow().to_batches():
        for row in batch.to_pylist():
            merged.update(dict(zip(row["chunk"], row["n"], strict=True)))
    found = Counts(loaded(path), {})
    top = [(c, found[c]) for c, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:most] if found[c] < 256]
    return " ".join(c for c, _ in top), bytes(n for _, n in top)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT, most: int = TABLE) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit of every row; path must be readable by driver and workers."""
    import uuid

    spark, stamp = df.sparkSession, uuid.uuid4().hex
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(frequent(df, path, text, most))
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    keep = tuple(c for c in keep if c not in [f.name for f in made])
    schema = T.StructType([df.schema[c] for c in keep] + made)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path, stamp, known)
        for batch in (part for whole in batches for part in stretches(whole, len(keep))):
            texts = batch.column(len(keep))
            n = pa.array([counts.of(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], size, n, pc.greater(n, limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])
        pa.default_memory_pool().release_unused()

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(unlike(keep))).mapInArrow(rows, schema)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under byte_bpe_50k.json, and whether they are over 512 tokens."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
