"""Byte-level BPE encoding and decoding by longest match and backtracking.

Bytes stand as Latin-1 characters, so one Aho-Corasick scan of a piece gives the longest token that
starts at each byte.  The encoder walks these longest matches and backs off to shorter prefixes
whenever two neighbouring tokens could not stand side by side in an exact merge.  That question
depends on the two tokens alone and is memoised; each end position is rejected once at most, so the
work is linear in the piece.

Nulls count as empty texts; an empty text has no ids and the digests of empty strings; repeated rows
give repeated results; null ids pass through; an empty table gives an empty one.  Texts are never cut; memory is one text and bounded
caches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import bounded_batches, stretches, table, unlike

_CHUNKS, _WORDS, _PAIRS = 200_000, 200_000, 400_000
_TWO_SPACES = re.compile(r"\s\s")


class _Memo(dict):
    """Values by text, worked out when first met; of bounded size, without very long keys.

    When full it takes no more: what came first is what comes often.
    """

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make = most, make

    def __missing__(self, key: str) -> str:
        value = self.make(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = value
        return value


class Bpe:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.by_text = {str(rank): token for rank, token in self.tokens.items()}
        self.pieces = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int]] = {}  # of each usable token, what its last merge joined
        self.size = [0] * (max(self.tokens) + 1)
        self.scan = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            parts = self.merged(token, stop=rank)
            if parts is not None:  # tokens that merging can't reach never stand inside a piece
                self.parts[rank] = parts
                self.size[rank] = len(token)
                if len(token) > 1:
                    self.scan.add_word(token.decode("latin-1"), rank)
        self.scan.make_automaton()
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self._fits: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._words = _Memo(_WORDS, lambda piece: " ".join(map(str, self.encode_piece(piece.encode()))))
        self._chunks = _Memo(_CHUNKS, lambda chunk: self._ids(f" {chunk}"))

    def merged(self, token: bytes, stop: int) -> tuple[int, int] | None:
        """The two parts that the last merge of the token's own bytes joins, (-1, -1) for a single byte; None if merging doesn't reach the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks = self.ranks
        while len(parts) > 2:
            pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]  # noqa: B905
            low = min(pairs)
            if low >= stop:
                return None
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)

    def fits(self, left: int, right: int) -> bool:
        """Whether exact merging of the two tokens' bytes gives just these two.

        A merge across the border would spoil them. The parts that meet at the border are taken
        apart again, the later merge first; at each stage the parts there could have merged across
        only before the merge just undone (one in the left token goes first at equal rank, being
        further left; one in the right token goes last).
        """
        a, b, limit = left, right, 1 << 30
        tokens, parts, ranks = self.tokens, self.parts, self.ranks
        while True:
            if ranks.get(tokens[a] + tokens[b], 1 << 30) < limit:
                return False
            a_parts, b_parts = parts[a], parts[b]
            if b_parts[0] < 0 and a_parts[0] < 0:
                return True
            if b_parts[0] < 0 or (a_parts[0] >= 0 and a > b):
                limit, a = a, a_parts[1]
            else:
                limit, b = b + 1, b_parts[0]

    def shorter(self, token: int) -> int:
        """The longest usable token that is a proper prefix of this one, or -1."""
        known = self._shorter.get(token)
        if known is None:
            data, known = self.tokens[token], -1
            for n in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:n], -1)
                if rank in self.parts:
                    known = rank
                    break
            self._shorter[token] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece, as exact merging gives them."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        size, lengths = len(data), self.size
        longest = list(map(self.single.__getitem__, data))  # single bytes, unless more begins there
        for end, token in self.scan.iter(data.decode("latin-1")):  # of one start, longer matches end later
            longest[end - lengths[token] + 1] = token
        open_end = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token, fits = 0, longest[0], self._fits
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + lengths[token]
                if open_end[end]:
                    if last < 0:
                        break
                    key = last << 20 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = self.fits(last, token)
                        if len(fits) < _PAIRS:
                            fits[key] = fit
                    if fit:
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif not out:
                raise ValueError("the vocabulary lacks single bytes")
            else:  # nothing may follow here: give up the token before and try its prefixes
                open_end[at] = 0
                at -= lengths[out.pop()]
                token = last
        return out

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        if not text:
            return ""
        if text[0].isspace() or text[-1].isspace() or _TWO_SPACES.search(text):
            return self._ids(text)
        # a lone space between two other characters always starts a match of the pattern
        first, *rest = text.split(" ")
        return " ".join([self._ids(first), *map(self._chunks.__getitem__, rest)])

    def _ids(self, text: str) -> str:
        return " ".join(map(self._words.__getitem__, self.pieces.findall(text)))

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and piece pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids themselves, in place of kept columns of these names; one row in, one row out, no shuffle."""
    bounded_batches(df.sparkSession)
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids"))
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([df.schema[c] for c in keep] + made + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in (part for whole in batches for part in stretches(whole, len(keep))):
            n, ids_sha, out_sha, lists = [], [], [], []
            for value in batch.column(len(keep)):
                ids = bpe.encode_text((value.as_py() or b"").decode("utf-8", "replace"))
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode_text(ids)).hexdigest())
                if with_ids:
                    lists.append(list(map(int, ids.split(" "))) if ids else [])
            columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(unlike(keep))).mapInArrow(rows, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document; null texts count as empty."""
    path, pattern = vocabulary()
    return encode(table(spark, sf_dir, "documents"), path, pattern)
