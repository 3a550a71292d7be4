import base64
import hashlib
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F
from test_llm import documents

from gleanery.llm import bpe


@pytest.fixture(scope="module")
def both():
    import tiktoken

    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.loaded(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    mine, library = both
    said = mine.encode_text(text)
    assert said == " ".join(map(str, library.encode_ordinary(text))), repr(text[:80])
    assert mine.decode_text(said) == text.encode()


def test_every_kind_of_white_space(both):
    blanks = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace() or unicodedata.category(chr(i)) == "Zs"]
    for b in blanks:
        for text in (b, f"a{b}b", f"a {b}b", f"a{b} b", f"{b}a", f"a{b}", f"a{b}{b}{b}b", f"1{b}!{b}x\n{b}"):
            same(both, text)


def test_random_characters(both):
    rng = random.Random(1)
    for n in range(300):
        same(both, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(60))))
        same(both, "".join(rng.choice("abAB .,'\n\t1é") for _ in range(rng.randrange(80))))


@pytest.mark.parametrize("unit", ["a", "=", " ", "\n", "ab", "é", "😀", "0", "-", "the"])
def test_long_runs(both, unit):
    same(both, unit * 5000)


def test_all_documents_of_the_test_table(both, spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        same(both, row["text"] or "")


def test_when_the_memos_are_full(both):
    path, pattern = bpe.vocabulary()
    mine = bpe.Bpe(path, pattern)
    mine._chunks.most = mine._words.most = 3
    for text in ("some words and some more words, some twice", "other words, none of them kept"):
        same((mine, both[1]), text)


def test_empty_tables_and_names(spark):
    path, pattern = bpe.vocabulary()
    docs = documents(spark, [(1, "a b"), (None, None)]).withColumn("_text", F.lit("x"))
    rows = bpe.encode(docs, path, pattern, keep=("doc_id", "_text"), with_ids=True).collect()
    assert {r["_text"] for r in rows} == {"x"} and sorted(r["n_tokens"] for r in rows) == [0, 2]
    assert {r["ids_sha256"] for r in rows if not r["n_tokens"]} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(docs.limit(0), path, pattern).count() == 0
