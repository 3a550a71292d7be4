import public_tokenizers
import pytest

from gleanery.llm import token_counts

BYTES, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
HARD = [None, "", " ", "  ", "\n", "a", " a", "a ", " a b ", "a  b", "a \n b", "a\tb c", "x y z", "it's he'll", "a' s", "one, two; three!? four?!", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "é ́a", "名前 と 名", "🙂 🙂🙂", "\x1c a\x1cb \x1d c", "a  b 　 c", "<s> </s> <unk>", "1 22 333,4", "x" * 3000 + " y", "w, " * 900, "\u0085 a", "ab\r\n cd", "Ünï, çé. ña!"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda t: len(own.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", [BYTES, WORDS, PIECES])
def test_equals_the_library(spark, sf, name):
    count, path = library(name), public_tokenizers.path(name)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    docs = docs.unionByName(hard).unionByName(hard)
    rows = token_counts.count_tokens(docs, path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count(text), count(text) > 512), text[:80]


def test_query(spark, sf):
    count = library(BYTES)
    rows = {r["doc_id"]: r for r in token_counts.op11_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs) and all(rows[d["doc_id"]]["n_tokens"] == count(d["text"] or "") for d in docs)


@pytest.mark.parametrize("most", [0, 1, 65_536])
def test_the_table_changes_no_count(spark, sf, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = token_counts.count_tokens(docs, public_tokenizers.path(BYTES), most=most)
    assert sorted(some.collect()) == sorted(token_counts.op11_token_counts(spark, sf).collect())


def test_full_cache_and_long_chunks():
    counts = token_counts.Counts(token_counts.loaded(public_tokenizers.path(BYTES)), {"a": 1}, most=2)
    count = library(BYTES)
    for t in HARD:
        assert counts.of(t) == count(t or "")
    assert len(counts) <= 3


def test_empty_table_clashing_names_and_null_ids(spark):
    path = public_tokenizers.path(BYTES)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(empty, path).collect() == []
    df = spark.createDataFrame([(None, "a b", 7, 8), (1, None, 7, 8)], "doc_id bigint, text string, n_tokens int, more int")
    out = token_counts.count_tokens(df, path, keep=("doc_id", "n_tokens", "more"))
    assert out.columns == ["doc_id", "more", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 8, 0, 0, False), (None, 8, 3, 2, False)]


def test_no_shuffle(spark, sf):
    plan = token_counts.op11_token_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
