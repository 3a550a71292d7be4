import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, documents

from gleanery.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def full_share(text, item):
    words, item = d.words_of([text.encode()])[0], d.words_of([item.encode()])[0]
    return d.align(words, item)[0] / (2 * len(item)) if len(words) and len(item) else 0.0


def edited(rng, item, share):
    return " ".join(f"edit{rng.integers(1000)}" if rng.random() < share else w for w in item.split())


def items_of(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")


@pytest.mark.parametrize(("share", "seed_words", "least"), [(0.0, 3, 1.0), (0.1, 3, 1.0), (0.2, 3, 0.97), (0.25, 3, 0.95), (0.3, 3, 0.93), (0.3, 2, 1.0)])
def test_recall_of_edited_copies(spark, share, seed_words, least):
    rng = np.random.default_rng(int(share * 100))
    items = {r["item_id"]: r["text"] for r in items_of(spark).collect()}
    texts, want = [], set()
    for k in range(5):
        for i, item in items.items():
            copy = edited(rng, item, share)
            texts.append((1000 * k + i, f"{'pad ' * 70}{copy}{' pad' * 70}"))
            if full_share(copy, item) >= 0.5:
                want.add((1000 * k + i, i))
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(documents(spark, texts), items_of(spark), seed_words=seed_words).collect()}
    print(f"replaced {share}, seeds of {seed_words}: recall {len(found & want) / len(want):.4f} of {len(want)}")
    assert len(found & want) / len(want) >= least
    assert all(full_share(dict(texts)[i], items[j]) >= 0.5 for i, j in found)


@pytest.mark.parametrize("inline", [0, 1_000_000])
def test_the_query_equals_full_alignment(spark, monkeypatch, inline):
    monkeypatch.setattr(d, "INLINE_WORDS", inline)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in items_of(spark).collect()}
    bags = {i: set(d.words_of([t.encode()])[0].tolist()) for i, t in items.items()}
    want = {}
    for i, text in docs.items():
        own = set(d.words_of([text.encode()])[0].tolist())
        for j, item in items.items():
            # no alignment reaches half without half of the item's words
            if len(own & bags[j]) >= 0.25 * len(bags[j]) and (share := full_share(text, item)) >= 0.5:
                want[i, j] = share
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in d.op8_decontaminate(spark, SF).collect()}
    assert want and found == pytest.approx(want)


@pytest.mark.parametrize(("most", "inline"), [(0, 0), (500_000, 0), (0, 1_000_000), (500_000, 1_000_000)])
def test_however_tables_are_joined(spark, monkeypatch, most, inline):
    monkeypatch.setattr(d, "BROADCAST_BYTES", most)
    monkeypatch.setattr(d, "INLINE_WORDS", inline)
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "tiny"), (None, "one two three"), (3, None), (4, " ,. ")], "item_id bigint, text string")
    docs = documents(spark, [*ODD, (50, "x one two THREE, four-five six y"), (50, "x one two THREE, four-five six y"), (None, "one two three four five six"), (51, "a tiny one")])
    rows = sorted((r["doc_id"] or -1, r["item_id"], round(r["score"], 9)) for r in d.leaks(docs, items).collect())
    # four words of six align in "one two three four"
    partly = [(i, 1, round(4 / 6, 9)) for i in (-1, 6, 6, 7)]
    assert rows == sorted([*partly, (-1, 1, 1.0), (50, 1, 1.0), (50, 1, 1.0), (51, 2, 1.0)])
    kept = d.clean(docs.withColumn("text_key", F.lit("k")), items)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [1, 2, 3, 4, 5, 8] and kept.columns[-1] == "text_key"


def test_empty_tables(spark):
    items, docs = items_of(spark), documents(spark, ODD)
    assert d.leaks(docs.limit(0), items).count() == 0 and d.leaks(docs, items.limit(0)).count() == 0
    assert d.clean(docs, items.limit(0)).count() == len(ODD) and d.clean(docs.limit(0), items).count() == 0


def test_common_seeds_are_left_to_items_without_others(spark):
    shared = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(i, f"{shared} own{i}a own{i}b own{i}c own{i}d") for i in range(6)] + [(9, shared)], "item_id bigint, text string")
    docs = documents(spark, [(1, shared), (2, f"{shared} own3a own3b own3c own3d")])
    some = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, items, common=3).collect()}
    every = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, items, common=None).collect()}
    assert every == {(k, i) for k in (1, 2) for i in (*range(6), 9)} and some == {(1, 9), (2, 9), (2, 3)}


def test_long_texts_are_cut_between_words_of_any_kind():
    for gap in (b"\t", b",", b" "):
        text = gap.join(b"word%d" % i for i in range(200_000))
        words, sizes = d.words_of([text, b"", b"one two"])
        assert sizes.tolist() == [200_000, 0, 2] and len(np.unique(words)) == 200_002


@pytest.mark.parametrize("inline", [0, 1_000_000])
def test_items_of_all_lengths(spark, monkeypatch, inline):
    monkeypatch.setattr(d, "INLINE_WORDS", inline)
    rng = np.random.default_rng(8)
    items = [(n, " ".join(f"v{x}" for x in rng.integers(0, 5000, n))) for n in (1, 2, 3, 5, 16, 17, 300, 4000)]
    docs = documents(spark, [(n, f"before {t} after") for n, t in items])
    rows = {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["end_word"]) for r in d.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert all(rows[n, n] == (1.0, 1, n + 1) for n, _ in items)
