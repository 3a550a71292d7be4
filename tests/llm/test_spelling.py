import re
import zlib
from collections import Counter

import pytest

from gleanery.llm import spelling

RUN, LOWER = re.compile("[A-Za-zÀ-ÿ]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def brute(docs, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    letters = sorted(set("".join(n)))
    near = {w: {v for v in neighbours(w, letters) if v in n and v != w} for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = found(spelling.op12_spelling(spark, sf))
    expected = brute(docs)
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert any(r[1] for r in expected) and any(r[4] > 3 for r in expected)


def test_repeated_bigrams_edits_at_ends_chains_and_letters(spark):
    base = ["ananas", "anananas", "bananas", "anana", "aaaaa", "aaaaaa", "aaaaab", "baaaaa", "ÀÉîøÿ", "ÀÉîøÿs", "colour", "color", "coloür", "xcolor", "colorx", "abcde", "abcdf", "abcef", "tutut", "ututu", "×÷×÷×", "abcdefghijklmnop", "abcdefgijklmnop", "bcdefghijklmnop"]
    docs = [(i, f"{w.upper() if i % 2 and w.isascii() else w}! ") for i, w in enumerate(base)]
    docs = [(i, t * (3 * 2 ** (i % 6))) for i, t in docs] + [(None, "color, Ωcolor名color"), (None, None), (7, ""), (8, "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = found(spelling.variants(df))
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs)


@pytest.mark.parametrize("letters", ["ab", "abc"])
def test_all_words_of_few_letters(spark, letters):
    from itertools import product

    words = ["".join(w) for n in (5, 6) for w in product(letters, repeat=n)]
    df = spark.createDataFrame([(w, 3 + zlib.crc32(w.encode()) % 50) for w in words[:: 1 if letters == "ab" else 3]], "word string, n bigint")
    n = dict(map(tuple, df.collect()))
    pairs = {(r["word"], r["near"]) for r in spelling.near_pairs(df).collect()}
    assert pairs == {(w, v) for w in n for v in neighbours(w, letters) if v in n and v != w}


def test_roots_of_a_long_chain(spark):
    names = [f"w{i:02}" for i in range(33)]
    df = spark.createDataFrame([(w, names[i + 1] if i < 32 else None) for i, w in enumerate(names)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(df).collect()} == dict.fromkeys(names[:-1], names[-1])


def test_empty_table(spark):
    assert found(spelling.variants(spark.createDataFrame([], "doc_id bigint, text string"))) == []


def test_counts_are_flushed(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, spelling.words(docs).collect()))
    monkeypatch.setattr(spelling, "HELD", 500)
    assert sorted(map(tuple, spelling.words(docs).collect())) == whole


def test_what_a_deletion_leaves_is_not_deleted_from_again():
    # in document 17 both words are hit, and the first one's deletion leaves the second
    for text in ("bbaaéaéa bbaaaéa", "bbaaaéa bbaaéaéa bbaaaéa", "bbééabéb bééabéb"):
        made = Counter()
        for w in text.split():
            h = zlib.crc32(f"17:{w}".encode())
            assert h % 97 == 0
            made[w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
        assert {w.decode("latin-1"): n for w, n in spelling.occurrences(text, "17").items()} == made
