import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import common, quality, toxicity

RNG = np.random.default_rng(4)
WORDS = ["the", "Bad", "word", "x", "yes!", "12", "***", "naïve", "a,b", "zeta|"]


def text_of(n, rng=RNG, blanks=(" ", "\n", "  ", "\t")):
    return "".join(str(rng.choice(WORDS)) + str(rng.choice(blanks)) for _ in range(n))


# -- toxicity


def naive_logit(model, numbers):
    """By the definition: embeddings, every filter at every place, maxima, rectifier, linear."""
    mask = (1 << toxicity.BITS) - 1
    rows = [[*model.low[n & mask], *model.high[(n >> toxicity.BITS) & mask]] for n in numbers.tolist()]
    rows += [[0.0] * 2 * toxicity.HALF] * (toxicity.WIDTHS[-1] - 1)
    logit = float(model.out_bias)
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            at = [sum(float(x) * float(w) for j in range(width) for x, w in zip(rows[i + j], model.conv[k][j][:, f], strict=True)) for i in range(len(numbers))]
            peak = max(max(at) + float(model.bias[k * toxicity.FILTERS + f]), 0) if at else 0
            logit += peak * float(model.out[k * toxicity.FILTERS + f])
    return logit


def random_cnn(seed):
    rng = np.random.default_rng(seed)
    model = toxicity.Cnn(seed)
    for t in (model.low, model.high):
        t[:] = rng.normal(size=t.shape)
    return model


def test_the_convolution_equals_the_definition():
    model, words = random_cnn(1), toxicity.Words()
    texts = [words.of(text_of(n)) for n in (0, 1, 2, 3, 17, 40)]
    assert np.allclose(model.logits(texts), [naive_logit(model, t) for t in texts], atol=1e-3)


def test_gradients_of_the_convolution():
    model, words = random_cnn(2), toxicity.Words()
    for name in ("low", "high"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.conv, model.bias, model.out = [c.astype(np.float64) for c in model.conv], model.bias.astype(np.float64), model.out.astype(np.float64) * 0.1
    texts, y, w = [words.of(text_of(n)) for n in (1, 5, 20)], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = np.array([naive_logit(model, t) for t in texts])
        return float(np.mean(w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)))

    grads, _, numbers, steps = model.gradients(texts, y, w)
    for p, g in zip([*model.conv, model.bias, model.out], grads, strict=True):
        for at in [tuple(RNG.integers(0, n) for n in p.shape) for _ in range(4)]:
            held = p[at]
            p[at] = held + 1e-5
            up = loss()
            p[at] = held - 1e-5
            down, p[at] = loss(), held
            assert math.isclose((up - down) / 2e-5, g[at], rel_tol=2e-2, abs_tol=2e-5)
    row = numbers[0] & ((1 << toxicity.BITS) - 1)
    want = steps[(numbers & ((1 << toxicity.BITS) - 1)) == row, 0].sum()
    held = model.low[row, 0]
    model.low[row, 0] = held + 1e-5
    up = loss()
    model.low[row, 0] = held - 1e-5
    assert math.isclose((up - loss()) / 2e-5, want, rel_tol=2e-2, abs_tol=2e-5)


def test_cuts_are_calibrated_by_language():
    words, model = toxicity.Words(), toxicity.Cnn()
    texts = [f"the and of bad{i % 2} it" if i % 4 < 2 else f"der die das und bad{i % 2}" for i in range(400)]
    numbers, y = [words.of(t) for t in texts], np.array([i % 2 for i in range(400)], float)
    model.logits = lambda some: np.array([(n == words.of("bad1")[0]).any() + 5.0 * (toxicity.language_of(n) == 2) for n in some])
    model.calibrate(numbers, y, np.ones(400))
    assert 0 < model.cuts[1] < 1 and 5 < model.cuts[2] < 6
    assert ((model.scores(numbers) >= 0.5) == y).all()


# -- quality


def naive_passages(text):
    """Shape of each passage and its words, byte by byte."""
    data = text.encode()
    blank = lambda b: quality.KIND[b] in (3, 4, 13)
    starts = [i for i, b in enumerate(data) if not blank(b) and (i == 0 or blank(data[i - 1]))]
    cuts = [0, *starts[quality.PASSAGE :: quality.PASSAGE], len(data)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = data[a:b]
        words = [w.lower() for w in bytes(32 if blank(c) else c for c in part).split()]
        kinds = [0.0] * 16
        for c in part:
            kinds[quality.KIND[c]] += 1
        n, size = max(len(words), 1), max(len(part), 1)
        more = [sum(map(len, words)) / n / 10, len(set(words)) / n, sum(x == y for x, y in zip(words, words[1:], strict=False)) / n, len(words) / quality.PASSAGE, kinds[1] / max(kinds[0] + kinds[1], 1), math.log1p(len(starts)) / 10]
        out.append([k / size for k in kinds] + more)
    return np.array(out), len(starts)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_passages_equal_the_definition(n):
    text = text_of(n)
    shape, owner, bucket, of_word = quality.passages([text.encode(), b"", text.encode()])
    want, words = naive_passages(text)
    assert np.allclose(shape[owner == 0], want) and np.allclose(shape[owner == 2], want)
    assert len(bucket) == 2 * words and (bucket[:words] == bucket[words:]).all() and (of_word[:words] == np.arange(words) // quality.PASSAGE).all()


def test_attention_equals_the_definition():
    model = quality.Mil(3)
    texts = [text_of(n).encode() for n in (0, 5, 130, 400)]
    shape, owner, bucket, of_word = quality.passages(texts)
    p = model.p
    for i, logit in enumerate(model.logits(texts)):
        codes, weights = [], []
        for row in np.flatnonzero(owner == i):
            words = bucket[of_word == row]
            mean = p["words"][words].sum(0) / max(len(words), 1)
            x = np.concatenate((np.clip((shape[row] - model.mean) / model.scale, -6, 6), mean))
            h = np.tanh(x @ p["enc"] + p["enc_b"])
            codes.append(h)
            weights.append(math.exp(float((np.tanh(h @ p["tanh"]) / (1 + np.exp(-(h @ p["gate"])))) @ p["att"])))
        z = sum(w * h for w, h in zip(weights, codes, strict=True)) / sum(weights)
        assert math.isclose(z @ p["out"] + p["out_b"][0], logit, rel_tol=1e-9)


def test_gradients_of_the_attention():
    model, y = quality.Mil(5), np.array([1.0, 0.0, 1.0])
    some = quality.passages([text_of(n).encode() for n in (3, 100, 260)])

    def loss():
        z = model.forward(*some, 3)["logit"]
        return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))

    grads = model.gradients(model.forward(*some, 3), some[1], some[2], some[3], y)
    for name, p in model.p.items():
        places = [tuple(RNG.integers(0, n) for n in p.shape) for _ in range(5)] if name != "words" else [(b, k) for b in some[2][:3] for k in (0, 7)]
        for at in places:
            held = p[at]
            p[at] = held + 1e-6
            up = loss()
            p[at] = held - 1e-6
            down, p[at] = loss(), held
            assert math.isclose((up - down) / 2e-6, grads[name][at], rel_tol=1e-3, abs_tol=1e-8)


@pytest.mark.parametrize("piece", [1, 100, 1 << 12])
def test_scores_do_not_depend_on_where_texts_are_cut(monkeypatch, piece):
    model = quality.Mil(6)
    texts = [text_of(n).encode() for n in (3000, 0, 70, 64)] + [b"x" * 20_000, b" " * 5000]
    whole = model.scores(texts)
    monkeypatch.setattr(quality, "_PIECE", piece)
    assert np.allclose(model.scores(texts), whole, rtol=1e-12, atol=0)


# -- both


@pytest.mark.parametrize("module", [toxicity, quality])
def test_empty_tables_and_names(spark, module):
    docs = spark.createDataFrame([(1, "some words", "a")], "doc_id bigint, text string, _text string").withColumn("score", F.lit("s")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = module.fitted(docs, labels)
    out = module.score(docs, model, keep=("doc_id", "_text", "score", "m"))
    assert out.columns == ["doc_id", "_text", "m", "score"] and out.count() == 1
    assert module.score(docs.limit(0), model).count() == 0 and module.fitted(docs.limit(0), labels) is not None


def test_the_sample_is_bounded_and_without_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(200)] + [(3, "w"), (None, "n"), (7, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1)], "doc_id bigint, toxic int")
    import zlib

    texts, ys, share = common.labelled_sample(docs, labels, "toxic", 30, 20, 150, 2000)
    assert len(texts) == len(ys) <= 50 and sum(map(len, texts)) <= 2000 and max(map(len, texts)) <= 150 and 0 < share < 1
    assert all(zlib.crc32(str(len(t) - 1).encode()) % 5 for t in texts if t != "w")
    again = common.labelled_sample(docs, labels, "toxic", 30, 20, 150, 2000)
    assert again == (texts, ys, share)
