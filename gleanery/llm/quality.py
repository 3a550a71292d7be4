"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of 64 words.  Each passage is described by shares of byte classes, by
word statistics (repetition among them) and by the mean of its words' hashed embeddings, and encoded by
a dense layer; gated attention weighs the encodings, and the document's score is a linear function of
their weighted mean.  Only document labels are needed to learn embeddings, encoder and attention.

Whole texts are read.  A long one is worked through in stretches that begin where passages begin, and
what depends on the whole text is counted over the whole text first, so a score doesn't depend on where
a text is cut; memory is one text.  Labels are learnt from a bounded sample (labelled_sample); ids,
sources, languages and labels are never inputs of a score.  Null and empty texts are one passage without
words; repeated rows and equal texts have equal scores; without labels of both kinds every score is the
share of ones; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import best_cut, held_out, labelled_sample, scored, table

PASSAGE, HIDDEN, GATE, CUT = 64, 16, 8, 0.3
POSITIVES, NEGATIVES, LONGEST, TOTAL = 3500, 2500, 60_000, 30_000_000
_PIECE = 1 << 20
_CLASSES = 16
SHAPES, BUCKET_BITS, EMBEDDED = _CLASSES + 6, 13, 8


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 11, np.int64)
    kind[:32] = 13
    kind[128:] = 12
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "*#$%&@^~", "\"'()[]{}<>")):
        kind[list(chars.encode())] = k
    return kind


KIND = _byte_classes()
BLANK = (KIND == 3) | (KIND == 4) | (KIND == 13)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(7)
FIRST, PAIR = _RNG.integers(1, 2**62, 256, dtype=np.int64), _RNG.integers(1, 2**62, 1 << 16, dtype=np.int64)
_ODD = np.int64(-7046029254386353131)


def stretches(data: bytes) -> tuple[list[bytes], int]:
    """(the text in stretches of about _PIECE bytes that begin with a passage, how many words it has)."""
    raw = np.frombuffer(data, np.uint8)
    # a word starts where no blank follows a blank or the begin
    starts = np.flatnonzero(~BLANK[raw] & np.concatenate(([True], BLANK[raw[:-1]]))) if len(raw) else np.zeros(0, np.int64)
    if len(data) <= _PIECE:
        return [data], len(starts)
    heads = starts[PASSAGE::PASSAGE]
    cuts = [0]
    for at in heads.tolist():
        if at - cuts[-1] >= _PIECE:
            cuts.append(at)
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)], len(starts)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape of every passage, the text each belongs to, the bucket of every word, the passage each belongs to)."""
    parts = [(i, p, n) for i, (some, n) in enumerate(map(stretches, texts)) for p in some]
    shapes, owners, buckets, of_word, at, done = [], [], [], [], 0, 0
    while at < len(parts):
        some, held = [], 0
        while at < len(parts) and (not some or held + len(parts[at][1]) <= _PIECE):
            some.append(parts[at])
            held += len(parts[at][1]) + 1
            at += 1
        shape, part_of, bucket, passage_of = _described([p for _, p, _ in some], np.array([n for _, _, n in some]))
        shapes.append(shape)
        owners.append(np.array([i for i, _, _ in some])[part_of])
        buckets.append(bucket)
        of_word.append(passage_of + done)
        done += len(shape)
    return tuple(map(np.concatenate, (shapes, owners, buckets, of_word)))


def _described(parts: list[bytes], words_of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    kind = KIND[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    owner = np.searchsorted(begins, starts, "right") - 1
    first = np.searchsorted(starts, begins)
    rank = np.arange(len(starts)) - first[owner]
    n_words = np.bincount(owner, minlength=len(parts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    offset = np.concatenate(([0], np.cumsum(n_passages)))
    of_word = offset[owner] + rank // PASSAGE
    total = offset[-1]
    # each byte belongs to the passage of the last word that began before it
    opens = np.zeros(len(data), np.int64)
    opens[begins] = 1
    head = starts[(rank % PASSAGE == 0) & (rank > 0)]
    np.add.at(opens, head, 1)
    of_byte = np.cumsum(opens) - 1
    counts = np.bincount(of_byte * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float64)
    counts[offset[1:] - 1, 4] -= 1  # the line feed that ends each part here
    size = counts.sum(1, keepdims=True)
    # a word is hashed by its first byte, its length and its pairs of neighbouring bytes, A-Z lowered
    low = LOWER[data].astype(np.int32)
    sums = np.concatenate(([0], np.cumsum(PAIR[(low[:-1] << 8) | low[1:]])))
    words = (sums[ends - 1] - sums[starts] + FIRST[low[starts]]) * _ODD + (ends - starts)
    here = np.bincount(of_word, minlength=total).astype(np.float64)
    lengths = np.bincount(of_word, weights=ends - starts, minlength=total)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    adjacent = np.bincount(of_word, weights=again, minlength=total)
    order = np.lexsort((words, of_word))
    fresh = np.ones(len(words))
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order], weights=fresh, minlength=total)
    some = np.maximum(here, 1)
    bag = np.repeat(np.log1p(words_of_text), n_passages)
    more = np.stack((lengths / some / 10, distinct / some, adjacent / some, here / PASSAGE, counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1), bag / 10), axis=1)
    bucket = (words * _ODD).view(np.uint64) >> np.uint64(64 - BUCKET_BITS)
    return np.concatenate((counts / np.maximum(size, 1), more), axis=1), np.repeat(np.arange(len(parts)), n_passages), bucket.astype(np.int64), of_word


class Mil:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        mat = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(SHAPES), np.ones(SHAPES)
        self.p = {"enc": mat(SHAPES + EMBEDDED, HIDDEN), "enc_b": np.zeros(HIDDEN), "tanh": mat(HIDDEN, GATE), "gate": mat(HIDDEN, GATE), "att": mat(GATE, 1)[:, 0], "out": mat(HIDDEN, 1)[:, 0], "out_b": np.zeros(1)}
        self.p["words"] = rng.normal(0, 0.1, (1 << BUCKET_BITS, EMBEDDED))
        self.shift, self.steep = 0.0, 1.0

    def forward(self, shape: np.ndarray, owner: np.ndarray, bucket: np.ndarray, of_word: np.ndarray, n: int) -> dict:
        p = self.p
        words = np.maximum(np.bincount(of_word, minlength=len(shape)), 1)
        means = np.stack([np.bincount(of_word, weights=p["words"][:, k][bucket], minlength=len(shape)) for k in range(EMBEDDED)], axis=1) / words[:, None]
        x = np.concatenate((np.clip((shape - self.mean) / self.scale, -6, 6), means), axis=1)
        h = np.tanh(x @ p["enc"] + p["enc_b"])
        t, g = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        a = (t * g) @ p["att"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, a)
        e = np.exp(a - top[owner])
        w = e / np.bincount(owner, weights=e, minlength=n)[owner]
        z = np.stack([np.bincount(owner, weights=w * h[:, k], minlength=n) for k in range(HIDDEN)], axis=1)
        return {"x": x, "words": words, "h": h, "t": t, "g": g, "w": w, "z": z, "logit": z @ p["out"] + p["out_b"][0]}

    def gradients(self, f: dict, owner: np.ndarray, bucket: np.ndarray, of_word: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross entropy, by parameter; f is what forward() gave."""
        p, n = self.p, len(y)
        dl = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / n
        dz = dl[:, None] * p["out"]
        dw = (f["h"] * dz[owner]).sum(1)
        mean = np.bincount(owner, weights=f["w"] * dw, minlength=n)
        da = f["w"] * (dw - mean[owner])
        dt, dg = da[:, None] * p["att"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * p["att"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["w"][:, None] * dz[owner] + dt @ p["tanh"].T + dg @ p["gate"].T
        de = dh * (1 - f["h"] ** 2)
        dm = (de @ p["enc"][SHAPES:].T / f["words"][:, None])[of_word]
        table_ = np.stack([np.bincount(bucket, weights=dm[:, k], minlength=1 << BUCKET_BITS) for k in range(EMBEDDED)], axis=1)
        return {"enc": f["x"].T @ de, "enc_b": de.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "att": (f["t"] * f["g"]).T @ da, "out": f["z"].T @ dl, "out_b": dl.sum(keepdims=True), "words": table_}

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts), len(texts))["logit"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.steep * (self.logits(texts) - self.shift) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 15, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over batches of 64 documents."""
        shape, owner, bucket, of_word = passages(texts)
        self.mean, self.scale = shape.mean(0), shape.std(0) + 1e-3
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        word_at = np.searchsorted(of_word, np.arange(len(shape) + 1))
        rng, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        span = lambda at, some: np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), 64):
                part, t = order[b : b + 64], t + 1
                rows = span(begin, part)
                own = np.repeat(np.arange(len(part)), begin[part + 1] - begin[part])
                words = span(word_at, rows)
                of = np.repeat(np.arange(len(rows)), word_at[rows + 1] - word_at[rows])
                f = self.forward(shape[rows], own, bucket[words], of, len(part))
                for k, g in self.gradients(f, own, bucket[words], of, y[part]).items():
                    g += 1e-4 * p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, texts: list[bytes], y: np.ndarray, weights: np.ndarray) -> None:
        z = self.logits(texts)
        self.shift = best_cut(z, y, weights)
        spread = np.std(z)
        self.steep = float(3 / spread) if spread > 0 else 1.0


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def fitted(docs: DataFrame, labels: DataFrame):
    texts, ys, share = labelled_sample(docs, labels, "quality", POSITIVES, NEGATIVES, LONGEST, TOTAL)
    y = np.array(ys, np.float64)
    if len(set(ys)) < 2:
        return Constant(share)
    data = [t.encode() for t in texts]
    weights = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = True
    train = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    model = Mil()
    model.fit([data[i] for i in train], y[train])
    cal = np.flatnonzero(held)
    model.calibrate([data[i] for i in cal], y[cal], weights[cal])
    return model


def score(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep (but for a column named score) and score for every row; no shuffle."""
    return scored(docs, lambda: lambda values: model.scores([(v or "").encode() for v in values]), text, keep)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts are one passage without words."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
