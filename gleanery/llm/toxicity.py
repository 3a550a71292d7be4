"""Toxicity by a convolutional text classifier trained in numpy.

Words are lower-cased, stripped of punctuation and hashed into two tables whose rows, side by side,
are the word's embedding; two different words share an embedding only if both hashes collide, and
words never seen in training stay zero.  Filters of several widths slide over the words; each keeps
its maximum over the whole text, and a linear layer scores the maxima.  Cuts are calibrated for each
language, told from the text's own function words, and shift the score so that 0.5 is the cut.

Texts are never cut: a long one is worked through in overlapping windows, maxima carry over.  Labels
are learnt from a bounded sample (labelled_sample); ids, sources, languages and labels are never
inputs of a score.  Null and empty texts score what a text without words scores; repeated rows give
repeated results; without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import best_cut, bounded_batches, held_out, labelled_sample, scored, stretches, table

BITS, HALF, WIDTHS, FILTERS = 15, 8, (1, 2, 3), 12
POSITIVES, NEGATIVES, LONGEST, TOTAL = 2500, 3500, 60_000, 30_000_000
_CACHED, _WINDOW = 300_000, 32_768
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"
# Function words that tell the languages apart.
_FUNCTION_WORDS = {
    "en": "the and of to in is it that for on with as are this be was by an at or from",
    "de": "der die und das den dem des ein eine zu mit von ist im auf für sich nicht als auch",
    "fr": "le la les des un une et en du que qui dans pour par sur avec est pas au elle",
    "es": "el los las una del y en que por con para se su es al lo como más no",
}
LANGUAGES = ("other", *_FUNCTION_WORDS)


class Words:
    """Word to a packed number: two table rows and a vote for a language."""

    def __init__(self):
        self.cache: dict[str, int] = {}
        votes: dict[str, int] = {}
        for k, words in enumerate(_FUNCTION_WORDS.values(), 1):
            for w in words.split():
                votes[w] = 0 if w in votes else k
        self.votes = votes

    def _number(self, raw: str) -> int:
        import xxhash

        word = raw.strip(_STRIP)
        h = xxhash.xxh64_intdigest(word.encode())
        n = (h & ((1 << BITS) - 1)) | (((h >> 32) & ((1 << BITS) - 1)) << BITS) | (self.votes.get(word, 0) << 2 * BITS)
        if len(raw) <= 48:
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            self.cache[raw] = n
        return n

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known = self.cache.get
        found = [known(w) for w in words]
        if None in found:
            found = [self._number(w) if n is None else n for n, w in zip(found, words, strict=True)]
        return np.array(found, np.int64)


def language_of(numbers: np.ndarray) -> int:
    votes = np.bincount(numbers >> 2 * BITS, minlength=len(LANGUAGES))[1:]
    return int(votes.argmax()) + 1 if len(votes) and votes.max() else 0


class Cnn:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.low = np.zeros((1 << BITS, HALF), np.float32)
        self.high = np.zeros((1 << BITS, HALF), np.float32)
        self.conv = [rng.normal(0, 0.5, (w, 2 * HALF, FILTERS)).astype(np.float32) / w for w in WIDTHS]
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-1)
        self.cuts = np.zeros(len(LANGUAGES))
        self.steep = 1.0

    def start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Give table rows a first value: how far the share of ones among the texts that hold them is from what chance gives."""
        mask, share = (1 << BITS) - 1, float(y.mean())
        for table_, shift in ((self.low, 0), (self.high, BITS)):
            ones, all_ = np.zeros(1 << BITS), np.zeros(1 << BITS)
            for numbers, label in zip(texts, y, strict=True):
                rows = np.unique((numbers >> shift) & mask)
                all_[rows] += 1
                ones[rows] += label
            table_[:, 0] = np.clip((ones - all_ * share) / np.sqrt(all_ * share + 1) / 6, -0.3, 1.5)
        self.conv[0][0, 0, 0] = self.conv[0][0, HALF, 0] = 1.0
        self.out[0] = 1.0

    def embed(self, numbers: np.ndarray) -> np.ndarray:
        mask = (1 << BITS) - 1
        return np.concatenate((self.low[numbers & mask], self.high[(numbers >> BITS) & mask]), axis=1)

    def convolve(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Filter outputs before the bias at every position of rows, which end in enough zero rows."""
        n = len(rows) - WIDTHS[-1] + 1
        out = rows[:n] @ self.conv[k][0]
        for j in range(1, WIDTHS[k]):
            out += rows[j : n + j] @ self.conv[k][j]
        return out

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Maxima over each whole text, after bias and rectifier."""
        edge, step = WIDTHS[-1] - 1, _WINDOW
        best = np.zeros((len(texts), len(self.bias)), np.float32)
        windows = [(i, t[a : a + step + edge]) for i, t in enumerate(texts) for a in range(0, len(t), step)]
        at = 0
        while at < len(windows):
            some, held = [], 0
            while at < len(windows) and (not some or held + len(windows[at][1]) <= 2 * step):
                some.append(windows[at])
                held += len(windows[at][1]) + edge
                at += 1
            rows = np.zeros((held + edge, 2 * HALF), np.float32)
            begins = np.cumsum([0] + [len(t) + edge for _, t in some])
            word = np.zeros(held, bool)
            for b, (_, t) in zip(begins, some, strict=False):
                rows[b : b + len(t)] = self.embed(t)
                word[b : b + len(t)] = True
            # what begins between two texts reaches into the next one and counts for neither
            peak = np.concatenate([np.maximum.reduceat(np.where(word[:, None], self.convolve(rows, k), -np.inf), begins[:-1], axis=0) for k in range(len(WIDTHS))], axis=1)
            np.maximum.at(best, [i for i, _ in some], np.maximum(peak + self.bias, 0))
        return best

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts).astype(np.float64) @ self.out + self.out_bias

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        languages = [language_of(t) for t in texts]
        return 1 / (1 + np.exp(-np.clip(self.steep * (self.logits(texts) - self.cuts[languages]), -60, 60)))

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
        """(of conv, bias and out; of the last bias; words, and the gradient of each one's embedding) of the mean weighted cross entropy, through the place of each maximum alone."""
        edge = WIDTHS[-1] - 1
        grads = [np.zeros_like(p) for p in (*self.conv, self.bias, self.out)]
        touched = [(np.zeros(0, np.int64), np.zeros((0, 2 * HALF), np.float32))]
        bias_step = 0.0
        for numbers, label, weight in zip(texts, y, weights, strict=True):
            rows = np.concatenate((self.embed(numbers), np.zeros((edge, 2 * HALF), np.float32)))
            places, peaks = [], []
            for k in range(len(WIDTHS)):
                out = self.convolve(rows, k) if len(numbers) else np.zeros((1, FILTERS), np.float32)
                places.append(out.argmax(0))
                peaks.append(out.max(0))
            active = np.concatenate(peaks) + self.bias
            hidden = np.maximum(active, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))
            g = np.float32((p - label) * weight / len(texts))
            bias_step += g
            grads[-1] += g * hidden
            through = g * self.out * (active > 0)
            grads[-2] += through
            for k in range(len(WIDTHS) if len(numbers) else 0):
                share = through[k * FILTERS : (k + 1) * FILTERS]
                for j in range(WIDTHS[k]):
                    where = places[k] + j
                    grads[k][j] += rows[where].T * share
                    inside = where < len(numbers)
                    touched.append((numbers[where[inside]], (self.conv[k][j] * share).T[inside]))
        return grads, bias_step, np.concatenate([x for x, _ in touched]), np.concatenate([x for _, x in touched])

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weights: np.ndarray, epochs: int = 4, rate: float = 0.02, seed: int = 0) -> None:
        """Adam over batches of 32 texts."""
        rng = np.random.default_rng(seed)
        self.start(texts, y)
        dense = [*self.conv, self.bias, self.out]
        m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        tables = (self.low, self.high)
        seen = [np.zeros_like(t) for t in tables]
        mask, t = (1 << BITS) - 1, 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for begin in range(0, len(order), 32):
                part, t = order[begin : begin + 32], t + 1
                grads, bias_step, numbers, steps = self.gradients([texts[i] for i in part], y[part], weights[part])
                for p, g, mm, vv in zip(dense, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= rate * 0.3 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-6)
                self.out_bias -= np.float32(rate * bias_step)
                if len(numbers):
                    for table_, squares, rows_of, half in ((tables[0], seen[0], numbers & mask, steps[:, :HALF]), (tables[1], seen[1], (numbers >> BITS) & mask, steps[:, HALF:])):
                        rows_, inverse = np.unique(rows_of, return_inverse=True)
                        g = np.zeros((len(rows_), HALF), np.float32)
                        np.add.at(g, inverse, half)
                        squares[rows_] += g * g
                        table_[rows_] -= 5 * rate * g / (np.sqrt(squares[rows_]) + 1e-3)

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray, weights: np.ndarray) -> None:
        """A cut for all, and one for each language that has enough rows of both labels; one slope for all."""
        z, languages = self.logits(texts), np.array([language_of(t) for t in texts])
        self.cuts[:] = best_cut(z, y, weights)
        for k in range(len(LANGUAGES)):
            own = languages == k
            if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20:
                self.cuts[k] = best_cut(z[own], y[own], weights[own])
        spread = np.std(z - self.cuts[languages])
        self.steep = float(3 / spread) if spread > 0 else 1.0


class Constant:
    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.zeros(len(texts))


def fitted(docs: DataFrame, labels: DataFrame):
    """A model from the usable labels of docs; a quarter of the sample calibrates."""
    texts, ys, share = labelled_sample(docs, labels, "toxic", POSITIVES, NEGATIVES, LONGEST, TOTAL)
    y = np.array(ys, np.float32)
    if len(set(ys)) < 2:
        return Constant()
    words = Words()
    numbers = [words.of(t) for t in texts]
    # weights undo that the two labels were sampled at different rates
    # and count a clean text rejected as twice a toxic one missed
    weights = np.where(y == 1, share / max(y.mean(), 1e-9), 2 * (1 - share) / max(1 - y.mean(), 1e-9))
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = True
    train = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    model = Cnn()
    model.fit([numbers[i] for i in train], y[train], np.ones(len(train)))
    cal = np.flatnonzero(held)
    model.calibrate([numbers[i] for i in cal], y[cal], weights[cal])
    return model


def score(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep (but for a column named score) and score for every row; no shuffle."""

    def scorer():
        words = Words()
        return lambda values: model.scores([words.of(v or "") for v in values])

    return scored(docs, scorer, text, keep)


def clean(docs: DataFrame, model, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that score under the limit, whatever other columns they have; no shuffle."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in stretches(batch, at):
                yield part.filter(pa.array(model.scores([words.of(t or "") for t in part.column(at).to_pylist()]) < limit))

    return docs.mapInArrow(rows, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts score what a text without words scores."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
