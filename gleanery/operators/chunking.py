"""Chunks of Markdown texts, cut at the best break before a target length, outside code fences, with overlap."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, REACH, DECAY = 3600, 540, 800, 0.7
TOKENS, TOKEN_OVERLAP, CHARS_PER_TOKEN, SAFETY = 900, 135, 3.5, 0.85
# Where texts may be cut, and how good each place is.
BREAKS = (
    (r"\n#{1}(?!#)", 100),
    (r"\n#{2}(?!#)", 90),
    (r"\n#{3}(?!#)", 80),
    (r"\n#{4}(?!#)", 70),
    (r"\n#{5}(?!#)", 60),
    (r"\n#{6}(?!#)", 50),
    (r"\n```", 80),
    (r"\n(?:---|\*\*\*|___)\s*\n", 60),
    (r"\n\n+", 20),
    (r"\n[-*]\s", 5),
    (r"\n\d+\.\s", 5),
    (r"\n", 1),
)
_COMPILED = tuple((re.compile(p), score) for p, score in BREAKS)


def breakpoints(text: str) -> dict[int, int]:
    """Place to score, the best where several patterns begin there; in the order of places."""
    best: dict[int, int] = {}
    for pattern, score in _COMPILED:
        for m in pattern.finditer(text):
            best[m.start()] = max(score, best.get(m.start(), 0))
    return dict(sorted(best.items()))


def fences(text: str) -> list[tuple[int, int]]:
    """Fenced stretches; the last one runs to the end if it isn't closed."""
    marks = [(m.start(), m.end()) for m in re.finditer(r"(?:^|(?<=\n)|\n)```", text) if m.start() == 0 or text[m.start()] == "\n"]
    out = [(a[0], b[1]) for a, b in zip(marks[0::2], marks[1::2], strict=False)]
    return [*out, (marks[-1][0], len(text))] if len(marks) % 2 else out


class Cutter:
    def __init__(self, text: str):
        points = breakpoints(text)
        closed = fences(text)
        starts = [a for a, _ in closed]

        def outside(place: int) -> bool:
            k = bisect.bisect_left(starts, place) - 1
            return k < 0 or place >= closed[k][1]

        kept = [(p, s) for p, s in points.items() if outside(p)]
        self.places, self.scores = [p for p, _ in kept], [s for _, s in kept]

    def cut(self, target: int, reach: int = REACH) -> int:
        """The place with the highest score, less the further before the target; the target itself if there is none."""
        a, b = bisect.bisect_left(self.places, target - reach), bisect.bisect_right(self.places, target)
        best, where = -1.0, target
        for place, score in zip(self.places[a:b], self.scores[a:b], strict=True):
            value = score * (1 - DECAY * ((target - place) / reach) ** 2)
            if value > best:
                best, where = value, place
        return where


def chunk(text: str, size: int = SIZE, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, str]]:
    """(place, text) of the chunks; together they hold every character."""
    if len(text) <= size:
        return [(0, text)]
    cutter, out, at = Cutter(text), [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            place = cutter.cut(end, reach)
            end = place if at < place <= end else end
        out.append((at, text[at:end]))
        if end >= len(text):
            return out
        at = end - overlap if end - overlap > at else end


def chunk_tokens(text: str, count: Callable[[str], int] | None = None, tokens: int = TOKENS, overlap: int = TOKEN_OVERLAP, reach: int = REACH) -> list[tuple[int, str, int]]:
    """(place, text, tokens) of chunks of at most so many tokens; chunks that turn out longer are cut again, nothing is lost."""
    count = count or (lambda t: -(-len(t) * 2 // 7))
    out: list[tuple[int, str, int]] = []

    def add(place: int, part: str) -> None:
        n = count(part)
        if n <= tokens or len(part) < 2:
            out.append((place, part, n))
            return
        step = max(1, min(len(part) - 1, int(len(part) * tokens / n * SAFETY)))
        for at in range(0, len(part), step):
            add(place + at, part[at : at + step])

    for place, part in chunk(text, int(tokens * CHARS_PER_TOKEN), int(overlap * CHARS_PER_TOKEN), reach):
        add(place, part)
    return out


def chunks(docs: DataFrame, key: str, text: str, by_tokens: bool = False, count: Callable[[str], int] | None = None) -> DataFrame:
    """key, seq, pos, tokens and text of every chunk of every document, in Arrow batches, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                made = chunk_tokens(t or "", count) if by_tokens else [(p, c, -(-len(c) * 2 // 7)) for p, c in chunk(t or "")]
                rows += [(k, i, p, n, c) for i, (p, c, n) in enumerate(made)]
            yield pd.DataFrame(rows, columns=[key, "seq", "pos", "tokens", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, seq int, pos int, tokens int, text string")


def fixed(docs: DataFrame, text: str, size: int, step: int) -> DataFrame:
    """docs with seq, pos and text of chunks of a fixed size, a step apart; an empty text is one chunk, no shuffle."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("_whole") - 1, F.lit(0)), F.lit(step))
    others = [c for c in docs.columns if c != text]
    each = docs.withColumnRenamed(text, "_whole").select(*others, "_whole", F.posexplode(starts).alias("seq", "pos"))
    return each.select(*others, "seq", "pos", F.substring("_whole", F.col("pos") + 1, F.lit(size)).alias("text"))


def longest(chunks_: DataFrame, by: str) -> DataFrame:
    """The longest chunk of each document, the first at a tie; only lengths are compared, texts are not moved."""
    order = Window.partitionBy(by).orderBy(F.desc("_n"), "seq")
    rows = chunks_.select(by, "seq", F.length("text").alias("_n"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, "seq")
