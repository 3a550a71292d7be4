"""Folding of accents and the Porter stemmer (1980), over distinct terms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = set("aeiou")
# The suffix tables of the published algorithm.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def fold(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if unicodedata.category(c) != "Mn")


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _m(word: str) -> int:
    shape, n = _shape(word), 0
    for a, b in zip(shape, shape[1:]):  # noqa: B905
        n += a == "v" and b == "c"
    return n


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def stem(word: str) -> str:
    if len(word.encode()) < 3:
        return word
    w = word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix) and len(w) > len(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif _double(base) and base[-1] not in "lsz":
                        w = base[:-1]
                    elif _m(base) == 1 and _short(base):
                        w = base + "e"
                    else:
                        w = base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, new in table:
            if w.endswith(suffix):
                if _m(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _m(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _m(base) > 1 or (_m(base) == 1 and not _short(base)):
            w = base
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


class _Stems(dict):
    """Folded stems by term, worked out when first met; when full it takes no more."""

    def __missing__(self, term: str) -> str:
        made = stem(fold(term))
        if len(self) < 500_000:
            self[term] = made
        return made


_known = _Stems()


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(terms: pd.Series) -> pd.Series:
    """The folded stems of each list of terms, in its order; texts and queries both go through this."""
    return terms.map(lambda ts: None if ts is None else [_known[t] for t in ts])
