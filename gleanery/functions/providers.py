"""Providers of model-dependent steps. The defaults are deterministic and need no network; others are injected with the same signatures."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np


class ModelProvider(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...

    def expand(self, query: str) -> str: ...

    def count_tokens(self, text: str) -> int: ...


def hash_embedding(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """Unit vectors of signed word hashes."""
    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")  # noqa: S324
            out[i, h % dimensions] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Deterministic:
    """Word hashes, word overlap and plain variants."""

    def embed(self, texts: list[str]) -> np.ndarray:
        return hash_embedding(texts)

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        words = {w for w in query.lower().split() if len(w) > 2}
        return [sum(w in t.lower() for w in words) / len(words) if words else 0.0 for t in texts]

    def expand(self, query: str) -> str:
        return f"hyde: Information about {query}\nlex: {query}\nvec: {query}"

    def count_tokens(self, text: str) -> int:
        return -(-len(text) * 2 // 7)
