"""Embeddings of texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.vectors import check_dimension


_WORD = re.compile(r"[^\W_]+")


class EmbeddingError(RuntimeError):
    """A model that can't be loaded or used."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of ``dimension`` values for each text."""


class HashingEmbedder:
    """Words and pairs of words hashed into a vector of unit length: no model, the same on every machine."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        words = [_WORD.findall((text or "").lower()) for text in texts]
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        code, distinct = pd.factorize(np.array([w for text in words for w in text], object)) if len(row) else (np.empty(0, np.int64), [])
        pair = np.flatnonzero(row[1:] == row[:-1])
        both, pairs = pd.factorize(code[pair] * np.int64(len(distinct) + 1) + code[pair + 1])
        # a hash for each distinct word and pair of words, counted by batch
        names = [w.encode() for w in distinct] + [f"{distinct[p // (len(distinct) + 1)]} {distinct[p % (len(distinct) + 1)]}".encode() for p in pairs.tolist()]
        h = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
        used, at = np.concatenate([code, both + len(distinct)]), np.concatenate([row, row[pair]])
        flat = at * self.dimension + h[used] % self.dimension
        out += np.bincount(flat, np.where(h[used] >> 31, 1.0, -1.0), out.size).reshape(out.shape)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norms > 0, out / np.where(norms > 0, norms, 1), out)


class LazyEmbedder:
    """Loads a model when it is first used, once in each process, and warms it up."""

    def __init__(self, load, dimension: int):
        self._load, self._model, self.dimension = load, None, dimension

    def __getstate__(self):
        return {"_load": self._load, "_model": None, "dimension": self.dimension}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            try:
                self._model = self._load()
                self._model.embed(["warm-up"])
            except (OSError, PermissionError, ImportError) as e:
                raise EmbeddingError(f"the embedding model can't be loaded: {e}") from e
        found = np.asarray(self._model.embed(texts), np.float32)
        if found.shape != (len(texts), self.dimension):
            raise EmbeddingError(f"expected {self.dimension} values a text, found shape {found.shape}")
        return found


def embed_column(text: Column, embedder: Embedder) -> Column:
    """Vector of each text (null of null), by batches; the embedder comes once to each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if known.any():
                out[known] = pd.Series(list(embedder.embed(s[known].tolist())), index=s.index[known])
            yield out

    return check_dimension(run(text), embedder.dimension)
