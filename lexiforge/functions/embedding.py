"""Embedders.  The default hashes tokens: it stands in for a neural model behind the
same interface, and its scores are not comparable with one's."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sentence_hash


#: What models of this kind expect before stored and before asked texts.
PASSAGE, QUERY = "passage:", "query:"


class Embedder(Protocol):
    dims: int

    def __call__(self, texts: list[str], prompt: str = "") -> np.ndarray:
        """One vector for each text; ``prompt`` tells a model what the texts are."""


class HashEmbedder:
    """Counts of tokens in buckets by md5, to unit length; zero without tokens.  A prompt
    changes nothing: hashes of texts and of queries are alike."""

    token = re.compile(r"[^\W_]+")

    def __init__(self, dims: int = 64, held: int = 200_000):
        self.dims, self.held, self.known = dims, held, {}

    def bucket(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.held:
                self.known.clear()
            found = self.known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dims
        return found

    def __call__(self, texts: list[str], prompt: str = "") -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            found = [self.bucket(t) for t in self.token.findall(text.lower())]
            if found:
                row += np.bincount(found, minlength=self.dims)
                row /= np.sqrt((row * row).sum())
        return out


class PageEmbedder(Protocol):
    """Vectors of pages and of queries to them."""

    dims: int

    def page(self, content: str) -> tuple[np.ndarray, np.ndarray]:
        """(patches on a grid: x, y, dims; vectors of tokens that are no patch)."""

    def query(self, text: str) -> list[list[float]]:
        """One vector for each token of a query."""


class HashPageEmbedder:
    """A page's words laid out on a grid of patches, each the hashed words it holds; one
    more vector for the whole page.  Stands in for a vision model."""

    def __init__(self, dims: int = 128, grid: int = 4):
        self.dims, self.grid, self.words = dims, grid, HashEmbedder(dims)

    def page(self, content: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.words.token.findall(content)
        cells = self.grid * self.grid
        parts = [" ".join(found[len(found) * i // cells : len(found) * (i + 1) // cells]) for i in range(cells)]
        return self.words(parts).reshape(self.grid, self.grid, self.dims), self.words([" ".join(found)])

    def query(self, text: str) -> list[list[float]]:
        return self.words(list(dict.fromkeys(self.words.token.findall(text.lower())))).tolist()


def embed_column(text: Column, embedder: Embedder, prompt: str = "") -> Column:
    """Vectors of a text column, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist(), prompt)))

    return run(text)


def embed_distinct(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``df`` with ``hash`` and ``vector``: every distinct text (by hash) is embedded once."""
    keyed = df.withColumn("hash", sentence_hash(F.col(text)))
    once = keyed.filter(F.col(text).isNotNull()).groupBy("hash").agg(F.min(text).alias("one")).select("hash", embed_column(F.col("one"), embedder).alias("vector"))
    return keyed.join(once, "hash", "left")
