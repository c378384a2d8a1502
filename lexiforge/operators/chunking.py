"""Packing of sentences into chunks.

A chunk's end depends on the one before, so a document is folded in order; documents are
the unit of parallelism.  The fold finds where chunks begin (``F.aggregate`` over sentence
lengths, inside the JVM); texts are cut out of the sentence list afterwards.  Only the
drift of meaning, which needs vectors, is followed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.embedding import Embedder
from ..functions.text import strip


def _fold(lengths: Column, first: Column, begins: Callable, added: Callable) -> Column:
    """Places (from 0) at which a new group begins.  ``begins(size, n)`` tells whether an
    element of length n opens one, ``added(size, n, opened)`` is the group's size with it."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), first.cast("array<int>").alias("at"))

    def step(s, n):
        opened = begins(s["size"], n)
        at = F.when(opened, F.array_append(s["at"], s["i"])).otherwise(s["at"])
        return F.struct((s["i"] + 1).alias("i"), added(s["size"], n, opened).cast("int").alias("size"), at.alias("at"))

    return F.aggregate(lengths, start, step, lambda s: s["at"])


def _between(items: Column, at: Column, make: Callable) -> Column:
    """``make(first item, group)`` of the groups of ``items`` that begin at the places ``at``."""

    def one(begin, i):
        end = F.coalesce(F.get(at, i + 1), F.size(items))
        return make(F.get(items, begin), F.slice(items, begin + 1, end - begin))

    return F.transform(at, one)


def _starts(parts: Column, full: Callable, config: Config) -> Column:
    """Where chunks begin: at overlong sentences, after them, and where ``full(size, n)``.
    A size of 0 means that nothing is held."""
    long = lambda n: n > config.max_chars
    begins = lambda size, n: long(n) | (size == 0) | full(size, n)
    added = lambda size, n, opened: F.when(long(n), 0).when(opened, n).otherwise(size + 1 + n)
    return _fold(F.transform(parts, F.length), F.array(), begins, added)


def by_size(config: Config = DEFAULT) -> Callable:
    """A chunk is full if the next sentence would pass the largest size."""
    return lambda size, n: (size + n > config.max_chars) | (size > 1.2 * config.ideal_chars)


def balanced(config: Config = DEFAULT) -> Callable:
    """As :func:`by_size`, but a chunk also ends once it has passed the ideal size."""
    return lambda size, n: (size + n > config.ideal_chars) & ((size + n > config.max_chars) | (size >= config.ideal_chars))


def long_pieces(sentence: Column, config: Config = DEFAULT) -> Column:
    """array of (text, length) of an overlong sentence.

    It may be cut at marks followed by a space that lie between the least and the largest
    size, if the piece before is longer than the least.  The mark at a cut goes, and the
    length counts the piece before white space is stripped.
    """
    places = F.sequence(F.lit(config.min_chars + 1), F.lit(config.max_chars - 1))
    marks = F.filter(places, lambda p: F.substring(sentence, p + 1, F.lit(2)).rlike("^[.!?:;,] $"))
    none = F.struct(F.lit(0).alias("from"), F.array().cast("array<int>").alias("cuts"))

    def step(s, p):
        cut = p - s["from"] > config.min_chars
        return F.struct(F.when(cut, p + 1).otherwise(s["from"]).alias("from"), F.when(cut, F.array_append(s["cuts"], p)).otherwise(s["cuts"]).alias("cuts"))

    ends = F.array_append(F.aggregate(marks, none, step, lambda s: s["cuts"]), F.length(sentence))

    def piece(end, i):
        begin = F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
        return F.struct(strip(F.substring(sentence, begin + 1, end - begin)).alias("text"), (end - begin).cast("int").alias("length"))

    return F.transform(ends, piece)


def chunks_at(parts: Column, at: Column, config: Config = DEFAULT) -> Column:
    """array of (text, length) of the sentence list ``parts`` cut at the places ``at``."""

    def make(first, group):
        text = F.array_join(group, " ")
        whole = F.array(F.struct(text.alias("text"), F.length(text).alias("length")))
        return F.when(F.length(first) > config.max_chars, long_pieces(first, config)).otherwise(whole)

    return F.flatten(_between(parts, at, make))


def wrapped(sentence: Column, limit: int) -> Column:
    """Greedy packing of words; a word costs its length and one.  A first word that is too
    long leaves an empty line before it."""
    words = F.split(strip(sentence), r"\s+")
    begins = lambda size, n: size + n + 1 > limit
    at = _fold(F.transform(words, F.length), F.array(F.lit(0)), begins, lambda size, n, opened: F.when(opened, n + 1).otherwise(size + n + 1))
    lines = _between(words, at, lambda _, group: F.array_join(group, " "))
    return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(lines)


def drifts(vector: np.ndarray, chunk: np.ndarray, threshold: float) -> bool:
    """No vector of the chunk is as near as the threshold (zero vectors: cosine 0; nine
    places, so that engines agree)."""
    if not len(chunk):
        return False
    size = np.sqrt((chunk * chunk).sum(1)) * np.sqrt((vector * vector).sum())
    return bool(np.round((chunk @ vector / np.where(size > 0, size, 1)).max(), 9) < threshold)


def meaning_starts(lengths: list[int], vectors: np.ndarray, config: Config = DEFAULT) -> list[int]:
    """Where chunks begin if, besides size, a drift of meaning ends a chunk of the ideal size."""
    out, size = [], 0
    for i, n in enumerate(lengths):
        full = size + n > config.max_chars or size > 1.2 * config.ideal_chars
        if not size or n > config.max_chars or full or size >= config.ideal_chars and drifts(vectors[i], vectors[out[-1] : i], config.drift):
            out.append(i)
            size = 0
        size = 0 if n > config.max_chars else size + n + (1 if size else 0)
    return out


def _meaning(parts: Column, config: Config, embedder: Embedder) -> Column:
    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda s: [] if s is None or not len(s) else meaning_starts([len(x) for x in s], embedder(list(s)), config))

    return run(parts)


def chunk(docs: DataFrame, parts: Column, config: Config = DEFAULT, strategy: str = "semantic", embedder: Embedder | None = None) -> DataFrame:
    """doc_id, chunk_ix, text, length of the sentence lists ``parts``.

    ``strategy``: semantic (with an embedder; sizes alone without one), balanced or wrap.
    Documents without sentences have no chunks.
    """
    docs, p = docs.select("doc_id", parts.alias("parts")), F.col("parts")
    if strategy == "wrap":
        lines = F.flatten(F.transform(p, lambda s: wrapped(s, config.max_chars)))
        made = docs.select("doc_id", F.transform(lines, lambda x: F.struct(x.alias("text"), F.length(x).alias("length"))).alias("chunks"))
    else:
        at = _meaning(p, config, embedder) if embedder and strategy == "semantic" else _starts(p, (balanced if strategy == "balanced" else by_size)(config), config)
        made = docs.select("doc_id", "parts", at.alias("at")).select("doc_id", chunks_at(p, F.col("at"), config).alias("chunks"))
    # Outer: for an inner explode Spark would first compute all chunks once more, to drop empty lists.
    rows = made.select("doc_id", F.posexplode_outer("chunks").alias("chunk_ix", "chunk")).filter("chunk_ix IS NOT NULL")
    return rows.select("doc_id", "chunk_ix", "chunk.text", "chunk.length")
