"""Best-fit packing of token sequences by best-two-fit.

A text becomes its token ids and one closing id; only texts longer than a
sequence are cut.  Pieces are packed by *length*: sequences are filled greedily
(largest piece that fits), and then a sequence with room left gives up its
smallest piece for the two unpacked pieces that fill the larger gap most tightly,
if that is tighter.  Lengths are counted, so the packer works on at most
``capacity`` distinct values however many pieces there are.

Documents are dealt into shards by hash and each shard is packed alone: at most
about one sequence of a shard stays half empty, against thousands that are full.  Rows that
repeat both id and text are spread by the partition they were read from.
Token ids never leave the task that made them unless asked for (``with_ids``).

Defined cases.  Null or empty text: the closing id alone.  Null doc_id: packed
like others.  Repeated rows are packed each.  Very long texts become as many pieces as
they need, in the shards of their pieces.  Pieces of equal length are placed in the order
of doc_id (nulls first), piece and ids_crc32.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, columns_free_of, text_batches, turn_to

#: Words remembered by one Python worker, and their characters; beyond it the memory starts anew.
WORDS_HELD, CHARS_HELD = 800_000, 16_000_000
#: Pieces in a shard, at most about.
SHARD_PIECES = 20_000

# The vocabulary's own pre-tokenizer pattern, for texts below U+0180 (whose
# letters are listed, commonest alternative first; the alternatives begin differently).
_PATTERN = re.compile(r"[a-zªµºß-öø-ſA-ZÀ-ÖØ-Þ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|(?:[^\s\w]|_)+")
_PLAIN = re.compile("[^²³¹¼-¾ƀ-\U0010ffff\x00-\x08\x0e-\x1f\x7f-\x9f]*")


class Encoder:
    """Token ids of whole texts; words are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t for t in ("<|startoftext|>", "<|endoftext|>") if self.tokenizer.token_to_id(t) is not None]
        self._forget()

    def _forget(self):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.used = self.chars = 0

    def _learn(self, words: list[str]):
        """One encoding of all new words, set apart by spaces; word_ids tells them apart again."""
        done = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(done.ids, np.uint32)
        size = np.bincount(np.array(done.word_ids, np.int64), minlength=len(words))
        if len(size) != len(words) or not size.all():
            raise ValueError("the tokenizer split a word that its own pattern made")
        n, k = len(ids), len(self.at)
        for name, need in (("begin", k + len(words)), ("size", k + len(words)), ("ids", self.used + n)):
            if need > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), max(need, 2 * len(getattr(self, name)))))
        self.ids[self.used : self.used + n] = ids
        self.size[k : k + len(words)] = size
        self.begin[k : k + len(words)] = self.used + np.cumsum(size) - size
        self.at.update(zip(words, range(k, k + len(words))))
        self.used += n
        self.chars += sum(map(len, words))

    def _known(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, -1 for new ones."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Exactly the tokenizer's ids of each text, without special tokens added."""
        out: list = [None] * len(texts)
        split = []
        for i, text in enumerate(texts):
            plain = text.isascii() and text.isprintable() or _PLAIN.fullmatch(text) is not None
            if not plain or "<|" in text and any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                split.append((i, _PATTERN.findall(text.lower())))
        coded = [(i, words, self._known(words)) for i, words in split]
        new = {words[j] for _, words, k in coded for j in np.flatnonzero(k < 0)}
        if self.at and (len(self.at) + len(new) > WORDS_HELD or self.chars > CHARS_HELD):
            self._forget()
            return self.encode_many(texts)
        if new:
            self._learn(list(new))
        for i, words, k in coded:
            for j in np.flatnonzero(k < 0):
                k[j] = self.at[words[j]]
            size = self.size[k].astype(np.int64)
            begin = self.begin[k] - (np.cumsum(size) - size)
            out[i] = self.ids[np.repeat(begin, size) + np.arange(int(size.sum()))]
        return out


_ENCODERS: dict[str, Encoder] = MEMORIES.setdefault("packing", {})


def encoder(path: str) -> Encoder:
    turn_to("packing")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def plan_bins(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of lengths) that hold ``counts[length]`` pieces of each length."""
    counts = counts.copy()
    bins: list[list[int]] = []
    present = np.flatnonzero(counts)
    left = int(counts.sum())

    def largest(limit: int) -> int:
        """The largest length at most ``limit`` that still has pieces (0: none)."""
        while True:
            i = np.searchsorted(present, limit, side="right") - 1
            return int(present[i]) if i >= 0 and present[i] > 0 else 0

    def take(length: int, sign: int = -1):
        nonlocal present
        counts[length] += sign
        if counts[length] == 0 or (sign > 0 and counts[length] == 1):
            present = np.flatnonzero(counts)

    while left:
        held, gap = [], capacity
        while gap and (n := largest(gap)):
            take(n)
            held.append(n)
            gap -= n
        left -= len(held)
        if gap and left >= 2:
            room = gap + held[-1]
            # The two unpacked pieces that fill the expanded gap most tightly.
            low = present[present < room]
            if len(low):
                fit = present[np.maximum(np.searchsorted(present, room - low, side="right") - 1, 0)]
                total = np.where(fit <= room - low, low + fit, 0)
                total[(fit == low) & (counts[low] < 2)] = 0
                i = int(np.argmax(total))
                if held[-1] < total[i] <= room:
                    take(held[-1], +1)
                    held.pop()
                    for n in (int(low[i]), int(fit[i])):
                        take(n)
                        held.append(n)
                    left -= 1
        bins.append(held)
    return bins


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each row."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            cols = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            coded = coder.encode_many([t if isinstance(t, str) else "" for t in batch["text"]])
            for doc, ids in zip(batch["doc_id"], coded):
                ids = np.append(ids, np.uint32(closing)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    cols["doc_id"].append(doc)
                    cols["piece"].append(piece)
                    cols["start"].append(start)
                    cols["length"].append(len(part))
                    cols["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    cols["ids"].append(part.astype(np.int32) if with_ids else None)
            out = pd.DataFrame({k: v for k, v in cols.items() if with_ids or k != "ids"})
            out["doc_id"] = pd.array(cols["doc_id"], "Int64")
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return columns_free_of(docs, "doc_id", "text").mapInPandas(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text) with sequence_id and offset."""
    spark = docs.sparkSession
    text_batches(spark)
    pieces = token_pieces(docs, path, capacity, closing, with_ids)
    # A token holds a byte at least: this many pieces or fewer.
    most = docs.agg(F.count("*") + F.coalesce(F.sum(F.expr(f"octet_length(text) div {capacity}")), F.lit(0))).first()[0]
    shards = max(1, most // SHARD_PIECES)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", F.spark_partition_id()), F.lit(shards)))

    def place(key, frame):
        length = frame["length"].to_numpy()
        # Ties are placed in the order of ids, so a retried task gives the same rows.
        order = np.lexsort((frame["ids_crc32"], frame["piece"], frame["doc_id"].fillna(-1).to_numpy(np.int64), length))
        counts = np.bincount(length, minlength=capacity + 1)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        used = np.zeros(capacity + 1, np.int64)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for b, held in enumerate(plan_bins(counts, capacity)):
            at = 0
            for n in held:
                row = order[first[n] + used[n]]
                used[n] += 1
                sequence[row], offset[row] = b * shards + int(key[0]), at
                at += n
        return frame.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    schema = pieces.drop("shard").schema.simpleString()[len("struct<") : -1] + ", sequence_id:long, offset:long"
    return pieces.groupBy("shard").applyInPandas(place, schema)
