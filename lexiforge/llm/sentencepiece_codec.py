"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is a lattice of vocabulary pieces.  A forward Viterbi pass gives the best
score to every place; it is the exact heuristic of a backward A* search, which
therefore pops complete segmentations in the order of their scores.

Pieces do not cross from a word into the next one's space, so the lattice falls
into words (checked against the vocabulary on loading; if a piece did, texts would
be one word each).  A word is segmented once per worker and remembered.  The N best
of a text differ from its best in the words where an alternative costs least: the
N - 1 cheapest single alternatives and their sums hold all N best.  The forward
pass also yields each word's cheapest alternative, so A* runs only where it can
matter.

Characters outside the vocabulary become their UTF-8 bytes' pieces, each scored
``BYTE_COST`` below the least piece.  The white-space sign itself is such a
character, so decoding gives back every text exactly.

Merge-rank models mark pieces that merges never make with a score of -1e9; such a piece
counts one below the least real score, so that sums of scores stay exact.

Defined cases.  Null and empty texts: no pieces, score 0, one segmentation.  Ties
of scores are broken by the earlier word and then the longer last pieces.  Long texts
are segmented whole; a text of one long word takes time and memory in proportion to it.
Null doc_ids are kept; repeated rows give equal values; an empty table an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import MEMORIES, columns_free_of, text_batches, turn_to

SIGN = "▁"
BYTE_COST = 10.0
#: Words remembered by one Python worker, and their characters; beyond it the memory starts anew.
WORDS_HELD, CHARS_HELD = 1_200_000, 24_000_000


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.shown: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.shown.append(b"")
            else:
                self.pieces[piece.replace(SIGN, " ")] = (i, score)
                self.shown.append(piece.replace(SIGN, " ").encode())
        # Some models mark pieces that merges never make with a score of -1e9: a rank below all others.
        least = min(s for _, s in self.pieces.values() if s > -1e8)
        self.pieces = {p: (i, max(s, least - 1)) for p, (i, s) in self.pieces.items()}
        self.least = least - BYTE_COST
        self.longest = max(map(len, self.pieces))
        self.whole = any(re.search(r"[^ ] |\n.|.\n", p) for p in self.pieces)
        # Marks that no piece has right after another character: the lattice falls apart before them.
        joined = {b for p in self.pieces for a, b in zip(p, p[1:]) if a != " " and a != b}
        apart = "".join(c for c in ",.;:!?|%$#&*" if c not in joined)
        marks = re.escape(apart) or r"\n"
        self.split = re.compile(f" *[{marks}]*[^ \n{marks}]+| *[{marks}]+| +|\n" if apart else " *[^ \n]+| +|\n")
        # Every beginning of a piece, with the piece's id and score if it is one itself.
        self.begun: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.begun.update(self.pieces)

    def words(self, text: str) -> list[str]:
        """A space goes before the text, as the model's dummy prefix."""
        if not text:
            return []
        return [" " + text] if self.whole else self.split.findall(" " + text)

    def edges(self, word: str, end: int):
        """(start, ids, score) of the pieces that end at ``end``."""
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            found = self.pieces.get(word[start:end])
            if found:
                yield start, (found[0],), found[1]
            elif end - start == 1:
                raw = word[start:end].encode("utf-8", "replace")
                yield start, tuple(self.byte[b] for b in raw), self.least * len(raw)

    def best_two(self, word: str):
        """(best score, ids, loss of the second best segmentation or infinity)."""
        begun, pieces, n = self.begun, self.pieces, len(word)
        low = -np.inf
        best, second, back = [0.0] + [low] * n, [low] * (n + 1), [0] * (n + 1)
        for start in range(n):
            top, next_best = best[start], second[start]
            for end in range(start + 1, n + 1):
                key = word[start:end]
                if key in begun:
                    found = begun[key]
                    if found:
                        score = found[1]
                    elif end == start + 1:
                        score = self.least * len(key.encode("utf-8", "replace"))
                    else:
                        continue
                elif end == start + 1:
                    score = self.least * len(key.encode("utf-8", "replace"))
                else:
                    break
                s, t = top + score, next_best + score
                was = best[end]
                if s > was:
                    best[end], back[end] = s, start
                    second[end] = was if was > t else t
                else:
                    if s > t:
                        t = s
                    if t > second[end]:
                        second[end] = t
        ids, end = [], n
        while end:
            start = back[end]
            found = pieces.get(word[start:end])
            if found:
                ids.append(found[0])
            else:
                ids += [self.byte[b] for b in reversed(word[start].encode("utf-8", "replace"))]
            end = start
        return best[n], ids[::-1], best[n] - second[n]

    def n_best(self, word: str, n: int):
        """The n best (score, ids), best first: backward A* under forward Viterbi scores."""
        size = len(word)
        ahead = [0.0] + [-np.inf] * size
        into = [()] + [tuple(self.edges(word, end)) for end in range(1, size + 1)]
        for end in range(1, size + 1):
            ahead[end] = max(ahead[s] + score for s, _, score in into[end])
        heap, out, tick = [(-ahead[size], 0, size, 0.0, None)], [], 1
        while heap and len(out) < n:
            _, _, place, tail, path = heapq.heappop(heap)
            if not place:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((tail, ids))
                continue
            for start, ids, score in into[place]:
                heapq.heappush(heap, (-(ahead[start] + score + tail), tick, start, score + tail, (ids, path)))
                tick += 1
        return out


class Codec:
    """Whole texts to ids and back; words are segmented once."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.score, self.loss = np.zeros(1 << 16), np.zeros(1 << 16)
        self.used = self.chars = 0
        self.others: dict[tuple[str, int], list] = {}

    def _learn(self, word: str):
        score, ids, loss = self.vocabulary.best_two(word)
        k, n = len(self.at), len(ids)
        if k == len(self.begin):
            for name in ("begin", "size", "score", "loss"):
                setattr(self, name, np.resize(getattr(self, name), 2 * k))
        if self.used + n > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids) + n)
        self.ids[self.used : self.used + n] = ids
        self.begin[k], self.size[k], self.score[k], self.loss[k] = self.used, n, score, loss
        self.at[word], self.used, self.chars = k, self.used + n, self.chars + len(word)

    def _n_best(self, word: str, n: int):
        """The vocabulary's n best of a word, remembered."""
        found = self.others.get((word, n))
        if found is None:
            found = self.others[word, n] = self.vocabulary.n_best(word, n)
            self.chars += len(word) * n
        return found

    def encode(self, text: str, n: int = 1):
        """(ids, scores) of the n best segmentations, best first (fewer if there are fewer)."""
        words = self.vocabulary.words(text)
        at = self.at
        new = set(words).difference(at)
        if at and (len(at) + len(new) > WORDS_HELD or self.chars > CHARS_HELD):
            self._forget()
            at, new = self.at, set(words)
        for w in new:
            self._learn(w)
        k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        size = self.size[k]
        begin = self.begin[k] - (np.cumsum(size) - size)
        ids = self.ids[np.repeat(begin, size) + np.arange(int(size.sum()))]
        best = float(self.score[k].sum())
        if n == 1 or not len(k):
            return [ids], [best]
        loss, stop = self.loss[k], np.cumsum(size)
        # The n - 1 least losses, earlier words first among equals.
        bar = np.partition(loss, n - 2)[n - 2] if len(loss) >= n else np.inf
        near = np.flatnonzero(loss <= bar)
        near = near[np.argsort(loss[near], kind="stable")][: n - 1]
        single = []
        for place in near:
            if np.isfinite(loss[place]):
                # Among ties the search may come upon another best than the forward pass.
                mine = ids[stop[place] - size[place] : stop[place]].tolist()
                found = self._n_best(words[place], n)
                rest = [(s, other) for s, other in found if other != mine][: n - 1]
                single += [(found[0][0] - s, int(place), r, other) for r, (s, other) in enumerate(rest)]
        single = sorted(single, key=lambda x: x[:3])[: n - 1]
        sums = []
        for r in range(1, n):
            for some in combinations(single, r):
                if len({s[1] for s in some}) == r:
                    sums.append((sum(s[0] for s in some), [s[1:3] for s in some], some))
        sums = sorted(sums, key=lambda x: x[:2])[: n - 1]
        # Other segmentations differ from the best in a few words.
        out = [ids]
        for _, _, changed in sums:
            parts, done = [], 0
            for _, place, _, other in sorted(changed, key=lambda x: x[1]):
                parts += [ids[done : stop[place] - size[place]], other]
                done = stop[place]
            out.append(np.concatenate([*parts, ids[done:]]).astype(np.int32))
        return out, [best, *[best - s[0] for s in sums]]

    def decode(self, ids) -> str:
        shown = self.vocabulary.shown
        return b"".join([shown[i] for i in ids])[1:].decode("utf-8", "replace")


_CODECS: dict[str, Codec] = MEMORIES.setdefault("sentencepiece", {})


def codec(path: str) -> Codec:
    turn_to("sentencepiece")
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, n: int = 4, with_ids: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_pieces and ids_crc32 of the best
    segmentation, segmentations (score, n_pieces, ids_crc32 and, ``with_ids``, the ids of
    the n best, best first), decoded_ok (decoding the best gives back the text)."""

    def run(batches):
        coder = codec(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                text = text if isinstance(text, str) else ""
                found, scores = coder.encode(text, n)
                said = [{"score": s, "n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())} | ({"ids": ids} if with_ids else {}) for s, ids in zip(scores, found)]
                rows.append((doc, len(found[0]), said[0]["ids_crc32"], said, coder.decode(found[0].tolist()) == text))
            out = pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "segmentations", "decoded_ok"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    text_batches(docs.sparkSession)
    one = "score:double,n_pieces:int,ids_crc32:long" + ",ids:array<int>" * with_ids
    return columns_free_of(docs, "doc_id", "text").mapInPandas(run, f"doc_id long, n_pieces int, ids_crc32 long, segmentations array<struct<{one}>>, decoded_ok boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from rows of (doc_id, ids)."""

    def run(batches):
        coder = codec(path)
        for batch in batches:
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [coder.decode(i) if i is not None else "" for i in batch["ids"]]})
            yield out

    return columns_free_of(encoded, "doc_id", "ids").mapInPandas(run, "doc_id long, text string")
