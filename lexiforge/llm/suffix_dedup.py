"""Suffix-array dedup by distributed prefix doubling.

A byte goes when a ``span``-byte string that covers it also starts in a document with a
smaller doc_id.  Positions are ranked by growing prefixes: the rank of 2h bytes at p comes
from the pair (rank of h at p, rank of h at p + h).  Ranks agree on all executors because
they are fingerprints of those pairs; Spark sorts the (rank, rank at the next offset) pairs
of the positions that are still shared, and unique ones leave.

* Offsets 1, 2, 4 and so on up to the largest power of two within ``span`` need no
  exchange: they stay inside a text.
* At ``anchor`` bytes (32 for a span of 50) each window of ``span`` bytes is represented by
  one of its positions, that of the least rank, which equal windows share.  Positions whose
  rank only one part of the table holds, in one document, leave: three bytes a position.
* For the rest, Spark sorts pairs of ranks at the two ends of the *run* of windows that
  share the position (a pair at the offset run length - 32).  A run that also starts in a
  smaller document goes whole.  A run that is the smallest document's leaves too, unless
  its position has several runs.
* The windows of those last runs are reranked one by one: Spark sorts the pairs of ranks at
  p and p + span - 32, and the smallest document of each pair decides.

Documents are dealt into parts of about ``PART_BYTES`` by hash.  A part sends each rank or
pair once with its smallest document, so a passage held by a third of all rows is one entry
of each part, and texts travel compressed.  A position held by more than ``HOT`` parts (the end of such a passage, with
another run in each document) is not sorted as one group: its runs are spread by their own
rank, and all count as several.  What a part has decided travels with its pairs, so the
rounds follow each other without meeting earlier ones again.

Equality is that of 128 bits: two 64-bit ranks for windows and for runs of hot positions;
for other runs 64 bits among the few runs that share one 64-bit position.

Defined cases.  Null text: empty.  Null doc_id: returned whole, and takes nothing from
others.  Rows that repeat a doc_id: equal ids take nothing from each other.  Texts under
``span`` bytes stay whole; very long ones are ranked in overlapping pieces of bounded size.
Ties of ranks are broken by place within the window, so equal windows choose alike.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, as_bytes, deal, dealt_runs, give_back, mix, passes, table_ceil, text_batches, total_bytes

PART_BYTES = 4 << 20
#: Bytes of text ranked in one numpy pass; longer texts are cut into overlapping pieces.
PASS = 1 << 19
BUCKET_BYTES = 8 << 20
#: Bytes of text that a task holds while it deals its rows into parts.
DEAL_BYTES = 32 << 20
#: Text whose pairs one sorting task takes, about.
SORT_BYTES = 16 << 20
#: Positions held by more parts than this are spread by their runs.
HOT = 100
#: Low bits of a key that hold the position within a pass (at most 2 * PASS bytes).
PLACE_BITS = 28
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _pair(rank: np.ndarray, h: int, k: int) -> np.ndarray:
    """Ranks of 2h bytes from pairs of ranks of h bytes; k: the round."""
    with np.errstate(over="ignore"):
        return rank[:-h] * (_K[k % 4] | np.uint64(2 * k + 1)) + (rank[h:] ^ (rank[h:] >> np.uint64(29)))


def _spread(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit rank of several."""
    with np.errstate(over="ignore"):
        out = columns[0] * _K[0]
        for i, c in enumerate(columns[1:], 1):
            out = mix(out) + c.astype(np.uint64) * (_K[i % 4] | np.uint64(1))
    return mix(out)


def _within(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1 .. for each of ``many`` places."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)


class _Pass:
    """Positions, runs and ranks of some pieces of texts."""

    def __init__(self, pieces: list[bytes], docs: np.ndarray, span: int):
        self.span, self.whole = span, 1 << (span.bit_length() - 1)
        anchor = self.whole if 2 * span >= 3 * self.whole else self.whole // 2
        length = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(length)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = len(data)
        self.name = self.first = self.last = np.zeros(0, np.uint64)
        self.begin = self.stop = self.doc = np.zeros(0, np.int64)
        good = np.flatnonzero(length >= span)
        if not len(good):
            return
        rank, h, k = _BYTE[data], 1, 0
        while h < self.whole:
            if h == anchor:
                order = mix(rank.copy())
            rank, h, k = _pair(rank, h, k), 2 * h, k + 1
        self.rank = rank
        if anchor == self.whole:
            order = mix(rank.copy())
        low = order >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(order), dtype=np.uint64)
        width, h = span - anchor + 1, 1
        while 2 * h <= width:
            low = np.minimum(low[:-h], low[h:])
            h *= 2
        if h < width:
            low = np.minimum(low[: len(low) - (width - h)], low[width - h :])
        # Runs: windows of one position, cut where a piece's windows begin and end.
        edges = np.concatenate((np.flatnonzero(low[1:] != low[:-1]) + 1, self.ends - length, np.maximum(self.ends - span + 1, 0)))
        edges = np.unique(edges)
        begin, stop = edges, np.append(edges[1:], len(low)) - 1
        owner = np.searchsorted(self.ends, begin, side="right")
        fits = (owner < len(length)) & (stop >= begin)
        fits[fits] = stop[fits] + span <= self.ends[owner[fits]]
        self.begin, self.stop, owner = begin[fits], stop[fits], owner[fits]
        position = (low[self.begin] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        # Least ranks are small numbers: mixed again, they spread evenly.
        self.doc, self.name = docs[owner], mix(order[position])
        # Ranks at both ends of a run, with where its position and its end lie.
        self.first = _spread(rank[self.begin], position - self.begin)
        self.last = _spread(rank[self.stop + span - self.whole], self.stop - self.begin)

    def pairs(self, at: np.ndarray):
        """The ranks at p and p + span - whole, which tell windows apart."""
        return mix(self.rank[at]), mix(self.rank[at + self.span - self.whole] ^ _K[2])


def _distinct(doc: np.ndarray, *ranks: np.ndarray):
    """(number of each row's distinct ranks, first row of each in the order of ``doc``)."""
    order = np.lexsort((doc, *ranks))
    new = np.ones(len(order), bool)
    new[1:] = False
    for r in ranks:
        new[1:] |= r[order][1:] != r[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


class _Part:
    """The documents of one part in the order of their ids."""

    def __init__(self, frame: pd.DataFrame, span: int):
        give_back()
        rows = [row for blob in frame["blob"] for row in pickle.loads(zstandard.decompress(blob))]
        texts = [t for _, t, _ in rows]
        null = np.array([i is None for i, _, _ in rows], bool)
        ids = np.array([0 if i is None else i for i, _, _ in rows], np.int64)
        order = sorted(range(len(ids)), key=lambda i: (null[i], ids[i], texts[i]))
        self.carried = [rows[i][2] for i in order]
        self.texts, self.ids, self.null = [texts[i] for i in order], ids[order], null[order]
        # (document, where the piece begins, the piece): windows of a document lie in one piece each.
        self.pieces = [(k, at, t[at : at + PASS + span - 1]) for k, t in enumerate(self.texts) if not self.null[k] and len(t) >= span for at in range(0, len(t) - span + 1, PASS)]
        self.passes, self.spans = [], []
        for a, b in passes([len(p[2]) for p in self.pieces], PASS):
            some = self.pieces[a:b]
            self.passes.append(_Pass([p[2] for p in some], np.array([p[0] for p in some], np.int64), span))
            self.spans.append((a, b))
        gather = lambda f, kind: np.concatenate([np.zeros(0, kind), *[getattr(p, f) for p in self.passes]]).astype(kind)
        self.name, self.first, self.last = gather("name", np.uint64), gather("first", np.uint64), gather("last", np.uint64)
        self.doc = gather("doc", np.int64)
        self.id = self.ids[self.doc]
        #: The run's rank among the runs of its position.
        self.run = _spread(self.first, self.last)

    def names(self):
        """(distinct positions, number of each run's position)."""
        return np.unique(self.name, return_inverse=True)

    def survivors(self, kept: np.ndarray, hot: np.ndarray):
        """Runs that stay shared: their rows, (number of each, first row of each distinct run), keys."""
        names, at = self.names()
        at = at.ravel()
        rows = np.flatnonzero(kept[at])
        key = self.name[rows].copy()
        spread = hot[at[rows]]
        # Runs of hot positions are groups of their own.
        key[spread] = _spread(key[spread], self.first[rows][spread])
        group, first = _distinct(self.doc[rows], self.run[rows], key)
        return rows, group, first, key, spread

    def windows(self, marks: np.ndarray):
        """(pass, place, document, both ranks) of the windows of the marked runs."""
        found, done = [], 0
        for i, p in enumerate(self.passes):
            which = np.flatnonzero(marks[done : done + len(p.doc)])
            done += len(p.doc)
            if len(which):
                many = p.stop[which] - p.begin[which] + 1
                at = _within(p.begin[which], many)
                found.append((np.full(len(at), i), at, np.repeat(p.doc[which], many), *p.pairs(at)))
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        return [np.concatenate([np.zeros(0, k), *[f[j] for f in found]]).astype(k) for j, k in enumerate(kinds)]


def _part_of(doc, text: bytes, parts: int) -> int:
    """The part of a row.  Rows that repeat both id and text cannot be told apart, so the
    partition they were read from deals them, too."""
    key = np.array([doc or 0, zlib.crc32(text), TaskContext.get().partitionId()], np.int64).view(np.uint64)
    return int(_spread(key[:1], key[1:2], key[2:])[0] % np.uint64(parts))


def _deal(docs: DataFrame, parts: int) -> DataFrame:
    """part, blob: rows (doc_id, text, carried) of one part, compressed together."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def send():
            packed = [(part, zstandard.compress(pickle.dumps(rows), 3)) for part, rows in held.items()]
            held.clear()
            return pd.DataFrame(packed, columns=["part", "blob"])

        for batch in batches:
            ids, carried = batch["doc_id"].astype("Int64"), batch["carried"] if "carried" in batch else [None] * len(batch)
            for doc, text, rest in zip(ids, as_bytes(batch["text"]), carried):
                doc = None if doc is pd.NA else int(doc)
                held.setdefault(_part_of(doc, text, parts), []).append((doc, text, rest))
                size += len(text)
                if size > DEAL_BYTES:
                    yield send()
                    size = 0
        if held:
            yield send()

    text_batches(docs.sparkSession)
    return docs.mapInPandas(run, "part long, blob binary")


def _packed(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps of three bytes, or four where one is too wide."""
    steps = np.diff(values, prepend=0).astype("<u4")
    width = 3 if not len(steps) or steps.max() < 1 << 24 else 4
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.zeros(((len(data) - 1) // data[0], 4), np.uint8)
    steps[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint64)


#: place: the part, then the pair's number in it from 1 (0: the part's own row, which carries
#: what it has decided), then whether the rank counts as one of several runs.
_PAIRS = "rank long, next long, low long, place long, state binary"
_NAMES = [x.split()[0] for x in _PAIRS.split(", ")]
_LOW32 = 0xFFFFFFFF


def _pairs(part: int, rank, after, low, several, state: bytes) -> pd.DataFrame:
    n = len(rank)
    mine = mix(np.array([part], np.uint64))
    place = part << 32 | np.append(np.arange(1, n + 1) << 1 | several, 0)
    return pd.DataFrame(dict(zip(_NAMES, (np.append(rank, mine).view(np.int64), np.append(after, mine).view(np.int64), np.append(low, 0), place, [None] * n + [state]))))


def _sorted(pairs: DataFrame, tasks: int, runs: bool) -> DataFrame:
    """Spark sorts the pairs: the smallest document of each decides.  Answered are those of
    larger documents, which go, and with ``runs`` the smallest document's where its rank has
    several (``place`` odd); what needs no answer leaves."""
    order = Window.partitionBy("rank", "next").orderBy("low")
    out = pairs.repartition(tasks, "rank").withColumn("least", F.first("low").over(order))
    own, several, first = F.col("state").isNotNull(), F.lit(False), F.col("least") == F.col("low")
    if runs:
        group = Window.partitionBy("rank")
        out = out.withColumn("many", F.min("next").over(group) != F.max("next").over(group))
        several = F.col("many") | (F.col("place") % 2 == 1)
    out = out.filter(own | ~first | several)
    pair = F.shiftright(F.col("place").bitwiseAND(F.lit(_LOW32)), 1).cast("int")
    return out.select(F.shiftright("place", 32).alias("part"), (2 * pair + F.when(first, 1).otherwise(0)).cast("int").alias("place"), "state")


def _own(answers: pd.DataFrame):
    """What a part has decided, and the numbers of its pairs that go and of those with several."""
    mine = answers["state"].notna().to_numpy()
    place = answers["place"].to_numpy(np.int64)[~mine]
    return answers["state"][mine].iloc[0], (place[place & 1 == 0] >> 1) - 1, (place[place & 1 == 1] >> 1) - 1


def _bits(*flags: np.ndarray) -> bytes:
    return b"".join(np.packbits(f).tobytes() for f in flags)


def _flags(data: bytes, n: int, count: int):
    step = -(-n // 8)
    if not n:
        return [np.zeros(0, bool)] * count
    return [np.unpackbits(np.frombuffer(data, np.uint8, step, i * step), count=n).astype(bool) for i in range(count)]


def suffix_dedup(docs: DataFrame, span: int = 50, carry: str | None = None, as_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, kept (binary), spans (removed runs).

    ``carry`` names a string column that comes along unchanged (as ``carried``).
    ``as_text`` gives ``text`` in place of ``kept``, without what is left of a cut character.
    """
    if span < 2:
        raise ValueError("a span has two bytes at least")
    spark = docs.sparkSession
    left, many = "text" if as_text else "kept", HOT
    docs = docs.select("doc_id", "text", *([F.col(carry).alias("carried")] if carry else []))
    size = total_bytes(docs)
    parts, buckets, tasks = (table_ceil(spark, size, n) for n in (PART_BYTES, BUCKET_BYTES, SORT_BYTES))
    dealt = _deal(docs, parts).repartition(parts, "part")
    # Positions are compared in their bucket by their leading 32 bits there, which ascend with them.
    shift = np.uint64(max(0, ((1 << 64) // buckets).bit_length() - 32))

    def positions(key, frame):
        """A part's positions by bucket, three or four bytes each."""
        names, _ = _Part(frame, span).names()
        order, bucket = deal(names, buckets)
        rows = [(b, int(key[0]), _packed(names[order[begin:end]] // np.uint64(buckets) >> shift)) for b, begin, end in dealt_runs(bucket)]
        return pd.DataFrame(rows, columns=["bucket", "part", "names"])

    def holders(frame):
        """Of one bucket: which positions several parts hold, and which very many."""
        names = [_unpacked(x) for x in frame["names"]]
        if not names:
            return pd.DataFrame(columns=["part", "bucket", "held"])
        _, at, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        count = np.split(count[at.ravel()], np.cumsum([len(x) for x in names])[:-1])
        return pd.DataFrame({"part": frame["part"], "bucket": frame["bucket"], "held": [_bits(c > 1, c > many) for c in count]})

    def runs(key, frame, answers):
        """Pairs of the runs whose positions are shared, in the part or beyond."""
        if not len(frame):
            return pd.DataFrame(columns=_NAMES)
        part = _Part(frame, span)
        names, at = part.names()
        order, bucket = deal(names, buckets)
        shared, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
        told = dict(zip(answers["bucket"], answers["held"]))
        for b, begin, end in dealt_runs(bucket):
            shared[order[begin:end]], hot[order[begin:end]] = _flags(told[b], end - begin, 2)
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, at.ravel(), part.id)
        np.maximum.at(high, at.ravel(), part.id)
        kept = shared | (low < high)
        rows, _, first, rank, spread = part.survivors(kept, hot)
        return _pairs(int(key[0]), rank[first], part.run[rows][first], part.id[rows][first], spread[first], _bits(kept, hot))

    def decided(part: _Part, answers: pd.DataFrame):
        """Which runs go whole, and which are reranked window by window."""
        state, go, stay = _own(answers)
        kept, hot = _flags(state, len(part.names()[0]), 2)
        rows, group, first, _, _ = part.survivors(kept, hot)
        gone, several = np.zeros(len(first), bool), np.zeros(len(first), bool)
        gone[go], several[stay] = True, True
        whole, marks = np.zeros(len(part.doc), bool), np.zeros(len(part.doc), bool)
        whole[rows] = gone[group] | (part.id[rows] > part.id[rows][first][group])
        # Copies of a run in larger documents go whole: what is left is its smallest document's.
        marks[rows] = several[group] & ~whole[rows]
        return whole, marks

    def windows(key, frame, answers):
        if not len(frame):
            return pd.DataFrame(columns=_NAMES)
        part = _Part(frame, span)
        whole, marks = decided(part, answers)
        _, _, doc, rank, after = part.windows(marks)
        _, first = _distinct(doc, after, rank)
        return _pairs(int(key[0]), rank[first], after[first], part.ids[doc[first]], np.zeros(len(first), bool), _bits(whole, marks))

    def finish(key, frame, answers):
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "n_bytes", left, "spans", *["carried"] * bool(carry)])
        part = _Part(frame, span)
        state, go, _ = _own(answers)
        whole, marks = _flags(state, len(part.doc), 2)
        in_pass, at, doc, rank, after = part.windows(marks)
        group, first = _distinct(doc, after, rank)
        gone = np.zeros(len(first), bool)
        gone[go] = True
        gone = gone[group] | (part.ids[doc] > part.ids[doc[first]][group])
        out, done = {}, 0
        for i, (p, (a, b)) in enumerate(zip(part.passes, part.spans)):
            cover = np.zeros(p.size + 1, np.int32)
            w = whole[done : done + len(p.doc)]
            done += len(p.doc)
            fine = at[gone & (in_pass == i)]
            for begin, stop in ((p.begin[w], p.stop[w] + span), (fine, fine + span)):
                np.add.at(cover, begin, 1)
                np.add.at(cover, stop, -1)
            removed = np.cumsum(cover[:-1]) > 0
            for (k, start, piece), end in zip(part.pieces[a:b], p.ends):
                mine = removed[end - len(piece) : end]
                if mine.any():
                    out.setdefault(k, np.zeros(len(part.texts[k]), bool))[start : start + len(piece)] |= mine
        rows = []
        for k, text in enumerate(part.texts):
            size, spans = len(text), []
            if k in out:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], out[k].view(np.int8), [0]))))
                spans = [{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)]
                text = np.frombuffer(text, np.uint8)[~out[k]].tobytes()
            if as_text:
                text = text.decode("utf-8", "ignore")
            rows.append((None if part.null[k] else int(part.ids[k]), size, text, spans, part.carried[k]))
        ids = pd.array([r[0] for r in rows], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_bytes": [r[1] for r in rows], left: [r[2] for r in rows], "spans": [r[3] for r in rows]} | ({"carried": [r[4] for r in rows]} if carry else {}))

    texts = dealt.groupBy("part")
    held = texts.applyInPandas(positions, "bucket int, part long, names binary").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(holders, "part long, bucket int, held binary")
    step = lambda answers, f, schema: texts.cogroup(answers.repartition(parts, "part").groupBy("part")).applyInPandas(f, schema)
    told = _sorted(step(held, runs, _PAIRS), tasks, True)
    told = _sorted(step(told, windows, _PAIRS), tasks, False)
    schema = f"doc_id long, n_bytes long, {'text string' if as_text else 'kept binary'}, spans array<struct<start:long,stop:long>>" + ", carried string" * bool(carry)
    return step(told, finish, schema)
