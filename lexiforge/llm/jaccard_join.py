"""N-gram Jaccard join with adaptive multi-match prefixes.

Method.  Every text becomes a set of hashed word n-grams.  Under one global order of
the members, if two sets overlap in at least ``ceil(t * max(a, b))`` members, their
first ``size - ceil(t * size) + l`` members share at least ``l`` (for any l up to both
prefixes' own).  So a longer prefix buys a stronger test: each document picks the
``l`` with the least estimated cost from the document frequencies of its prefix
members, and a pair is verified only if it shares ``min(l_x, l_y)`` of them.

1. Texts with equal sets fold into one set (``sid``), whatever the copies' number.
2. Coarse prune, in hash order: a set of which fewer than ``l`` members of the
   ``l``-prefix occur in any other set's prefix is out.
3. What remains is weighed over whole sets: members of one set only come first, then
   the others from rare to frequent.  A set that shares less than it needs is out;
   the others choose their ``l``.
4. Star round: each set is compared with the most central holder of its prefix
   members.  Sets so linked need no pairs among themselves.
5. Pair round: sets of different stars that share enough prefix members.  Where
   a member has many holders, tiles of sets meet tiles (each meeting one matrix
   product) and return a spanning forest of their links.
6. Components follow by distributed label propagation.

Defined cases.  Null or wordless text: ``n_shingles`` 0, linked with nothing.
Null doc_id: the row takes part, and its component is named by the smallest id that
is not null, or null.  Repeated rows give repeated rows.  Texts that repeat a
doc_id are compared each.  Very long texts are hashed whole, a row at a time.  Ties of
cost or rank are broken by hash and name; they change which pairs are tried, never the
components.  An empty table gives an empty result.
Extra columns are ignored.  Hash collisions of 64-bit members are neglected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batches_of, columns_free_of, deal, dealt_runs, give_back, mix, shingle_sets, table_ceil, text_batches

#: A prefix member with more holders than this is compared tile against tile.
PAIR_HOLDERS = 100
#: Set members and sets in a tile, about.
TILE_MEMBERS, TILE_SETS = 1 << 17, 256
#: Members in a part when sets are weighed, about.
PART_MEMBERS = 1 << 19


def _need(n, num: int, den: int):
    """Members that a partner must share: ceil(t * n)."""
    return -(-num * n // den)


def _extra(n):
    """The longest multi-match extension offered to a set of n members."""
    return 1 + n // 12


def _rows(batch: pd.DataFrame, size: int = 64):
    for i in range(0, len(batch), size):
        yield batch.iloc[i : i + size]


def _set_name(s: np.ndarray) -> int:
    """64-bit name of a set of hashed members."""
    with np.errstate(over="ignore"):
        name = mix(np.array([s.sum(dtype=np.uint64) * np.uint64(3) + mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(name.view(np.int64)[0])


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n, sid (64-bit name of the set), prefix (its first members), key if there is one."""
    keyed = "key" in docs.columns

    def run(batches):
        for batch in batches:
            for part in _rows(batch):
                ids, ns, sids, prefixes = [], [], [], []
                for doc, s in zip(part["doc_id"], shingle_sets(as_bytes(part["text"]), n)):
                    k = len(s)
                    ids.append(doc)
                    ns.append(k)
                    sids.append(_set_name(s) if k else None)
                    prefixes.append(s[: min(k, k - _need(k, num, den) + _extra(k))].view(np.int64))
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": ns, "sid": pd.array(sids, "Int64"), "prefix": prefixes} | ({"key": part["key"].to_numpy()} if keyed else {}))

    return docs.mapInPandas(run, "doc_id long, n long, sid long, prefix array<long>" + ", key long" * keyed)


def _prune(num: int, den: int):
    """Sets whose multi-match counts leave room for a partner."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, ranks in zip(batch["n"], batch["ranks"]):
                need = _need(n, num, den)
                # A partner may be as small as ceil(t * n): it offers this many.
                l = np.arange(1, _extra(need) + 1)
                count = np.searchsorted(np.sort(ranks), np.minimum(n - need + l, n))
                keep.append(bool((count >= l).all()))
            yield batch.loc[np.array(keep, bool), ["sid", "n"]]

    return run


def _weigh(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sid, n, l, far, heads (the chosen prefix's shared members), body (all shared members).

    Parts of about PART_MEMBERS members send each distinct member once with its count;
    buckets add the counts up and answer; the sets of a part are then ordered.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts, buckets = table_ceil(spark, total, PART_MEMBERS), table_ceil(spark, total, 2 * PART_MEMBERS)
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(parts)))

    def distinct(frame):
        give_back()
        flat = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(m, np.uint64) for m in frame["members"]]])
        members, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        return members, at, counts, *deal(members, buckets)

    def count(key, frame):
        members, _, counts, order, bucket = distinct(frame)
        rows = []
        for b, begin, end in dealt_runs(bucket):
            take = order[begin:end]
            rows.append((b, int(key[0]), members[take].tobytes(), counts[take].astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "part", "members", "counts"])

    def add_up(frame):
        if not len(frame):
            return pd.DataFrame(columns=["part", "bucket", "places", "counts"])
        members = [np.frombuffer(m, np.uint64) for m in frame["members"]]
        sizes = [len(m) for m in members]
        _, at = np.unique(np.concatenate(members), return_inverse=True)
        sums = np.bincount(at, np.concatenate([np.frombuffer(c, np.uint32) for c in frame["counts"]])).astype(np.int64)[at]
        rows, done = [], 0
        for part, bucket, k in zip(frame["part"], frame["bucket"], sizes):
            mine = sums[done : done + k]
            done += k
            places = np.flatnonzero(mine > 1)
            if len(places):
                rows.append((int(part), int(bucket), places.astype(np.uint32).tobytes(), mine[places].tobytes()))
        return pd.DataFrame(rows, columns=["part", "bucket", "places", "counts"])

    def choose(key, frame, answers):
        rows = []
        if len(frame):
            members, at, _, order, dealt_to = distinct(frame)
            df = np.ones(len(members), np.int64)
            edge = np.searchsorted(dealt_to, answers["bucket"].to_numpy())
            for begin, places, counts in zip(edge, answers["places"], answers["counts"]):
                df[order[begin + np.frombuffer(places, np.uint32)]] = np.frombuffer(counts, np.int64)
            done = 0
            for sid, n in zip(frame["sid"], frame["n"]):
                mine = at[done : done + n]
                done += n
                mine = mine[df[mine] > 1]
                spare = n - _need(n, num, den) - (n - len(mine))
                if spare < 0:
                    continue
                ranked = mine[np.argsort(df[mine], kind="stable")]
                # The first spare + l shared members are the l-prefix without the set's own.
                l = np.arange(1, max(1, min(len(mine) - spare, n // 4)) + 1)
                mass = np.cumsum(df[ranked])[np.minimum(spare + l, len(mine)) - 1]
                best = int(l[int(np.argmin(mass + (mass / l) * (8 + n / 64)))])
                rows.append((sid, n, best, 1 - len(mine) / n, members[ranked[: spare + best]].view(np.int64), members[mine].tobytes()))
        return pd.DataFrame(rows, columns=["sid", "n", "l", "far", "heads", "body"])

    told = dealt.groupBy("part").applyInPandas(count, "bucket int, part long, members binary, counts binary").groupBy("bucket").applyInPandas(add_up, "part long, bucket int, places binary, counts binary")
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(choose, "sid long, n long, l int, far double, heads array<long>, body binary")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) whose whole sets pass the threshold."""
    a = sets.select(F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("body").alias("mx"))
    b = sets.select(F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("body").alias("my"))

    def run(batches):
        for batch in batches:
            ok = []
            for m, n, p, q in zip(batch["nx"], batch["ny"], batch["mx"], batch["my"]):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                ok.append(den * both >= num * (m + n - both))
            ok = np.array(ok, bool)
            yield batch.loc[ok, ["x", "y"]]

    return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", "mx", "my").mapInPandas(run, "x long, y long")


def _forest(left, right, ok):
    """Edges of a spanning forest of the links (a, b) marked in ``ok``."""
    root: dict[int, int] = {}

    def find(v):
        while root.get(v, v) != v:
            root[v] = v = root.get(root[v], root[v])
        return v

    out = []
    for i, j in zip(*np.nonzero(ok)):
        a, b = find(int(left[i])), find(int(right[j]))
        if a != b:
            root[a] = b
            out.append((int(left[i]), int(right[j])))
    return out


def _tile_links(num: int, den: int):
    def run(batches):
        for batch in batches:
            edges = []
            for same, xs, nx, mx, ys, ny, my in zip(*[batch[c] for c in ("same", "sids", "ns", "bodies", "sids2", "ns2", "bodies2")]):
                sets = [np.frombuffer(m, np.uint64) for m in (*mx, *my)]
                k, sizes, full = len(xs), np.array([len(m) for m in sets]), np.array([*nx, *ny], np.int64)
                values, column = np.unique(np.concatenate(sets), return_inverse=True)
                row = np.repeat(np.arange(len(sets)), sizes)
                here = np.bincount(column[row < k], minlength=len(values)) > 0
                there = np.bincount(column[row >= k], minlength=len(values)) > 0
                place = np.cumsum(here & there) - 1
                used = (here & there)[column]
                row, column = row[used], place[column[used]]
                both = np.zeros((k, len(sets) - k), np.float32)
                for at in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
                    part = (column >= at) & (column < at + 4096)
                    hold = np.zeros((len(sets), 4096), np.float32)
                    hold[row[part], column[part] - at] = 1
                    both += hold[:k] @ hold[k:].T
                both = both.astype(np.int64)
                ok = den * both >= num * (full[:k, None] + full[None, k:] - both)
                edges += _forest(xs, ys, np.triu(ok, 1) if same else ok)
            yield pd.DataFrame({"x": np.array([e[0] for e in edges], np.int64), "y": np.array([e[1] for e in edges], np.int64)})

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) over the nodes of ``edges`` (x, y); label: smallest node reachable.

    Each round takes the least label among neighbours (partial minima, no
    neighbour lists) and then jumps to the label's label, until nothing moves.
    """
    both = scratch.cut(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = scratch.cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        met = scratch.cut(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")))
        jump = met.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = scratch.cut(met.join(jump, "label", "left").select("node", "was", F.coalesce(F.least("label", "next"), "label").alias("label")))
        moved = new.filter("label <> was").limit(1).count()
        scratch.drop(met, labels)
        labels = new.select("node", "label")
        labels._lexiforge_path = new._lexiforge_path
        if not moved:
            scratch.drop(both)
            return labels


def text_key(text="text"):
    """64-bit name of a text, that tells texts under one doc_id apart."""
    return F.xxhash64(text)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, heads: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two texts link when ``den * intersection >= num * union`` of their word n-gram sets.
    ``heads`` adds ``key`` (the text's key) and ``head``: whether (doc_id, key) is the least
    of its component, null ids last.  Texts without words are heads.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = columns_free_of(docs, "doc_id", "text")
    text_batches(spark)

    signed = scratch.cut(_signatures(docs.withColumn("key", text_key()) if heads else docs, n, num, den))
    me = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    top = [F.min(me).alias("top")] if heads else []
    names = scratch.cut(signed.filter("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), *top))
    owned = signed.filter("n > 0").join(names.select("sid", "rep"), "sid").filter("doc_id = rep")
    # Sets without any id: one row of each.
    nameless = signed.filter("n > 0 AND doc_id IS NULL").dropDuplicates(["sid"]).join(names.filter("rep IS NULL").select("sid"), "sid", "left_semi")
    held = owned.select("sid", "n", "prefix").union(nameless.select("sid", "n", "prefix"))
    tokens = scratch.cut(held.select("sid", "n", F.posexplode("prefix").alias("rank", "h")))
    shared = scratch.cut(tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    held = tokens.join(shared, "h").groupBy("sid", "n").agg(F.collect_list("rank").alias("ranks"))
    chosen = scratch.cut(held.mapInPandas(_prune(num, den), "sid long, n long"))
    scratch.drop(tokens, shared)

    # Whole sets of those that remain, from their texts.
    want = names.join(chosen.select("sid"), "sid", "left_semi").select("sid", F.col("rep").alias("doc_id"))

    def whole(batches):
        for batch in batches:
            for part in _rows(batch):
                sets = shingle_sets(as_bytes(part["text"]), n)
                # An id may have other texts than the one that is wanted.
                mine = [(sid, len(s), s.tobytes()) for sid, s in zip(part["sid"], sets) if len(s) and _set_name(s) == sid]
                yield pd.DataFrame(mine, columns=["sid", "n", "members"])

    def unnamed(batches):
        for batch in batches:
            for part in _rows(batch):
                sets = [s for s in shingle_sets(as_bytes(part["text"]), n) if len(s)]
                yield pd.DataFrame({"sid": [_set_name(s) for s in sets], "n": [len(s) for s in sets], "members": [s.tobytes() for s in sets]})

    kind = "sid long, n long, members binary"
    full = docs.join(want, "doc_id").select("sid", "text").mapInPandas(whole, kind)
    full = full.union(docs.filter("doc_id IS NULL").select("text").mapInPandas(unnamed, kind).dropDuplicates(["sid"]))
    full = scratch.cut(full.join(chosen, ["sid", "n"], "left_semi").dropDuplicates(["sid"]))
    weighed = scratch.cut(_weigh(full, num, den))
    scratch.drop(full)
    chosen, sets = weighed.select("sid", "n", "l"), weighed.select("sid", "n", "body")
    posts = scratch.cut(weighed.select("sid", "n", "l", "far", F.explode("heads").alias("h")))

    # Star round.
    best = F.min(F.struct("far", "sid", "n")).alias("top")
    lead = scratch.cut(posts.groupBy("h").agg(best, F.count("*").alias("df")).filter("df > 1").select("h", "df", F.col("top.sid").alias("y"), F.col("top.n").alias("ny")))
    fits = F.least("n", "ny") * den >= F.greatest("n", "ny") * num
    star = posts.join(lead, "h").filter((F.col("sid") != F.col("y"))).groupBy(F.col("sid").alias("x"), "y", fits.alias("fits")).count()
    star = scratch.cut(star.groupBy("x").agg(F.max(F.struct("fits", "count", "y")).alias("m")).select("x", "m.y", "m.fits"))
    with batches_of(spark, 64):
        linked = scratch.cut(_verify(star.filter("fits").select("x", "y"), sets, num, den))

    # What is left to compare: holders of one prefix member under different stars.
    label = linked.select(F.col("x").alias("sid"), F.col("y").alias("star"))
    mine = scratch.cut(chosen.select("sid", "n", "l").join(label, "sid", "left").select("sid", "n", "l", F.coalesce("star", "sid").alias("star")))
    mine = scratch.cut(posts.select("sid", "h").join(mine, "sid"))
    mixed = scratch.cut(mine.groupBy("h").agg(F.min("star").alias("lo"), F.max("star").alias("hi"), F.count("*").alias("df")).filter("lo <> hi").select("h", "df"))
    mine = scratch.cut(mine.join(mixed, "h"))

    # Members with few holders: single pairs, by the multi-match count.
    rare = mine.filter(F.col("df") <= PAIR_HOLDERS)
    x = rare.select("h", *[F.col(c).alias(f"{c}_x") for c in ("sid", "n", "l", "star")])
    y = rare.select(F.col("h").alias("g"), *[F.col(c).alias(f"{c}_y") for c in ("sid", "n", "l", "star")])
    met = x.join(y, (x.h == y.g) & (F.col("sid_x") < F.col("sid_y")) & (F.col("star_x") != F.col("star_y")) & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num))
    pairs = met.groupBy(F.col("sid_x").alias("x"), F.col("sid_y").alias("y")).agg(F.count("*").alias("c"), F.min(F.least("l_x", "l_y")).alias("l")).filter("c >= l").select("x", "y")
    pairs = scratch.cut(pairs)
    with batches_of(spark, 64):
        pairs = scratch.cut(_verify(pairs, sets, num, den))

    # Members with many holders: tiles of sets whose commonest member is the same.
    hot = mine.filter(F.col("df") > PAIR_HOLDERS)
    tiles = hot.groupBy("sid", "n").agg(F.max(F.struct("df", "h")).alias("m")).select("sid", "n", F.col("m.h").alias("home"))
    chunks = tiles.groupBy("home").agg(F.ceil(F.greatest(F.sum("n") / TILE_MEMBERS, F.count("*") / TILE_SETS)).alias("chunks"))
    tiles = tiles.join(chunks, "home").select("sid", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("chunks"))).alias("tile"))
    tiles = scratch.cut(tiles)
    touch = hot.select("h", "sid").join(tiles, "sid").select("h", "tile").distinct()
    touch = scratch.cut(touch)
    other = touch.select("h", F.col("tile").alias("other"))
    facing = scratch.cut(touch.join(other, "h").filter("tile <= other").select("tile", "other").distinct())
    bodies = scratch.cut(tiles.join(sets, "sid").groupBy("tile").agg(F.collect_list(F.struct("sid", "n", "body")).alias("all")).select("tile", F.col("all.sid").alias("sids"), F.col("all.n").alias("ns"), F.col("all.body").alias("bodies")))
    right = bodies.select(F.col("tile").alias("other"), F.col("sids").alias("sids2"), F.col("ns").alias("ns2"), F.col("bodies").alias("bodies2"))
    blocks = facing.join(bodies, "tile").join(right, "other").select((F.col("tile") == F.col("other")).alias("same"), "sids", "ns", "bodies", "sids2", "ns2", "bodies2")
    with batches_of(spark, 4):
        tiled = scratch.cut(blocks.mapInPandas(_tile_links(num, den), "x long, y long"))
    links = scratch.cut(linked.union(pairs).union(tiled))

    labels = components(links, scratch)
    least = labels.withColumnRenamed("node", "sid").join(names.drop("n"), "sid")
    least = scratch.cut(least)
    low = least.groupBy("label").agg(F.min("rep").alias("component"), *([F.min("top").alias("first")] if heads else []))
    placed = names.drop("n").join(least.select("sid", "label"), "sid", "left").join(low, "label", "left")
    placed = scratch.cut(placed.select("sid", F.coalesce("component", "rep").alias("component"), *([F.coalesce("first", "top").alias("first")] if heads else [])))
    scratch.finish(signed, placed)
    head = ["key", F.coalesce(me == F.col("first"), F.lit(True)).alias("head")] if heads else []
    return signed.drop("prefix").join(placed, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *head,
    )
