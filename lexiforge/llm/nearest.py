"""Approximate nearest neighbours: stable projections, a kd-tree and a chi-square stop.

Unit vectors are projected to at most ``DIMS`` orthogonalised Gaussian (2-stable)
directions, so a coordinate of the difference of two projections is normal with their
squared distance as its variance, and the squared projected distance over the squared
distance follows a chi-square law.

* A bounded sample (``SAMPLE`` vectors) gives one global kd-partition of the projections
  into cells of about ``CELL`` vectors; every vector of the table is dealt to its cell.
* A query first searches its own cell.  The k-th neighbour found there bounds the
  distance of what is missing, hence the normal law of its projection around the query's
  and the probability that it lies in a given cell.  The query then visits the likeliest
  other cells, until they hold ``MASS`` of that probability.
* Within a cell, a kd-tree offers projected neighbours by growing distance.  They are
  verified on the original vectors, ``STEP`` at a time, until the next one is so far that
  a vector nearer than the k-th found would have come before with probability ``SURE``.

One exchange of the table serves each of the two rounds.  Cells that turn out larger are
cut into blocks, and many queries of a cell into chunks, so no task holds more than a
few thousand of either.  Equal vectors of an Arrow batch travel as one row with their
k + 1 smallest ids, which suffice; equal queries are searched once.

Defined cases.  Vectors that are null, empty, zero, or that hold null or non-finite
components take no part; vectors are compared with those of the same length.  Fewer
candidates than k: all of them.  Ties go to the smaller id.  Rows with a null id take no
part; of repeated ids the most similar row counts.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PICK, Scratch, pick_below

#: Projected dimensions, and the probabilities of the stop within and between cells.
DIMS, SURE, MASS = 32, 0.86, 0.98
#: Vectors in a cell, cells at most (larger cells are cut into blocks), vectors sampled.
CELL, CELLS, SAMPLE = 8192, 4096, 32_768
#: Queries in a chunk, points in a leaf, points verified between two tests.
CHUNK, LEAF, STEP = 4096, 32, 16


def chi_square(x: np.ndarray, dims: int):
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


@lru_cache
def _quantile(p: float, dims: int) -> float:
    dims += dims % 2
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), dims) < p else (low, mid)
    return high


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (a rational approximation, error under 2e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = tail * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    return np.where(x < 0, tail, 1 - tail)


@lru_cache
def projection(length: int) -> np.ndarray:
    directions = np.linalg.qr(np.random.default_rng(11).standard_normal((length, min(DIMS, length))))[0]
    return directions * np.sqrt(length)


def project(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None] @ projection(rows.shape[1])


class Cells:
    """A kd-partition of projected space, by medians of a sample."""

    def __init__(self, points: np.ndarray, cells: int):
        # Per inner node: axis, cut, the axis' bounds there, and two children (cells: ~number).
        self.nodes: list[tuple] = []
        self.count = 0
        self.root = self._grow(points, cells, {})

    def _grow(self, points, cells, box) -> int:
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        if cells < 2 or not spread.max():
            self.count += 1
            return ~(self.count - 1)
        axis = int(np.argmax(spread))
        cut = float(np.quantile(points[:, axis], (cells // 2) / cells))
        low, high = box.get(axis, (-np.inf, np.inf))
        at = len(self.nodes)
        self.nodes.append(())
        side = points[:, axis] < cut
        left = self._grow(points[side], cells // 2, box | {axis: (low, cut)})
        right = self._grow(points[~side], cells - cells // 2, box | {axis: (cut, high)})
        self.nodes[at] = (axis, cut, low, high, left, right)
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                axis, cut, _, _, left, right = self.nodes[node]
                side = points[rows, axis] < cut
                todo += [(left, rows[side]), (right, rows[~side])]
        return out

    def mass(self, points: np.ndarray, variance: np.ndarray) -> np.ndarray:
        """Per point and cell: the share of a normal law around the point that lies in it."""
        out, todo = np.zeros((len(points), self.count)), [(self.root, np.ones(len(points)))]
        scale = np.sqrt(np.maximum(variance, 1e-12))
        while todo:
            node, mass = todo.pop()
            if node < 0:
                out[:, ~node] = mass
                continue
            axis, cut, low, high, left, right = self.nodes[node]
            at = [_normal((x - points[:, axis]) / scale) for x in (low, cut, high)]
            whole = np.maximum(at[2] - at[0], 1e-12)
            todo += [(left, mass * np.clip((at[1] - at[0]) / whole, 0, 1)), (right, mass * np.clip((at[2] - at[1]) / whole, 0, 1))]
        return out


class Tree:
    """A kd-tree over projected points: leaves of at most LEAF points and their boxes."""

    def __init__(self, points: np.ndarray):
        self.points = points
        todo, leaves = [np.arange(len(points))], []
        while todo:
            at = todo.pop()
            spread = points[at].max(0) - points[at].min(0) if len(at) else np.zeros(1)
            if len(at) <= LEAF or not spread.max():
                leaves.append(at)
                continue
            axis = int(np.argmax(spread))
            order = at[np.argsort(points[at, axis], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.leaves = [x for x in leaves if len(x)]
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])

    def gaps(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of every leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - p, p - self.high))
        return (gap * gap).sum(1)

    def within(self, p: np.ndarray, leaves: np.ndarray, radius: float):
        """(point, squared distance) in the leaves up to a squared radius, nearest first."""
        at = np.concatenate([self.leaves[i] for i in leaves])
        gap = self.points[at] - p
        far = np.einsum("ij,ij->i", gap, gap)
        if radius < np.inf:
            at, far = at[far <= radius], far[far <= radius]
        order = np.argsort(far, kind="stable")
        return at[order], far[order]


def cosines(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores wherever they are."""
    return (rows * q).sum(1) / (norms * norm)


class Block:
    """Distinct vectors with their smallest ids, searched one query at a time."""

    def __init__(self, rows: np.ndarray, holders: list[np.ndarray], k: int, sure: float):
        self.rows, self.holders, self.k = rows, holders, k
        self.norms = np.sqrt((rows * rows).sum(1))
        self.tree = Tree(project(rows))
        self.limit = _quantile(sure, min(DIMS, rows.shape[1]))

    def search(self, q: np.ndarray, p: np.ndarray, bar: float):
        """((-score, id) of the k + 1 best, vectors verified); ``bar``: the score to beat."""
        best: list[tuple[float, int]] = []
        norm, verified = float(np.sqrt((q * q).sum())), 0

        def verify(take):
            nonlocal best, verified
            verified += len(take)
            score = cosines(self.rows[take], self.norms[take], q, norm)
            least = -best[-1][0] if len(best) > self.k else -np.inf
            near = np.flatnonzero(score >= least)
            if len(near) > self.k + 1:
                # Of distinct vectors, k + 1 and those that tie with the last can count.
                near = near[score[near] >= np.partition(score[near], len(near) - self.k - 1)[len(near) - self.k - 1]]
            found = [(-float(score[i]), int(v)) for i in near for v in self.holders[take[i]]]
            best = sorted({*best, *found})[: self.k + 1]

        def radius():
            held = -best[-1][0] if len(best) > self.k else -np.inf
            held = max(held, bar)
            return self.limit * max(0.0, 2 - 2 * held) if held > -np.inf else np.inf

        gaps = self.tree.gaps(p)
        # The nearest leaf gives a first bar where none is carried.
        seen = np.zeros(0, np.int64)
        if radius() == np.inf:
            seen = self.tree.within(p, [int(np.argmin(gaps))], np.inf)[0][: 2 * self.k + 2]
            verify(seen)
        reach = radius()
        leaves = np.flatnonzero(gaps <= reach)
        if len(leaves):
            order, far = self.tree.within(p, leaves, reach)
            if len(seen):
                new = ~np.isin(order, seen)
                order, far = order[new], far[new]
            for at in range(0, len(order), STEP):
                if far[at] > radius():
                    break
                verify(order[at : at + STEP])
        return best, verified


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, sure: float = SURE, mass: float = MASS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine of each row whose id is
    divisible by ``every``, among all rows of ``vectors`` (vec_id, embedding); ``verified``:
    how many vectors were compared with the query."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(fine & F.exists("embedding", lambda x: x != 0))
    counts = {r[0]: r[1] for r in v.groupBy(F.size("embedding").alias("n")).count().collect()}
    if not counts:
        return _empty(vectors)
    total = sum(counts.values())
    some = v.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(PICK)) < pick_below(SAMPLE, total)).select("embedding").limit(2 * SAMPLE).toPandas()["embedding"]
    sampled: dict[int, list] = {}
    for row in some:
        sampled.setdefault(len(row), []).append(row)
    maps = {n: Cells(project(np.vstack(sampled[n])) if n in sampled else np.zeros((0, min(DIMS, n))), min(CELLS, -(-count // CELL))) for n, count in counts.items()}

    def place(batches):
        """Distinct vectors of a batch with their cell, smallest ids, and ids that ask."""
        for batch in batches:
            lengths = batch["embedding"].map(len).to_numpy()
            out = []
            for n in np.unique(lengths):
                mine = batch[lengths == n]
                rows, back = np.unique(np.vstack(mine["embedding"]), axis=0, return_inverse=True)
                back, ids = back.ravel(), mine["vec_id"].to_numpy(np.int64)
                order = np.lexsort((ids, back))
                for row, cell, held in zip(rows, maps[int(n)].place(project(rows)), np.split(ids[order], np.searchsorted(back[order], np.arange(1, len(rows))))):
                    held = np.unique(held)
                    out.append((int(n), int(cell), row.tobytes(), held[: k + 1], held[held % every == 0]))
            yield pd.DataFrame(out, columns=["length", "cell", "vec", "ids", "asks"])

    scratch = Scratch(spark, "nearest")
    index = scratch.cut(v.mapInPandas(place, "length int, cell int, vec binary, ids array<long>, asks array<long>"))
    asked = index.filter(F.size("asks") > 0).select("length", "cell", "vec", "asks")
    index = index.select("length", "cell", "vec", "ids")

    def search(key, frame):
        names = ["query_id", "vec_id", "score", "verified", "bar"]
        q = frame["asks"].notna().to_numpy()
        if q.all() or not q.any():
            return pd.DataFrame(columns=names)
        ids: dict[bytes, list] = {}
        for vec, held in zip(frame["vec"][~q], frame["ids"][~q]):
            ids.setdefault(bytes(vec), []).append(held)
        rows = np.frombuffer(b"".join(ids), np.float64).reshape(len(ids), -1)
        block = Block(rows, [np.unique(np.concatenate(h))[: k + 1] for h in ids.values()], k, sure)
        asks: dict[bytes, list] = {}
        for vec, held, bar in zip(frame["vec"][q], frame["asks"][q], frame["bar"][q]):
            asks.setdefault(bytes(vec), []).append((held, bar))
        out = []
        asked = np.frombuffer(b"".join(asks), np.float64).reshape(len(asks), -1)
        for x, p, held in zip(asked, project(asked), asks.values()):
            # Equal queries have equal bars but for their own ids: the least serves all.
            bar = min((-np.inf if b != b else b) for _, b in held)
            best, verified = block.search(x, p, bar)
            for qid in np.unique(np.concatenate([h for h, _ in held])):
                mine = [(s, i) for s, i in best if i != qid][:k]
                out.append((qid, None, None, verified, -mine[-1][0] if len(mine) == k else None))
                out += [(qid, i, -s, 0, None) for s, i in mine]
        out = pd.DataFrame(out, columns=names)
        return out.assign(vec_id=out["vec_id"].astype("Int64"))

    def round_of(queries):
        """Every query (length, cell, vec, asks, bar) against the vectors of its cell."""
        blocks = index.groupBy("length", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("blocks"))
        chunks = queries.groupBy("length", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        # As many rows as there are cells: CELLS for each length at most.
        sizes = F.broadcast(blocks.join(chunks, ["length", "cell"]))
        dealt = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = index.join(sizes, ["length", "cell"]).withColumn("block", dealt("blocks")).withColumn("chunk", each("chunks"))
        right = queries.join(sizes, ["length", "cell"]).withColumn("chunk", dealt("chunks")).withColumn("block", each("blocks"))
        both = left.drop("blocks", "chunks").unionByName(right.drop("blocks", "chunks"), allowMissingColumns=True)
        found = both.groupBy("length", "cell", "block", "chunk").applyInPandas(search, "query_id long, vec_id long, score double, verified long, bar double")
        return scratch.cut(found)

    found = round_of(asked.withColumn("bar", F.lit(None).cast("double")))
    kept = [found]
    if any(m.count > 1 for m in maps.values()):
        bars = found.filter("vec_id IS NULL").groupBy("query_id").agg(F.max("bar").alias("bar"))
        single = asked.select("length", "cell", "vec", F.explode("asks").alias("query_id")).distinct().join(bars, "query_id", "left")

        def visits(batches):
            for batch in batches:
                out = []
                for n, mine in batch.groupby("length"):
                    points = project(np.frombuffer(b"".join(mine["vec"]), np.float64).reshape(len(mine), -1))
                    bar = mine["bar"].to_numpy(float)
                    share = maps[int(n)].mass(points, np.where(np.isnan(bar), 4.0, 2 - 2 * bar))
                    order = np.argsort(-share, axis=1, kind="stable")
                    before = np.cumsum(np.take_along_axis(share, order, 1), 1) - np.take_along_axis(share, order, 1)
                    # Without k neighbours so far, every cell is visited.
                    go = (before < mass) | np.isnan(bar)[:, None]
                    i, j = np.nonzero(go)
                    cell = order[i, j]
                    away = cell != mine["cell"].to_numpy()[i]
                    i, cell = i[away], cell[away]
                    if len(i):
                        out.append(pd.DataFrame({"length": int(n), "cell": cell, "vec": mine["vec"].to_numpy()[i], "asks": [[x] for x in mine["query_id"].to_numpy()[i]], "bar": bar[i]}))
                if out:
                    yield pd.concat(out)

        more = scratch.cut(single.mapInPandas(visits, "length int, cell int, vec binary, asks array<long>, bar double"))
        kept.append(round_of(more))
        found = found.union(kept[1])
    scratch.finish(*kept)
    # A row without vec_id counts what a visit verified.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("verified"))
    mine = Window.partitionBy("query_id")
    ranked = best.withColumn("rank", F.row_number().over(mine.orderBy(F.desc_nulls_last("score"), "vec_id"))).withColumn("verified", F.sum("verified").over(mine))
    return ranked.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
