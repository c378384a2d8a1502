"""Quality classifier: random Fourier features over document statistics.

Statistics of the whole text (byte classes, words, repeats, lines) are
standardised; random Fourier features approximate a Gaussian kernel over them.
Every partition sums its normal equations, the ridge weights follow from the sum,
and isotonic regression turns ridge scores into probabilities.  The calibration is
fitted on scores that each half of the training rows gets from the other half.

Labels are learnt from at most ``sample`` labelled rows (a hash of the id picks
them) that are not held out, one of each id; statistics and scores cover every row.

Defined cases.  Null and empty texts have the statistics of an empty text and get a
score.  A null doc_id counts as held out.  Repeated rows are scored each.  Null
labels are no labels; of repeated labels the smallest counts.  With no labels, or
labels of one kind only, every score is their mean (0.5 without any).  Very long texts
are read whole, by passes of bounded size.  Equal ridge scores get equal probabilities;
rows that tie keep no order of their own.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PICK, Scratch, as_bytes, columns_free_of, held_out, passes, pick_below, text_batches, word_hashes

SAMPLE = 20_000
FEATURES = 256
RIDGE = 1e-2
#: Tasks that sum the bounded training rows.
FIT_PARTS = 8

_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", b"\t\r", b".", b",", b"!", b"?", b"|", b"%$#*&@^~", b"<>", b"{}()[];=", b"\"'`", b"-_/\\+", b":", range(128, 256)]


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics per text."""
    out = []
    for a, b in passes([len(t) for t in texts]):
        part = texts[a:b]
        h, owner, size = word_hashes(part, lower=False)
        edge = np.searchsorted(owner, np.arange(len(part) + 1))
        for i, t in enumerate(part):
            n = max(1, len(t))
            hist = np.bincount(np.frombuffer(t, np.uint8), minlength=256) if t else np.zeros(256)
            share = hist[hist > 0] / n
            row = [np.log1p(len(t)), float(-(share * np.log2(share)).sum())]
            row += [hist[list(c)].sum() / n for c in _CLASSES]
            w, z = h[edge[i] : edge[i + 1]], size[edge[i] : edge[i + 1]]
            k = max(1, len(w))
            counts = np.unique(w, return_counts=True)[1]
            same = float((w[1:] == w[:-1]).sum()) / k
            row += [np.log1p(len(w)), z.mean() if len(z) else 0.0, z.std() if len(z) else 0.0, len(counts) / k, (counts.max() if len(counts) else 0) / k, same]
            lines = [x for x in t.split(b"\n") if x.strip()]
            m = max(1, len(lines))
            row += [len(set(lines)) / m, np.log1p(n / m), np.log1p(len(lines))]
            out.append(row)
    return np.array(out, np.float64).reshape(len(texts), -1)


def statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            stats = text_statistics(as_bytes(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "stats": list(stats)})

    text_batches(docs.sparkSession)
    return columns_free_of(docs, "doc_id", "text").mapInPandas(run, "doc_id long, stats array<double>")


def isotonic(score: np.ndarray, label: np.ndarray):
    """Pool adjacent violators: (knots, values), values not falling."""
    x, at, weight = np.unique(score, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum, weight, first score
    for s, w, v in zip(x, weight.astype(float), np.bincount(at, label.astype(float))):
        blocks.append([v, w, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, _ = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += w2
    knots = np.array([b[2] for b in blocks])
    # Clipping keeps probabilities off 0 and 1 and the order as it is.
    edge = 0.5 / (len(score) + 1)
    return knots, np.clip([b[0] / b[1] for b in blocks], edge, 1 - edge)


class Model:
    """Ridge regression on random Fourier features, calibrated."""

    def __init__(self, mean, scale, dims: int, features: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        # Bandwidth: the square root of the number of standardised statistics.
        self.w = rng.standard_normal((dims, features)) / np.sqrt(dims)
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.values = np.zeros(1), np.full(1, 0.5)

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if len(self.values) == 1:
            return np.full(len(stats), self.values[0])
        if not len(stats):
            return np.zeros(0)
        at = np.searchsorted(self.knots, self.ridge(stats), side="right") - 1
        return self.values[np.maximum(at, 0)]


def _sums(rows: DataFrame, of, length: int) -> np.ndarray:
    """Sum over all rows of ``of(stats, label, half)``, one partial per partition (FIT_PARTS)."""

    def run(batches):
        total = np.zeros(length)
        for batch in batches:
            if len(batch):
                total += of(np.vstack(batch["stats"]), batch["label"].to_numpy(float), batch["half"].to_numpy())
        yield pd.DataFrame({"total": [total]})

    parts = rows.mapInPandas(run, "total array<double>").collect()
    return np.sum([np.array(p[0]) for p in parts], axis=0) if parts else np.zeros(length)


def fit(stats: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model from the rows of ``stats`` that carry ``label`` in ``labels``."""
    scratch = Scratch(stats.sparkSession, "quality")
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    # One row of each id: an id that fills the table must not fill the sample.
    rows = stats.join(marks.filter(~held_out()), "doc_id").groupBy("doc_id", "label").agg(F.min("stats").alias("stats"))
    rows = scratch.cut(rows.select("stats", "label", F.xxhash64("doc_id").alias("h")))
    total = rows.count()
    if total > sample:
        # Hashes are uniform: this keeps about ``sample`` rows.
        rows = rows.filter(F.pmod("h", F.lit(PICK)) < pick_below(sample, total))
    rows = rows.select("stats", "label", F.pmod(F.shiftright("h", 52), F.lit(2)).alias("half"))
    # The sample is written by as many tasks as hold it and then read by a few, so that few partial sums meet.
    rows = scratch.cut(rows).coalesce(FIT_PARTS)
    first = rows.first()
    if first is None:
        scratch.finish()
        return Model(np.zeros(1), np.ones(1), 1, 1)
    dims = len(first["stats"])
    s = _sums(rows, lambda x, y, _: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * dims)
    n, positive = s[0], s[1]
    mean = s[2 : 2 + dims] / n
    model = Model(mean, np.sqrt(np.maximum(s[2 + dims :] / n - mean**2, 1e-12)) + 1e-6, dims, features)
    d = features + 1

    def normal(x, y, half):
        out = []
        for k in (0, 1):
            z = model.lift(x[half == k])
            out += [(z.T @ z).ravel(), z.T @ y[half == k]]
        return np.concatenate(out)

    s = _sums(rows, normal, 2 * (d * d + d)).reshape(2, -1)
    solve = lambda t: np.linalg.solve(t[: d * d].reshape(d, d) + RIDGE * np.eye(d), t[d * d :])
    apart = [solve(s[1]), solve(s[0])]  # each half is scored by the other's weights
    model.weights = solve(s[0] + s[1])

    def score(batches):
        for batch in batches:
            if len(batch):
                z, half = model.lift(np.vstack(batch["stats"])), batch["half"].to_numpy()
                yield pd.DataFrame({"score": np.where(half == 0, z @ apart[0], z @ apart[1]), "label": batch["label"]})

    scored = rows.mapInPandas(score, "score double, label int").toPandas()
    if 0 < positive < n:
        model.knots, model.values = isotonic(scored["score"].to_numpy(), scored["label"].to_numpy())
    else:
        model.values = np.full(1, positive / n)
    scratch.finish()
    return model


def scores(model: Model, text: str = "text"):
    """A column of scores of whole texts, for filters that keep every other column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(text_statistics(as_bytes(texts))))

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    stats = Scratch(docs.sparkSession, "quality-stats").cut(statistics(docs))
    model = fit(stats, labels, label)

    def run(batches):
        for batch in batches:
            x = np.vstack(batch["stats"]) if len(batch) else np.zeros((0, 1))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(x)})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
