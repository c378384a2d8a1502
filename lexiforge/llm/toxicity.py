"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents marked toxic; a sample of all marked documents, taken without
regard to the mark, is the unlabelled side.  With the class prior p, the risk of a linear model on word presence is
``p * R+(P) + max(0, R-(U) - p * R-(P))``: the part of the unlabelled risk that
positives account for is taken off, and a step that would drive the rest below
zero is taken backwards.  numpy trains the model with logistic loss.

Words are chosen by their frequency in at most ``POSITIVES`` positives against that in
all documents that are not held out; the steps of the gradient see these positives and
about ``UNLABELLED`` marked documents (a hash of the id picks them).  One row of each id
counts; every whole text is scored.

Defined cases.  Null and empty texts have no words and get the score of the bias
alone.  A null doc_id counts as held out.  Repeated rows are scored each.  Null
labels are no labels.  Without positives every score is 0 (to nine places).  Very long
texts are read whole, by passes of bounded size.  Texts of the same known words tie; words
that stand out alike are taken in the order of their hashes.  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PICK, as_bytes, columns_free_of, held_out, passes, pick_below, text_batches, word_hashes

POSITIVES = 3_000
UNLABELLED = 9_000
WORDS = 512
#: A word counts if it stands out by so many deviations, in so many positives.
STANDS_OUT, SEEN = 4.5, 3


def word_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashes of each text's bare lower-case words."""
    out = []
    for a, b in passes([len(t) for t in texts]):
        h, owner, _ = word_hashes(texts[a:b], bare=True)
        edge = np.searchsorted(owner, np.arange(b - a + 1))
        out += [np.unique(h[edge[i] : edge[i + 1]]) for i in range(b - a)]
    return out


class Model:
    def __init__(self, words=np.zeros(0, np.uint64), weights=np.zeros(0), bias=-20.0):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(sets), self.bias)
        if len(self.words):
            for i, s in enumerate(sets):
                at = np.searchsorted(self.words, s)
                at[at == len(self.words)] = 0
                z[i] += self.weights[at[self.words[at] == s]].sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.08, decay: float = 3e-5):
    """Weights and bias that minimise the non-negative risk (full batches, Adam)."""
    d = xp.shape[1]
    theta = np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        w = theta[:d].astype(np.float32)
        zp, zu = (xp @ w).astype(float) + theta[d], (xu @ w).astype(float) + theta[d]
        gp, gu = sigmoid(zp), sigmoid(zu)  # slopes of the negative-class loss
        grad = lambda x, g: np.append(g.astype(np.float32) @ x, g.sum()) / max(1, len(g))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = grad(xu, gu) - prior * grad(xp, gp)
        slope = prior * grad(xp, gp - 1) + negative if rest >= 0 else -negative
        slope[:d] += decay * theta[:d]
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], theta[d]


def _texts(docs: DataFrame) -> DataFrame:
    """One row of each id: an id that fills the table must not fill a sample."""
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"))


def _hits(texts, words: np.ndarray):
    """(text number, place in ``words``) of each text's distinct words among the sorted ``words``."""
    texts = as_bytes(texts)
    for a, b in passes([len(t) for t in texts]):
        h, owner, _ = word_hashes(texts[a:b], bare=True)
        at = np.searchsorted(words, h)
        at[at == len(words)] = 0
        found = words[at] == h
        both = np.unique((owner[found] + a) * len(words) + at[found])
        yield both // len(words), both % len(words)


def _frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """In how many rows of ``docs`` each of the words occurs: counts are added up by task first."""

    def run(batches):
        count = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, place in _hits(batch["text"], words):
                count += np.bincount(place, minlength=len(words))
        held = np.flatnonzero(count)
        yield pd.DataFrame({"place": held, "n": count[held]})

    out = np.zeros(len(words), np.int64)
    found = docs.select("text").mapInPandas(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out[found["place"].to_numpy(np.int64)] = found["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out())
    n, toxic = marks.agg(F.count("*"), F.sum("label")).first()
    if not toxic:
        return Model()
    prior = min(max(toxic / n, 1e-3), 0.9)
    h = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(PICK))
    # At most ``positives`` ids and about ``unlabelled``: bounded, so they may be broadcast.
    chosen = marks.filter("label = 1").select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(positives).select("doc_id", F.lit(True).alias("p"), F.lit(False).alias("u"))
    others = marks.filter(h < pick_below(unlabelled, n)).select("doc_id", F.lit(False).alias("p"), F.lit(True).alias("u"))
    sides = F.broadcast(chosen.union(others).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u")))
    docs = docs.select("doc_id", "text").filter(~held_out())
    ids, total = docs.groupBy("doc_id").count().agg(F.count("*"), F.sum("count")).first()

    def run(batches):
        for batch in batches:
            sets = word_sets(as_bytes(batch["text"]))
            words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": n, "texts": 0})
            yield pd.DataFrame({"word": [0], "n": [0], "texts": [len(sets)]})

    # Words are counted where they are; only those that recur among the positives come here.
    held = _texts(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).mapInPandas(run, "word long, n long, texts long")
    held = held.groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).filter(f"texts > 0 OR n >= {SEEN}").toPandas()
    size = int(held["texts"].sum())
    if not size:
        return Model()
    held = held[held["n"] >= SEEN]
    words = held["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, inp = words[order], held["n"].to_numpy(np.int64)[order] / size
    if not len(words):
        return Model(bias=float(np.log(prior / (1 - prior))))
    # Rows are ids unless some repeat; only then are texts brought together.
    inu = _frequencies(docs if total == ids else _texts(docs), words) / ids
    # Words that mark positives off from the rest most surely; rarer ones than the steps can see count as that rare.
    z = (inp - inu) / np.sqrt((inu + 1 / min(unlabelled, ids)) / size)
    keep = np.sort(np.argsort(-z, kind="stable")[:WORDS])
    keep = keep[z[keep] > STANDS_OUT]
    if not len(keep):
        return Model(bias=float(np.log(prior / (1 - prior))))
    words = words[keep]

    def pick(batches):
        for batch in batches:
            rows = [b""] * len(batch)
            for row, place in _hits(batch["text"], words):
                edge = np.flatnonzero(np.diff(row, prepend=-1))
                for r, held in zip(row[edge], np.split(place, edge[1:])):
                    rows[r] = held.astype(np.uint16).tobytes()
            yield pd.DataFrame({"p": batch["p"], "u": batch["u"], "held": rows})

    some = _texts(docs.join(sides, "doc_id", "left_semi").select("doc_id", "text"))
    rows = some.join(sides, "doc_id").select("p", "u", "text").mapInPandas(pick, "p boolean, u boolean, held binary").toPandas()
    p, u = rows["p"].to_numpy(bool), rows["u"].to_numpy(bool)
    if not u.any():
        return Model()
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, held in enumerate(rows["held"]):
        x[i, np.frombuffer(held, np.uint16)] = 1
    weights, bias = nnpu(x[p], x[u], prior)
    return Model(words, weights, float(bias))


def scores(model: Model, text: str = "text"):
    """A column of scores of whole texts, for filters that keep every other column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(word_sets(as_bytes(texts))))

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    docs = columns_free_of(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    model = fit(docs, labels, label)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(word_sets(as_bytes(batch["text"])))})

    scored = docs.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
