"""Exact nearest-neighbour search over arrays.

Only ids and vectors take part in scoring; payloads are joined to the few rows that
remain.  ``orderBy().limit()`` keeps k rows a task (TakeOrderedAndProject).  A query's
tokens are literals of the plan: they are bounded by the query's length (``TOKENS``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, norm, rescale

#: Tokens of one query at most.
TOKENS = 1024


def tenant(client: str = "", bot_id: str = "") -> Column:
    """Equality on the tenants that are named; rows without a tenant then fall out."""
    named = [F.col(c) == v for c, v in (("client", client), ("bot_id", bot_id)) if v]
    return reduce(lambda a, b: a & b, named, F.lit(True))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def token_vectors(tokens: DataFrame) -> list[list[float]]:
    """The vectors of a query's tokens (token, query), in order; more than TOKENS are refused."""
    rows = tokens.orderBy("token").limit(TOKENS + 1).collect()
    if len(rows) > TOKENS:
        raise ValueError(f"a query has at most {TOKENS} tokens")
    return [r["query"] for r in rows]


def cosine_topk(points: DataFrame, vector: str, query: Column, k: int, key: str) -> DataFrame:
    """key, score (six places): the k most similar points, ties by key."""
    scored = points.select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), key).limit(k)


def _similarity(tokens: list[list[float]]):
    """``of(vector, i)``: cosine to a token, whose length is taken out beforehand."""
    lengths = [sum(float(x) * float(x) for x in q) ** 0.5 for q in tokens]
    units = [literal([x / n for x in q]) if n else F.lit(None).cast("array<double>") for q, n in zip(tokens, lengths)]
    return lambda vector, i: dot(vector, units[i]) / F.nullif(norm(vector), F.lit(0.0))


def maxsim(vectors: Column, tokens: list[list[float]]) -> Column:
    """For every query token the best of the row's own vectors, summed: no shuffle."""
    of = _similarity(tokens)
    best = lambda i: F.array_max(F.transform(vectors, lambda v: of(v, i)))
    return F.round(reduce(lambda a, b: a + b, map(best, range(len(tokens)))), 6)


def maxsim_scores(points: DataFrame, tokens: list[list[float]], key: str, vector: str = "vector") -> DataFrame:
    """key, score: :func:`maxsim` where a point has a row (key, vector) for each vector; the
    best of each token is a partial maximum, in one grouping."""
    of = _similarity(tokens)
    best = [F.max(of(F.col(vector), i)).alias(f"best_{i}") for i in range(len(tokens))]
    total = reduce(lambda a, b: a + b, [F.col(f"best_{i}") for i in range(len(tokens))])
    return points.groupBy(key).agg(*best).select(key, F.round(total, 6).alias("score"))


def topk(scored: DataFrame, k: int, key: str) -> DataFrame:
    return scored.filter("score is not null").orderBy(F.desc("score"), key).limit(k)


def mean_pool(patches: DataFrame, keep: str, key: str = "page", vector: str = "vector") -> DataFrame:
    """key, keep, vector: element-wise mean of the vectors that share ``keep`` (a row or
    column number).  One grouping with a partial mean for each dimension."""
    first = patches.select(F.size(vector).alias("n")).filter("n > 0").first()
    dims = first["n"] if first else 0
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"mean_{i}") for i in range(dims)]
    pooled = patches.groupBy(key, keep).agg(F.count("*").alias("patches"), *means)
    return pooled.select(key, keep, F.array(*[f"mean_{i}" for i in range(dims)]).cast("array<double>").alias("vector"))


def page_vectors(patches: DataFrame, specials: DataFrame, keep: str, key: str = "page") -> DataFrame:
    """key, vectors: the pooled vectors in the order of ``keep``, then the vectors of the
    tokens that are no image patches (``specials``: key, place, vector)."""
    pooled = mean_pool(patches, keep, key).select(key, F.lit(0).alias("kind"), F.col(keep).cast("long").alias("at"), "vector")
    extra = specials.select(key, F.lit(1).alias("kind"), F.col("place").cast("long").alias("at"), F.col("vector").cast("array<double>").alias("vector"))
    # A page's vectors meet in its own row only.
    rows = pooled.unionByName(extra).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "at", "vector"))).alias("rows"))
    return rows.select(key, F.transform("rows", lambda r: r["vector"]).alias("vectors"))


def prefetch_rerank(pages: DataFrame, pooled: list[str], original: str, tokens: list[list[float]], prefetch: int, k: int, key: str) -> DataFrame:
    """Candidates are the best ``prefetch`` rows by each of the ``pooled`` columns (arrays of
    vectors); the original vectors rank their union."""
    found = [topk(pages.select(key, maxsim(F.col(c), tokens).alias("score")), prefetch, key).select(key) for c in pooled]
    # At most ``prefetch`` ids for each pooled column.
    ids = reduce(lambda a, b: a.union(b), found).distinct()
    return topk(pages.join(F.broadcast(ids), key, "left_semi").select(key, maxsim(F.col(original), tokens).alias("score")), k, key)


def merge(hits: list[tuple[str, DataFrame]]) -> DataFrame:
    """modality, rank, rescaled score and the hits' other columns, best first; limits hold
    for each modality."""
    parts = []
    for name, df in hits:
        order = Window.partitionBy(F.lit(name)).orderBy(F.desc("score"), *[c for c in df.columns if c != "score"][:1])
        parts.append(df.withColumn("modality", F.lit(name)).withColumn("rank", F.row_number().over(order)).withColumn("score", F.round(rescale(F.col("score")), 6)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.orderBy(F.desc("score"), F.desc("modality"), "rank")
