"""A training corpus in five stages: quality, toxicity, near duplicates, repeated
passages, packing.  Each stage takes (spark, docs, sf_dir); its result is written as
Parquet and read back as the next one's documents.

Defined cases are those of the operators; rows with a null doc_id are judged by
their text and packed; as near copies they come after those with an id.  Rows that repeat
a doc_id are rows of their own: none is dropped for another's text.  All but the last stage
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import jaccard_join, packing, quality, suffix_dedup, toxicity
from lexiforge.llm.common import Scratch, read, text_batches
from lexiforge.llm.registry import tokenizer_path

QUALITY, TOXIC = 0.3, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay."""
    scratch = Scratch(spark, "quality-stats")
    model = quality.fit(scratch.cut(quality.statistics(docs)), read(spark, sf_dir, "labels"), "quality")
    scratch.finish()
    return docs.filter(quality.scores(model) >= QUALITY)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold stay."""
    text_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"), "toxic")
    return docs.filter(toxicity.scores(model) < TOXIC)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays: that of the smallest
    doc_id, nulls last; then of the least key of its text; then of the least other columns."""
    scratch = Scratch(spark, "jaccard-gone")
    found = jaccard_join.jaccard_components(docs, n=5, num=80, den=100, heads=True)
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.max("head").alias("head"), F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    # (id, text) that goes, or that stays with one of several rows.
    told = scratch.cut(rows.filter("NOT head OR (rows > 1 AND n > 0)").select("_id", "_key", "head"))
    same = lambda t: docs["doc_id"].eqNullSafe(t["_id"]) & (jaccard_join.text_key(docs["text"]) == t["_key"])
    alone = docs.join(told, same(told), "left_anti")
    many = told.filter("head")
    if not many.limit(1).count():
        return alone
    one = docs.join(many, same(many), "left_semi").groupBy("doc_id", jaccard_join.text_key().alias("_key")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return alone.union(one.select("row.*"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that start in an earlier document go; what is left of a cut
    character goes too, and n_chars follows the text; a null text becomes empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", F.to_json(F.struct(*rest)).alias("rest")) if rest else docs
    out = suffix_dedup.suffix_dedup(carried, span=50, carry="rest" if rest else None, as_text=True)
    if rest:
        schema = docs.select(*rest).schema
        out = out.withColumn("rest", F.from_json("carried", schema))
    columns = []
    for c in docs.columns:
        if c in ("doc_id", "text"):
            columns.append(F.col(c))
        elif c == "n_chars":
            columns.append(F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"rest.{c}").alias(c))
    return out.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained classifiers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.cut(docs)
            # What the stage wrote on its way, and its input, are read by nothing any more.
            Scratch.sweep(docs)
    return docs
