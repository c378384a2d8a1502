"""Sentence splitting by rule: after ., ! or ? and white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\x01"


def sentences(text: Column) -> Column:
    """array<string>; empty pieces dropped."""
    marked = F.regexp_replace(F.trim(text), r"([.!?])[ \t\n\x0B\f\r]+", "$1" + _MARK)
    return F.filter(F.split(marked, _MARK), lambda s: F.length(s) > 0)


def explode_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ix, sentence."""
    # Outer: for an inner explode Spark would split every text twice, to drop empty lists.
    return docs.select("doc_id", F.posexplode_outer(sentences(F.col("text"))).alias("sentence_ix", "sentence")).filter("sentence_ix IS NOT NULL")
