"""File sources and the router by extension."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import basename, extension


class Routed(NamedTuple):
    text: DataFrame
    image: DataFrame
    rejected: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select(basename(F.col("path")).alias("name"), "content")


def route(files: DataFrame, config: Config = DEFAULT) -> Routed:
    """By extension, case kept: ``A.TXT`` is rejected.  Rejected files are returned with
    an error, so that one file cannot stop the others."""
    files = files.withColumn("ext", extension(F.col("name")))
    text, image = F.col("ext").isin(*config.text_formats), F.col("ext").isin(*config.image_formats)
    return Routed(files.filter(text), files.filter(image), files.filter(~(text | image)).withColumn("error", F.concat(F.lit("Unsupported file type: "), "ext")))
