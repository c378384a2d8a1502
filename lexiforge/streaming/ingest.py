"""The batch transforms over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..plans.store import Store


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select(basename(F.col("path")).alias("name"), "content")


def ingest_batch(store: Store, checkpoint: str, client: str, bot_id: str, collection: str, images: str = ""):
    """What a micro-batch does.  Its key is the stream's checkpoint and its number: a batch
    that is replayed after a failure stores nothing twice."""

    def add(batch: DataFrame, number: int):
        store.ingest(client, bot_id, batch, collection, images, batch=f"{checkpoint}#{number}")

    return add


def ingest_stream(store: Store, files: DataFrame, client: str, bot_id: str, collection: str, checkpoint: str, images: str = ""):
    """A query that ingests every micro-batch; its checkpoint lets it go on after a failure."""
    add = ingest_batch(store, checkpoint, client, bot_id, collection, images)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
