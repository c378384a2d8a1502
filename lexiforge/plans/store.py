"""Collections of points as Parquet files, and ingest, lookup, delete and search.

A collection is a folder of immutable files dealt by a bucket of doc_id, and a log of
numbered entries that say which of them count.  A write first completes its files and then
publishes one log entry by a rename that fails if the number is taken: readers see all of
it or nothing, and a crash leaves at most files that no entry names.  A delete rewrites the
bucket's files beside the old ones and swaps them in one entry.  A batch that carries a key
counts once, however often it is replayed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.embedding import PASSAGE, QUERY, Embedder, HashEmbedder, HashPageEmbedder, PageEmbedder, embed_column
from ..functions.text import extension
from ..operators.chunking import chunk
from ..operators.search import cosine_topk, literal, merge, prefetch_rerank, tenant, token_vectors
from ..operators.sentences import sentences
from ..sources.extract import extract
from ..sources.files import route
from ..sources.pages import ROW, read_pages

TEXT_POINT = "id string, txt_vectors array<double>, doc_id string, doc_name string, client string, bot_id string, type string, content struct<text:string,length:int>"
PAGE_POINT = ROW.removesuffix(", error string")


def bucket_of(doc_id, buckets: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def text_points(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks (doc_id, doc_name, client, bot_id, chunk_ix, text, length) as text points.

    Ids follow from document and place, so a retried task writes the same points.
    """
    return chunks.select(
        F.sha2(F.concat_ws(":", "doc_id", "chunk_ix"), 256).alias("id"), embed_column(F.col("text"), embedder, PASSAGE).alias("txt_vectors"), "doc_id", "doc_name", "client", "bot_id",
        extension(F.col("doc_name")).alias("type"), F.struct("text", F.col("length").cast("int").alias("length")).alias("content"),
    )


def page_batch(page_number, config: Config = DEFAULT):
    """Which batch of a document's pages a page is written with."""
    return F.floor(page_number / config.page_batch).cast("int")


class Log:
    """The numbered entries of one collection."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def fs(self):
        return self.path("_log").getFileSystem(self.conf)

    def entries(self) -> list[dict]:
        fs, folder = self.fs(), self.path("_log")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            stream = fs.open(self.path(f"_log/{name}"))
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return out

    def publish(self, entry: dict, number: int) -> bool:
        """Whether the entry became number ``number``: False if another one is."""
        temporary = self.path(f"_log/.{uuid.uuid4().hex}")
        stream = self.fs().create(temporary)
        stream.write(json.dumps(entry).encode())
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf)
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, self.path(f"_log/{number:08d}.json"), plain)
            return True
        except Exception as problem:
            self.fs().delete(temporary, False)
            if "FileAlreadyExists" in str(problem) or "rename destination" in str(problem):
                return False
            raise


class Store:
    """Named collections under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, config: Config = DEFAULT, pages: PageEmbedder | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.embedder, self.pages = embedder or HashEmbedder(config.dims), pages or HashPageEmbedder()

    def _log(self, name: str) -> Log:
        return Log(self.spark, f"{self.root}/{name}")

    def create(self, name: str, text: bool) -> None:
        """Get or create."""
        if not name or name.startswith((".", "_")) or "/" in name:
            raise ValueError(f"no name for a collection: {name!r}")
        log = self._log(name)
        if not log.entries():
            log.publish({"kind": "text" if text else "image", "buckets": self.config.buckets, "add": [], "remove": []}, 0)

    def collections(self) -> DataFrame:
        """collection: all names, sorted."""
        root = self._log("").path("")
        fs = root.getFileSystem(self._log("").conf)
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        held = [n for n in names if not n.startswith((".", "_")) and fs.exists(self._log(n).path("_log/00000000.json"))]
        return self.spark.createDataFrame([(n,) for n in held], "collection string")

    def _live(self, entries: list[dict], bucket: int | None = None) -> list[str]:
        live: dict[str, None] = {}
        for e in entries:
            for path in e["remove"]:
                live.pop(path, None)
            live.update(dict.fromkeys(e["add"]))
        return [p for p in live if bucket is None or p.endswith(f"/bucket={bucket}")]

    def _entries(self, name: str) -> list[dict]:
        entries = self._log(name).entries()
        if not entries:
            raise ValueError(f"no collection {name}")
        return entries

    def _read(self, name: str, kind: str, paths: list[str]) -> DataFrame:
        schema = TEXT_POINT if kind == "text" else PAGE_POINT
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in paths])

    def points(self, name: str, bucket: int | None = None) -> DataFrame:
        entries = self._entries(name)
        return self._read(name, entries[0]["kind"], self._live(entries, bucket))

    def _written(self, name: str, points: DataFrame, folder: str) -> list[str]:
        """Write the points' files; the folders of their buckets."""
        log, base = self._log(name), f"{self.root}/{name}/{folder}"
        dealt = points.withColumn("bucket", bucket_of("doc_id", log.entries()[0]["buckets"]))
        # Files of a good size, whatever the tasks and however full a bucket: AQE merges and splits.
        dealt.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "doc_id", *[c for c in ("page_number",) if c in points.columns]).write.mode("overwrite").partitionBy("bucket").parquet(base)
        return sorted(f"{folder}/{s.getPath().getName()}" for s in log.fs().listStatus(log.path(folder)) if s.isDirectory())

    def add(self, name: str, points: DataFrame, batch: str | None = None) -> list[str]:
        """Store points; with a ``batch`` key only if no batch of that key is stored.  The
        folders that hold them."""
        entries = self._entries(name)
        done = next((e for e in entries if batch and e.get("batch") == batch), None)
        if done:
            return done["add"]
        # The folder is this call's own: a replay that runs beside it cannot disturb its files.
        added = self._written(name, points, f"data/{uuid.uuid4().hex}")
        number = len(entries)
        while not self._log(name).publish({"add": added, "remove": [], "batch": batch}, number):
            entries = self._entries(name)
            done = next((e for e in entries if batch and e.get("batch") == batch), None)
            if done:
                return done["add"]
            number = len(entries)
        return added

    def ingest(self, client: str, bot_id: str, files: DataFrame, txt_collection: str = "", img_collection: str = "", batch: str | None = None) -> DataFrame:
        """Read, chunk, embed and store ``files`` (name, content); returns a receipt per file:
        name, doc_id, collection, chunks (or pages), error.

        Files of a kind whose collection is not named are left out; files of no kind carry an
        error and do not stop the others.  Files without text add no points.  Each call makes
        new documents; calls with the same ``batch`` key make the same ones, once.  Copies of a
        file (name and content) in a call are one document.
        """
        routed = route(files, self.config)
        stamp = batch or uuid.uuid4().hex
        receipts = routed.rejected.select("name", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("collection"), F.lit(0).cast("long").alias("chunks"), "error")
        key = F.sha2(F.concat_ws("/", F.lit(stamp), "name", F.sha2("content", 256)), 256)
        if txt_collection:
            self.create(txt_collection, True)
            named = routed.text.withColumn("doc_id", key).dropDuplicates(["doc_id"])
            parts = F.when(F.col("ext") == "json", F.col("texts")).otherwise(sentences(F.col("text")))
            read = extract(named).select("doc_id", parts.alias("parts"))
            chunks = chunk(read, F.col("parts"), self.config, embedder=self.embedder)
            chunks = chunks.join(named.select("doc_id", F.col("name").alias("doc_name")), "doc_id").withColumns({"client": F.lit(client), "bot_id": F.lit(bot_id)})
            receipts = receipts.unionByName(self._receipts(named, txt_collection, self.add(txt_collection, text_points(chunks, self.embedder), batch)))
        if img_collection:
            self.create(img_collection, False)
            named = routed.image.withColumn("doc_id", key).dropDuplicates(["doc_id"])
            made = read_pages(named, self.pages)
            receipts = receipts.unionByName(self._receipts(named, img_collection, self.add_pages(img_collection, made.filter("error IS NULL").drop("error"), batch), made))
        return receipts

    def _receipts(self, named: DataFrame, name: str, folders: list[str], made: DataFrame | None = None) -> DataFrame:
        """A receipt for each document, from the files of its own batch."""
        stored = self._read(name, self._entries(name)[0]["kind"], folders).groupBy("doc_id").agg(F.count("*").alias("chunks"))
        out = named.select("name", "doc_id").join(stored, "doc_id", "left")
        if made is not None:
            out = out.join(made.filter("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("error")), "doc_id", "left")
        error = F.col("error") if made is not None else F.lit(None).cast("string").alias("error")
        return out.select("name", "doc_id", F.lit(name).alias("collection"), F.coalesce("chunks", F.lit(0)).alias("chunks"), error)

    def add_pages(self, name: str, pages: DataFrame, batch: str | None = None) -> list[str]:
        """Store page points, those of this engine's reader or others; a document's pages, and so
        those of a batch (:func:`page_batch`), lie together in their order."""
        self.create(name, False)
        return self.add(name, pages, batch)

    def _bucket(self, doc_id: str, name: str) -> int:
        buckets = self._entries(name)[0]["buckets"]
        return self.spark.range(1).select(bucket_of(F.lit(doc_id), buckets).alias("b")).first()["b"]

    def search_by_docid(self, doc_id: str, name: str) -> DataFrame:
        return self.points(name, self._bucket(doc_id, name)).filter(F.col("doc_id") == doc_id)

    def delete_by_docid(self, doc_id: str, name: str) -> int:
        """Points deleted."""
        bucket = self._bucket(doc_id, name)
        while True:
            entries = self._entries(name)
            old = self._live(entries, bucket)
            mine = self._read(name, entries[0]["kind"], old)
            gone = mine.filter(F.col("doc_id") == doc_id).count()
            if not gone:
                return 0
            kept = self._written(name, mine.filter(F.col("doc_id") != doc_id), f"data/{uuid.uuid4().hex}")
            if self._log(name).publish({"add": kept, "remove": old}, len(entries)):
                return gone

    def compact(self, name: str) -> bool:
        """Rewrite the collection as one folder of files a bucket; False if another write came
        between.  Files that no entry names any more are left to the operator of the store."""
        entries = self._entries(name)
        live = self._live(entries)
        whole = self._read(name, entries[0]["kind"], live)
        return self._log(name).publish({"add": self._written(name, whole, f"data/{uuid.uuid4().hex}"), "remove": live}, len(entries))

    def _payload(self, name: str, best: DataFrame, vectors: list[str]) -> DataFrame:
        """The hits (id, doc_id, score: ``limit`` at most) with their payload, read from their
        documents' buckets only."""
        entries = self._entries(name)
        hits = best.withColumn("bucket", bucket_of("doc_id", entries[0]["buckets"])).collect()
        found = self.spark.createDataFrame([(h["id"], h["score"]) for h in hits], "id string, score double")
        paths = [p for b in sorted({h["bucket"] for h in hits}) for p in self._live(entries, b)]
        payload = self._read(name, entries[0]["kind"], paths).drop(*vectors)
        return F.broadcast(found).join(payload.filter(F.col("id").isin([h["id"] for h in hits])), "id")

    def search(self, query: str, txt_collection: str = "", img_collection: str = "", client: str = "", bot_id: str = "", limit: int | None = None, prefetch: int | None = None, tokens: DataFrame | None = None) -> DataFrame:
        """Hits of both collections, rescaled and merged.  The image collection is searched by
        the page embedder's vectors of the query, or by ``tokens`` (token, query)."""
        limit, prefetch, hits = limit or self.config.limit, prefetch or self.config.prefetch, []
        if txt_collection:
            vector = literal(self.embedder([query], QUERY)[0])
            points = self.points(txt_collection).filter(tenant(client, bot_id)).withColumn("key", F.struct("id", "doc_id"))
            best = cosine_topk(points, "txt_vectors", vector, limit, "key").select("key.id", "key.doc_id", "score")
            hits.append(("text", self._payload(txt_collection, best, ["txt_vectors"])))
        if img_collection:
            asked = token_vectors(tokens) if tokens is not None else self.pages.query(query)
            points = self.points(img_collection)
            if client or bot_id or not asked:
                points = points.filter("false")  # page points carry no tenant
            asked = asked or [[0.0]]
            pooled = ["mean_pooling_columns", "mean_pooling_rows"]
            best = prefetch_rerank(points.withColumn("key", F.struct("id", "doc_id")), pooled, "original", asked, prefetch, limit, "key").select("key.id", "key.doc_id", "score")
            hits.append(("image", self._payload(img_collection, best, ["original", *pooled])))
        return merge(hits) if hits else self.spark.createDataFrame([], "id string, score double")


