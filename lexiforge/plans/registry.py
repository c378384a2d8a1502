"""Queries of the engine over the test tables, with the SQL that checks them."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..config import DEFAULT
from ..functions import text as T
from ..functions.embedding import HashEmbedder, embed_column, embed_distinct
from ..functions.vectors import rescale
from ..operators import chunking, search
from ..operators.sentences import explode_sentences, sentences
from ..sources import extract
from ..sources.files import route
from .api import Service
from .store import PAGE_POINT, Store, page_batch, text_points

K = DEFAULT.limit


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def _query(vectors: DataFrame, vec_id: int = 0):
    """The vector of one id, as a column of literals (one row of a stated id)."""
    row = vectors.filter(F.col("vec_id") == vec_id).select("vector").first()
    return F.array(*[F.lit(x) for x in row["vector"]]) if row else F.lit(None).cast("array<double>")


def _tokens(vectors: DataFrame) -> list[list[float]]:
    """Three query tokens: the vectors of ids 0 to 2."""
    return search.token_vectors(vectors.filter("vec_id < 3").select(F.col("vec_id").alias("token"), F.col("vector").alias("query")))


def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return search.cosine_topk(v, "vector", _query(v), K, "vec_id")


def filtered_topk(spark, d):
    v = _vectors(spark, d)
    return search.cosine_topk(v.filter("label = 3"), "vector", _query(v), K, "vec_id")


def _grouped(v):
    return v.select(F.expr("vec_id div 10").alias("doc"), "vector")


def maxsim_topk(spark, d):
    v = _vectors(spark, d)
    return search.topk(search.maxsim_scores(_grouped(v), _tokens(v), "doc"), K, "doc")


def _patches(v):
    """Pages of 16 vectors on a grid of four by four."""
    return v.select(F.expr("vec_id div 16").alias("page"), F.expr("(vec_id % 16) div 4").alias("row"), F.expr("vec_id % 4").alias("col"), "vector")


def _cells(pooled, keep):
    return pooled.select("page", keep, F.posexplode("vector").alias("place", "value")).select("page", keep, "place", F.round("value", 6).alias("value"))


def mean_pool_rows(spark, d):
    return _cells(search.mean_pool(_patches(_vectors(spark, d)), "row"), "row")


def mean_pool_columns(spark, d):
    return _cells(search.mean_pool(_patches(_vectors(spark, d)), "col"), "col")


def _specials(v):
    """A token that is no patch for each page: the first of its vectors once more."""
    return v.filter("vec_id % 16 = 0").select(F.expr("vec_id div 16").alias("page"), F.lit(0).alias("place"), "vector")


def page_vectors(spark, d):
    """Pooled rows of every page, then its special token."""
    v = _vectors(spark, d)
    rows = search.page_vectors(_patches(v), _specials(v), "row").select("page", F.posexplode("vectors").alias("ix", "vector"))
    return rows.select("page", "ix", F.posexplode("vector").alias("place", "value")).select("page", "ix", "place", F.round("value", 6).alias("value"))


def prefetch_rerank(spark, d):
    v = _vectors(spark, d)
    patches, none = _patches(v), _specials(v).limit(0)
    pages = patches.groupBy("page").agg(F.collect_list("vector").alias("original"))
    for keep in ("col", "row"):
        pages = pages.join(search.page_vectors(patches, none, keep).withColumnRenamed("vectors", keep), "page")
    return search.prefetch_rerank(pages, ["col", "row"], "original", _tokens(v), DEFAULT.prefetch, K, "page")


def score_rescale(spark, d):
    v = _vectors(spark, d)
    scored = v.select("vec_id", F.round(search.cosine(F.col("vector"), _query(v)), 6).alias("score"))
    return scored.select("vec_id", F.round(rescale(F.col("score")), 6).alias("score"))


def hybrid_merge(spark, d):
    v = _vectors(spark, d)
    text = search.cosine_topk(v, "vector", _query(v), K, "vec_id")
    image = search.topk(search.maxsim_scores(_grouped(v), _tokens(v), "doc"), K, "doc")
    return search.merge([("text", text.withColumnRenamed("vec_id", "key")), ("image", image.withColumnRenamed("doc", "key"))]).select("modality", "rank", "key", "score")


def sentence_split(spark, d):
    return explode_sentences(read(spark, d, "documents"))


def _chunks(spark, d, **how):
    docs = read(spark, d, "documents")
    return chunking.chunk(docs, sentences(F.col("text")), **how)


def chunk_pack(spark, d):
    return _chunks(spark, d)


def chunk_balanced(spark, d):
    return _chunks(spark, d, strategy="balanced")


def chunk_semantic(spark, d):
    return _chunks(spark, d, embedder=HashEmbedder())


def word_wrap(spark, d):
    return _chunks(spark, d, strategy="wrap")


def long_sentence_split(spark, d):
    long = explode_sentences(read(spark, d, "documents")).filter(F.length("sentence") > DEFAULT.max_chars)
    return long.select("doc_id", "sentence_ix", F.posexplode(chunking.long_pieces(F.col("sentence"))).alias("piece_ix", "piece")).select("doc_id", "sentence_ix", "piece_ix", "piece.text", "piece.length")


def sentence_hash(spark, d):
    return explode_sentences(read(spark, d, "documents")).select("doc_id", "sentence_ix", T.sentence_hash(F.col("sentence")).alias("hash"))


def embed_dedup(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    found = embed_distinct(turns, "text", HashEmbedder())
    # The vector's first coordinate that is not zero stands for it.
    return found.select("conv_id", "turn", "hash", F.round(F.array_max("vector"), 6).alias("top"), F.size(F.filter("vector", lambda x: x > 0)).alias("buckets"))


def natural_key(spark, d):
    """Over the keys of a JSON object per order: fixed names in three spellings."""
    keys = F.explode(F.array(*[F.concat(F.lit(p), F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")) for p in ("releaseYear", "order_status", "HTTPServer")]))
    return read(spark, d, "orders").select("o_orderkey", keys.alias("key")).select("o_orderkey", "key", T.natural_key(F.col("key")).alias("human"))


def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


def markdown_text(spark, d):
    return read(spark, d, "documents").select("doc_id", extract.markdown_text(F.col("text")).alias("text"))


def json_flatten(spark, d):
    """A JSON document per part: two levels, with texts of both sides of the threshold."""
    note = F.concat(F.lit("a part that is of type "), "p_type")
    doc = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), note.alias("longNote"), F.struct(F.col("p_brand").alias("title"), F.lit("short").alias("brief"), F.concat(F.lit("kept under the brand "), "p_brand").alias("storage_note")).alias("brand")))
    flat = read(spark, d, "part").select("p_partkey", extract.json_texts(doc).alias("texts"))
    return flat.select("p_partkey", F.posexplode("texts").alias("ix", "text"))


def csv_text(spark, d):
    """A CSV file per customer, with a header and a line per order."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit(""), F.concat(F.lit('"'), "o_orderpriority", F.lit(', first"')))
    files = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("rows"))
    content = F.concat(F.lit("key,status,note,priority\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return files.select("o_custkey", extract.csv_text(content, 4).alias("text"))


def xml_text(spark, d):
    xml = F.concat(F.lit("<part key='k'>"), "p_name", F.lit("<brand><b>"), "p_brand", F.lit("</b>tail</brand>after<size>"), F.col("p_size").cast("string"), F.lit("</size></part>"))
    return read(spark, d, "part").select("p_partkey", extract.xml_text(xml).alias("text"))


def _folder(spark: SparkSession) -> str:
    """A folder that all executors share: beside the checkpoints (a local one only in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lexiforge-store-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex[:12]}"


def _turn_points(spark, d):
    """Every turn of every conversation as a text point of its conversation."""
    turns = read(spark, d, "conversations")
    tenants = [F.concat(F.lit("c"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("client"), F.concat(F.lit("b"), F.pmod("conv_id", F.lit(2)).cast("string")).alias("bot_id")]
    chunks = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat("conv_id", F.lit(".txt")).alias("doc_name"), *tenants, F.col("turn").alias("chunk_ix"), "text", F.length("text").alias("length"))
    return text_points(chunks, HashEmbedder())


def _talks(spark, d) -> Store:
    """A store whose one collection holds all turns."""
    store = Store(spark, _folder(spark))
    store.create("talks", True)
    store.add("talks", _turn_points(spark, d))
    return store


def _shown(points: DataFrame) -> DataFrame:
    return points.select("id", "doc_id", "doc_name", "client", "bot_id", "type", F.md5(F.col("content.text").cast("binary")).alias("text_md5"), F.col("content.length").alias("length"), F.size("txt_vectors").alias("dims"))


def point_payload(spark, d):
    return _shown(_talks(spark, d).points("talks"))


def doc_lookup(spark, d):
    return _shown(_talks(spark, d).search_by_docid("7", "talks"))


def doc_delete(spark, d):
    store = _talks(spark, d)
    store.delete_by_docid("7", "talks")
    return _shown(store.points("talks"))


def catalog(spark, d):
    """Collections of both kinds, one of them asked for twice."""
    store = Store(spark, _folder(spark))
    for name, text in (("talks", True), ("pictures", False), ("talks", True)):
        store.create(name, text)
    return store.collections()


def page_batches(spark, d):
    """All pages, stored as pages of documents of twelve."""
    pages = read(spark, d, "pages").select(F.expr("page_id div 12").cast("string").alias("doc_id"), F.expr("page_id % 12").cast("int").alias("page_number"))
    pages = pages.withColumn("page_id", F.concat_ws("_", "doc_id", "page_number")).withColumn("id", F.col("page_id"))
    store = Store(spark, _folder(spark))
    store.add_pages("pictures", spark.createDataFrame([], PAGE_POINT).unionByName(pages, allowMissingColumns=True))
    return store.points("pictures").select("doc_id", "page_id", "page_number", page_batch(F.col("page_number")).alias("batch"))


@F.pandas_udf(BinaryType())
def _zipped(ext: pd.Series, one: pd.Series, two: pd.Series, three: pd.Series) -> pd.Series:
    """A DOCX or EPUB file of three texts."""

    def file(kind, a, b, c):
        word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
        item = '<item href="{}" media-type="{}"/>'.format
        page = "application/xhtml+xml"
        parts = {"docx": {"word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:p>{run(a)}{run(b)}</w:p><w:p/><w:p>{run(c)}</w:p></w:body></w:document>'}, "epub": {
            "META-INF/container.xml": '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>',
            "o/c.opf": f'<package xmlns="urn:p"><manifest>{item("1.xhtml", page)}{item("s.css", "text/css")}{item("2.xhtml", page)}</manifest></package>',
            "o/1.xhtml": f"<p>{a}\n{b}</p>", "o/2.xhtml": f"<p>{c} &amp; more</p>", "o/s.css": "p {}",
        }}[kind]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()

    return pd.Series([file(*x) if x[0] in ("docx", "epub") else b"" for x in zip(ext, one, two, three)])


def _part_files(spark, d) -> DataFrame:
    """A file for each part, in one of the text formats: p_partkey, name, ext, content."""
    n, b, t, s = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]).cast("binary")
    bad = F.concat(cat(n), F.lit(bytes([255])), cat(b))
    numbers = cat("size,price,none\n", s, ",1.5,\n\n7,2,\n")
    mixed = cat("name,size,none\n", '"', n, ', it"', ",", s, ",\n")
    content = {
        "txt": bad, "log": cat("[now] [INFO] ", n, "\n", b), "csv": F.when(F.col("p_partkey") % 2 == 0, numbers).otherwise(mixed),
        "json": F.to_json(F.struct(n.alias("name"), F.col("p_partkey").alias("id"), F.concat(F.lit("a part that is of type "), t).alias("longNote"))).cast("binary"),
        "html": cat("<html><head><title>", b, "</title><style>p {}</style></head><body><!-- no --><p>", n, " &amp; ", t, " &#233;&eacute;&#x41;&rarr;</p><script>if (a</p>b)</script></body></html>"),
        "md": cat("# ", n, "\n\nHead\n====\n*", b, "* __", t, "__ _x_ a_b_c [l](u) [m][r] `c`\n- item\n1. one\n> q\n[r]: http://x\n"),
        "xml": cat("<part k='1'>", n, "<brand><i>", b, "</i>tail</brand>after<size>", s, "</size></part>"),
    }
    ext = F.element_at(F.array(*[F.lit(x) for x in DEFAULT.text_formats]), (F.col("p_partkey") % len(DEFAULT.text_formats) + 1).cast("int"))
    made = F.coalesce(*[F.when(F.col("ext") == e, c) for e, c in content.items()], _zipped("ext", "p_name", "p_brand", "p_type"))
    return read(spark, d, "part").withColumn("ext", ext).select("p_partkey", F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit("."), "ext").alias("name"), "ext", made.alias("content"))


def extract_formats(spark, d):
    """What every text extractor makes of a file for each part."""
    found = extract.extract(_part_files(spark, d))
    return found.select("p_partkey", "ext", F.coalesce("text", F.array_join("texts", "|")).alias("text"))


def utf8_scrub(spark, d):
    """Text, list and map with half of a surrogate pair, which UTF-8 cannot hold."""
    bad = F.concat(F.col("p_name").cast("binary"), F.lit(bytes([0xED, 0xA0, 0x80])), F.col("p_brand").cast("binary")).cast("string")
    rows = read(spark, d, "part").select("p_partkey", bad.alias("bad"), F.concat("p_name", F.lit("\ufffd")).alias("good"))
    return rows.select("p_partkey", T.scrub(F.col("bad")).alias("text"), F.array_join(T.scrub_array(F.array("bad", "good")), "|").alias("items"), T.scrub_map(F.create_map(F.lit("k"), "bad"))["k"].alias("value"))


def _nation_files(spark, d) -> DataFrame:
    """For each nation a PDF of two pages, a PNG, a text, and files that are rejected."""
    name, key = F.col("n_name"), F.col("n_nationkey")
    page = lambda n, r: f"{n} 0 obj<</Type/Page/Parent 2 0 R/Contents {r} 0 R>>endobj\n"
    shown = lambda n, text: F.concat(F.lit(f"{n} 0 obj<<>>stream\nBT 1 0 0 1 9 9 Tm ("), text, F.lit(") Tj ET\nendstream endobj\n"))
    head = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[4 0 R 3 0 R]/Count 2/MediaBox[0 0 200 100]>>endobj\n" + page(3, 5) + page(4, 6)
    words = F.concat_ws(" ", F.translate(name, "_", " "), F.lit("\\(land\\)"), F.concat(F.lit("key"), key.cast("string")))
    pdf = F.concat(F.lit(head), shown(5, F.lit("second page")), shown(6, words), F.lit("7 0 obj<</Title("), name, F.lit(")>>endobj\ntrailer<</Root 1 0 R/Info 7 0 R>>"))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(key + 1), 8, "0"), F.lpad(F.hex(key + 2), 8, "0")))
    text = F.concat(F.lit("Notes on "), name, F.lit(". They end here."))
    file = lambda form, content: F.struct(F.concat(name, F.lit("." + form)).alias("name"), content.cast("binary").alias("content"))
    files = F.array(file("pdf", pdf), file("png", png), file("txt", text), file("doc", text), file("TXT", text), file("jpg", text), file("log", F.lit(" ")))
    return read(spark, d, "nation").select(F.explode(files).alias("file")).select("file.name", "file.content")


def _nations(spark, d):
    store = Store(spark, _folder(spark))
    receipts = store.ingest("ann", "bot", _nation_files(spark, d), "texts", "pictures", batch="nations")
    return store, receipts


def ingest_receipts(spark, d):
    """A receipt for each file of an ingest of all kinds."""
    return _nations(spark, d)[1].select("name", F.col("doc_id").isNotNull().alias("stored"), "collection", "chunks", "error")


def ingest_points(spark, d):
    """The text points that an ingest stored, replayed once under the same key."""
    store, _ = _nations(spark, d)
    store.ingest("ann", "bot", _nation_files(spark, d), "texts", "pictures", batch="nations")
    return store.points("texts").select("doc_name", "client", "bot_id", "type", F.col("content.text").alias("text"), F.col("content.length").alias("length"))


def page_points(spark, d):
    """Pages and images that an ingest read."""
    points = _nations(spark, d)[0].points("pictures")
    return points.select("doc_name", "page_number", (F.col("page_id") == F.concat_ws("_", "doc_id", "page_number")).alias("named"), F.col("metadata")["Title"].alias("title"), "text_content.text_plain", F.col("page_dimensions.width").alias("width"), F.col("page_dimensions.height").alias("height"), F.md5(F.unbase64("page_image")).alias("image_md5"), F.size("original").alias("patches"), F.size("mean_pooling_rows").alias("pooled"))


def service_query(spark, d):
    """Both collections searched through the service, with limits that keep all hits."""
    service = Service(_nations(spark, d)[0])
    hits = service.query("land nation", imgcollection="pictures", txtcollection="texts", limit=100_000, prefetch=100_000)
    return spark.createDataFrame([(h["modality"], h["doc_name"], h.get("page_number"), round(h["score"], 6)) for h in hits], "modality string, doc_name string, page_number int, score double")


def tenant_filter(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("client"), F.col("source").alias("bot_id"))
    return docs.filter(search.tenant("en", "src3"))


def base64_roundtrip(spark, d):
    coded = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary")))
    return read(spark, d, "documents").select("doc_id", T.decode_text(T.base64_payload(coded)).alias("text"))


def file_routes(spark, d):
    """Names with extensions of both cases, through the router."""
    name = F.concat(F.lit("dir.v1/"), "p_brand", F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("txt", "TXT", "pdf", "doc", "json")]), (F.col("p_partkey") % 5 + 1).cast("int")))
    routed = route(read(spark, d, "part").select("p_partkey", name.alias("name")))
    kinds = [df.select("p_partkey", "name", "ext", F.lit(kind).alias("kind"), error.alias("error")) for df, kind, error in ((routed.text, "text", F.lit(None).cast("string")), (routed.image, "image", F.lit(None).cast("string")), (routed.rejected, "rejected", F.col("error")))]
    return kinds[0].union(kinds[1]).union(kinds[2]).select("p_partkey", T.basename(F.col("name")).alias("base"), "ext", T.extension_lower(F.col("name")).alias("lowered"), "kind", "error")


def search_documents(spark, d):
    """Chunks of all documents, embedded and ranked against one query text."""
    embedder = HashEmbedder()
    chunks = chunk_pack(spark, d).withColumn("key", F.struct("doc_id", "chunk_ix"))
    vector = [float(x) for x in embedder([QUERY_TEXT])[0]]
    points = chunks.select("key", embed_column(F.col("text"), embedder).alias("vector"))
    best = search.cosine_topk(points, "vector", F.array(*[F.lit(x) for x in vector]), K, "key")
    return best.select("key.doc_id", "key.chunk_ix", F.round(rescale(F.col("score")), 6).alias("score"))


_QUERIES = (
    cosine_topk, filtered_topk, maxsim_topk, mean_pool_rows, mean_pool_columns, prefetch_rerank, score_rescale, hybrid_merge, sentence_split, chunk_pack, chunk_balanced, chunk_semantic, long_sentence_split,
    word_wrap, sentence_hash, embed_dedup, natural_key, html_text, markdown_text, json_flatten, csv_text, xml_text, doc_lookup, doc_delete, catalog, tenant_filter, base64_roundtrip, file_routes, point_payload, page_batches, search_documents,
    page_vectors, extract_formats, utf8_scrub, ingest_receipts, ingest_points, page_points, service_query,
)


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in _QUERIES}


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
_PAIR = "list_cosine_similarity(v, q)"
_TOK = "(SELECT vec_id AS token, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3)"


def _maxsim(source: str, key: str) -> str:
    return f"(SELECT {key}, round(sum(best), 6) AS score FROM (SELECT {key}, token, max({_PAIR}) AS best FROM {source}, {_TOK} GROUP BY ALL) GROUP BY {key})"


_PATCH = "(SELECT vec_id // 16 AS page, (vec_id % 16) // 4 AS row, vec_id % 4 AS col, embedding::DOUBLE[] AS v FROM embeddings)"


def _pool(keep: str) -> str:
    return f"""SELECT page, {keep}, place, avg(x) AS value FROM (SELECT page, {keep}, unnest(v) AS x, unnest(range(0, 64)) AS place FROM {_PATCH}) GROUP BY ALL"""


def _pooled(keep: str) -> str:
    return f"(SELECT page, list(value ORDER BY place) AS v FROM ({_pool(keep)}) GROUP BY page, {keep})"


_SENT = r"""sents AS (
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sentence_ix, s AS sentence FROM (
        SELECT doc_id, unnest(parts) AS s, unnest(range(0, len(parts))) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)
    ) WHERE length(s) > 0)"""

#: White space that is stripped.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Pieces of overlong sentences at the one cut that the default sizes allow.
_LONG = rf"""cuts AS (
    SELECT doc_id, sentence_ix, sentence, length(regexp_extract(substr(sentence, 602, 600), '(?s)^(.*?[.!?:;,]) ', 1)) AS lead FROM sents WHERE length(sentence) > 1200
), pieces AS (
    SELECT doc_id, sentence_ix, 0 AS piece_ix, trim(CASE WHEN lead > 0 AND lead + 600 < 1200 THEN substr(sentence, 1, lead + 600) ELSE sentence END, {_WS}) AS text,
        (CASE WHEN lead > 0 AND lead + 600 < 1200 THEN lead + 600 ELSE length(sentence) END)::INTEGER AS length FROM cuts
    UNION ALL SELECT doc_id, sentence_ix, 1, trim(substr(sentence, lead + 602), {_WS}), (length(sentence) - lead - 601)::INTEGER FROM cuts WHERE lead > 0 AND lead + 600 < 1200)"""


def _fold(full: str, more: str = "", join: str = "") -> str:
    """A recursive walk over sentences: chunk number, size and first sentence so far;
    ``full`` ends a chunk.  ``more`` are further tables, ``join`` brings one to the walk."""
    opened = f"(s.n > 1200 OR w.n > 1200 OR {full})"
    return f"""WITH RECURSIVE {_SENT}, sized AS MATERIALIZED (SELECT doc_id, sentence_ix AS i, length(sentence) AS n FROM sents), {_LONG}{more}, walk AS (
    SELECT doc_id, i, n, 0 AS chunk, CASE WHEN n > 1200 THEN 0 ELSE n END AS size, i AS first FROM sized WHERE i = 0
    UNION ALL
    SELECT s.doc_id, s.i, s.n, w.chunk + CASE WHEN {opened} THEN 1 ELSE 0 END,
        CASE WHEN s.n > 1200 THEN 0 WHEN {opened} THEN s.n ELSE w.size + 1 + s.n END, CASE WHEN {opened} THEN s.i ELSE w.first END
    FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1 {join}
), packed AS (
    SELECT doc_id, chunk, 0 AS piece, string_agg(sentence, ' ' ORDER BY sentence_ix) AS text, max(size)::INTEGER AS length FROM (SELECT doc_id, i AS sentence_ix, chunk, n, size FROM walk) JOIN sents USING (doc_id, sentence_ix) WHERE n <= 1200 GROUP BY doc_id, chunk
    UNION ALL SELECT w.doc_id, w.chunk, p.piece_ix, p.text, p.length FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.sentence_ix = w.i
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, piece) - 1)::INTEGER AS chunk_ix, text, length FROM packed"""


_BUCKET = "('0x' || substr(md5(token), 1, 8))::BIGINT % 64"
#: For a sentence i and a first sentence of its chunk, the nearest between them.
_NEAR = rf""", counted AS MATERIALIZED (
    SELECT doc_id, i, {_BUCKET} AS b, count(*) AS c FROM (SELECT doc_id, sentence_ix AS i, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) AS token FROM sents) GROUP BY ALL
), norms AS MATERIALIZED (
    SELECT doc_id, i, sqrt(sum(c * c)) AS norm FROM counted GROUP BY ALL
), ends AS MATERIALIZED (
    SELECT doc_id, i, n, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sized
), pairs AS MATERIALIZED (
    SELECT a.doc_id, a.i, b.i AS j FROM ends a JOIN ends b ON b.doc_id = a.doc_id AND b.i < a.i AND a.upto - b.upto <= 2600 WHERE a.n <= 1200
), dots AS (
    SELECT p.doc_id, p.i, p.j, sum(x.c * y.c) AS dot FROM pairs p JOIN counted x ON x.doc_id = p.doc_id AND x.i = p.i JOIN counted y ON y.doc_id = p.doc_id AND y.i = p.j AND y.b = x.b GROUP BY ALL
), near AS MATERIALIZED (
    SELECT p.doc_id, p.i, p.j AS first, max(round(coalesce(dot / (x.norm * y.norm), 0), 9)) OVER (PARTITION BY p.doc_id, p.i ORDER BY p.j DESC ROWS UNBOUNDED PRECEDING) AS best
    FROM pairs p LEFT JOIN dots USING (doc_id, i, j) LEFT JOIN norms x ON x.doc_id = p.doc_id AND x.i = p.i LEFT JOIN norms y ON y.doc_id = p.doc_id AND y.i = p.j
)"""

_WRAP = rf"""WITH RECURSIVE {_SENT}, words AS MATERIALIZED (
    SELECT doc_id, sentence_ix, unnest(w) AS word, unnest(range(0, len(w))) AS i
    FROM (SELECT doc_id, sentence_ix, string_split_regex(trim(sentence, {_WS}), '[ \t\n\x0B\f\r]+') AS w FROM sents WHERE length(sentence) > 1200)
), walk AS (
    SELECT doc_id, sentence_ix, i, word, CASE WHEN length(word) + 1 > 1200 THEN 1 ELSE 0 END AS line, length(word) + 1 AS size FROM words WHERE i = 0
    UNION ALL
    SELECT x.doc_id, x.sentence_ix, x.i, x.word, w.line + CASE WHEN w.size + length(x.word) + 1 > 1200 THEN 1 ELSE 0 END,
        CASE WHEN w.size + length(x.word) + 1 > 1200 THEN 0 ELSE w.size END + length(x.word) + 1
    FROM walk w JOIN words x ON x.doc_id = w.doc_id AND x.sentence_ix = w.sentence_ix AND x.i = w.i + 1
), lines AS (
    SELECT doc_id, sentence_ix, line, string_agg(word, ' ' ORDER BY i) AS text FROM walk GROUP BY doc_id, sentence_ix, line
    UNION ALL SELECT doc_id, sentence_ix, 0, '' FROM words WHERE i = 0 AND length(word) + 1 > 1200
    UNION ALL SELECT doc_id, sentence_ix, 0, sentence FROM sents WHERE length(sentence) <= 1200
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sentence_ix, line) - 1)::INTEGER AS chunk_ix, text, length(text)::INTEGER AS length FROM lines"""


def _html(column: str) -> str:
    """Tags and what they enclose unseen in one pass; the entities that the tables hold."""
    bare = rf"regexp_replace({column}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>|<!--.*?-->|<[^>]*>', '', 'g')"
    return f"replace(replace(replace(replace(replace(replace({bare}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"


def _markdown(column: str) -> str:
    """Line by line, then span by span."""
    lines = rf"list_transform(string_split(regexp_replace(regexp_replace({column}, '(?m)^ ? ? ?\[[^\]\n]+\]: *[^\s]+[^\n]*\n?', '', 'g'), '(?m)^([^\s>#*+-][^\n]*)\n(=+|-+) *$', '\1', 'g'), chr(10)), lambda l: regexp_replace(l, '^(######|#####|####|###|##|#) +|^> ?|^[*+-] +|^\d+\. +', ''))"
    text = f"array_to_string({lines}, chr(10))"
    for pattern in (r"!?\[([^\]\n]*)\]\([^)\n]*\)|!?\[([^\]\n]*)\]\[[^\]\n]*\]", r"\*\*([^*\n]+)\*\*", r"\*([^*\n]+)\*"):
        text = rf"regexp_replace({text}, '{pattern}', '\1{"" if "|" not in pattern else "\\2"}', 'g')"
    for mark in ("__", "__", "_", "_"):
        text = rf"regexp_replace({text}, '(^|[^A-Za-z0-9_]){mark}([^_\n]+){mark}($|[^A-Za-z0-9_])', '\1\2\3', 'g')"
    return _html(rf"regexp_replace({text}, '`([^`\n]+)`', '\1', 'g')")


_HUMAN = r"replace(regexp_replace(regexp_replace(key, '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')"
_MD5 = r"md5(trim(regexp_replace({0}, '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ' ', 'g')))"


QUERY_TEXT = "the order of the and that"


def _search_documents() -> str:
    bucket = "('0x' || substr(md5(token), 1, 8))::BIGINT % 64"
    fold = _fold("w.size + s.n > 1200 OR w.size > 1200")
    return f"""WITH chunks AS ({fold}), tokens AS (SELECT doc_id, chunk_ix, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM chunks),
        counted AS (SELECT doc_id, chunk_ix, {bucket} AS b, count(*) AS n FROM tokens GROUP BY ALL),
        asked AS (SELECT {bucket} AS b, count(*) AS m FROM (SELECT unnest(string_split('{QUERY_TEXT}', ' ')) AS token) GROUP BY ALL),
        scored AS (SELECT doc_id, chunk_ix, round(coalesce(sum(n * m), 0) / sqrt(sum(n * n)) / (SELECT sqrt(sum(m * m)) FROM asked), 6) AS score FROM counted LEFT JOIN asked USING (b) GROUP BY ALL)
        SELECT doc_id, chunk_ix, round(CASE WHEN score < 1 THEN score * 10 ELSE score END, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id, chunk_ix LIMIT {K})"""


_TURNS = """SELECT sha256(conv_id || ':' || turn) AS id, conv_id::VARCHAR AS doc_id, conv_id || '.txt' AS doc_name, 'c' || conv_id % 3 AS client, 'b' || conv_id % 2 AS bot_id, 'txt' AS type,
    md5(text) AS text_md5, length(text)::INTEGER AS length, 64 AS dims FROM conversations"""


def _service_query() -> str:
    """Words of texts by cosine; words of pages, each alone in its patch, by equal buckets."""
    bucket = lambda dims: _BUCKET.replace("% 64", f"% {dims}")
    words = "unnest(regexp_extract_all(lower(said), '[\\p{L}\\p{N}]+')) AS token"
    return f"""WITH asked AS (SELECT unnest(['land', 'nation']) AS token),
        texts AS (SELECT n_name || '.txt' AS doc_name, {words} FROM (SELECT *, 'Notes on ' || n_name || '. They end here.' AS said FROM nation)),
        counts AS (SELECT doc_name, {bucket(64)} AS b, count(*) AS n FROM texts GROUP BY ALL), wanted AS (SELECT {bucket(64)} AS b, count(*) AS m FROM asked GROUP BY ALL),
        near AS (SELECT doc_name, round(coalesce(sum(n * m), 0) / sqrt(sum(n * n)) / (SELECT sqrt(sum(m * m)) FROM wanted), 6) AS score FROM counts LEFT JOIN wanted USING (b) GROUP BY doc_name),
        said AS (SELECT n_name || '.pdf' AS doc_name, 0 AS page_number, replace(n_name, '_', ' ') || ' (land) key' || n_nationkey AS said FROM nation UNION ALL SELECT n_name || '.pdf', 1, 'second page' FROM nation),
        held AS (SELECT DISTINCT doc_name, page_number, {bucket(128)} AS b FROM (SELECT doc_name, page_number, {words} FROM said)
            UNION SELECT n_name || '.png', NULL, {bucket(128)} FROM (SELECT n_name, unnest(['png', 'ihdr']) AS token FROM nation)),
        seen AS (SELECT doc_name, page_number, count(a.token)::DOUBLE AS score FROM held LEFT JOIN (SELECT token, {bucket(128)} AS b FROM asked) a USING (b) GROUP BY doc_name, page_number),
        found AS (SELECT 'text' AS modality, doc_name, NULL AS page_number, score FROM near UNION ALL SELECT 'image', doc_name, page_number, score FROM seen)
        SELECT modality, doc_name, page_number::INTEGER AS page_number, round(CASE WHEN score < 1 THEN score * 10 ELSE score END, 6) AS score FROM found"""


def oracle_sql() -> dict[str, str]:
    top = f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings"
    hash_of = _MD5.format
    return {
        "cosine_topk": f"{top} ORDER BY score DESC, vec_id LIMIT {K}",
        "filtered_topk": f"{top} WHERE label = 3 ORDER BY score DESC, vec_id LIMIT {K}",
        "maxsim_topk": f"SELECT * FROM {_maxsim('(SELECT vec_id // 10 AS doc, embedding::DOUBLE[] AS v FROM embeddings)', 'doc')} ORDER BY score DESC, doc LIMIT {K}",
        "mean_pool_rows": f"SELECT page, row, place::INTEGER AS place, round(value, 6) AS value FROM ({_pool('row')})",
        "page_vectors": f"""SELECT page, row::INTEGER AS ix, place::INTEGER AS place, round(value, 6) AS value FROM ({_pool('row')})
            UNION ALL SELECT page, rows::INTEGER, place::INTEGER, round(x, 6) FROM (SELECT vec_id // 16 AS page, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS place FROM embeddings WHERE vec_id % 16 = 0)
            JOIN (SELECT page, count(DISTINCT row) AS rows FROM {_PATCH} GROUP BY page) USING (page)""",
        "mean_pool_columns": f"SELECT page, col, place::INTEGER AS place, round(value, 6) AS value FROM ({_pool('col')})",
        "prefetch_rerank": f"""WITH a AS (SELECT page FROM {_maxsim(_pooled('col'), 'page')} ORDER BY score DESC, page LIMIT {DEFAULT.prefetch}), b AS (SELECT page FROM {_maxsim(_pooled('row'), 'page')} ORDER BY score DESC, page LIMIT {DEFAULT.prefetch})
            SELECT page, score FROM {_maxsim(_PATCH, 'page')} WHERE page IN (SELECT page FROM a UNION SELECT page FROM b) ORDER BY score DESC, page LIMIT {K}""",
        "score_rescale": f"SELECT vec_id, round(CASE WHEN score < 1 THEN score * 10 ELSE score END, 6) AS score FROM ({top})",
        "hybrid_merge": f"""WITH t AS (SELECT 'text' AS modality, vec_id AS key, score FROM ({top} ORDER BY score DESC, vec_id LIMIT {K})),
            i AS (SELECT 'image' AS modality, doc AS key, score FROM {_maxsim('(SELECT vec_id // 10 AS doc, embedding::DOUBLE[] AS v FROM embeddings)', 'doc')} ORDER BY score DESC, doc LIMIT {K})
            SELECT modality, row_number() OVER (PARTITION BY modality ORDER BY score DESC, key)::INTEGER AS rank, key, round(CASE WHEN score < 1 THEN score * 10 ELSE score END, 6) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM i)""",
        "sentence_split": f"WITH {_SENT} SELECT * FROM sents",
        "chunk_pack": _fold("w.size + s.n > 1200 OR w.size > 1200"),
        "chunk_semantic": _fold("w.size + s.n > 1200 OR w.size > 1200 OR w.size >= 1000 AND coalesce(d.best, 1) < 0.3", _NEAR, "LEFT JOIN near d ON d.doc_id = s.doc_id AND d.i = s.i AND d.first = w.first"),
        "word_wrap": _WRAP,
        "chunk_balanced": _fold("w.size + s.n > 1000 AND (w.size + s.n > 1200 OR w.size >= 1000)"),
        "long_sentence_split": f"WITH {_SENT}, {_LONG} SELECT doc_id, sentence_ix, piece_ix, text, length FROM pieces",
        "sentence_hash": f"WITH {_SENT} SELECT doc_id, sentence_ix, {hash_of('sentence')} AS hash FROM sents",
        "embed_dedup": f"""WITH hashed AS (SELECT conv_id, turn, text, {hash_of('text')} AS hash FROM conversations),
            once AS (SELECT hash, min(text) AS one FROM hashed GROUP BY hash),
            tokens AS (SELECT hash, unnest(regexp_extract_all(lower(one), '[\\p{{L}}\\p{{N}}]+')) AS token FROM once),
            counted AS (SELECT hash, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM tokens GROUP BY ALL),
            vectors AS (SELECT hash, round(max(n) / sqrt(sum(n * n)), 6) AS top, count(*)::INTEGER AS buckets FROM counted GROUP BY hash)
            SELECT conv_id, turn, hash, coalesce(top, 0) AS top, coalesce(buckets, 0)::INTEGER AS buckets FROM hashed LEFT JOIN vectors USING (hash)""",
        "natural_key": f"""SELECT o_orderkey, key, upper(substr(h, 1, 1)) || lower(substr(h, 2)) AS human FROM (SELECT *, {_HUMAN} AS h FROM
            (SELECT o_orderkey, unnest(['releaseYear', 'order_status', 'HTTPServer']) || regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') AS key FROM orders))""",
        "html_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
        "markdown_text": f"SELECT doc_id, {_markdown('text')} AS text FROM documents",
        "json_flatten": """SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY ix) - 1)::INTEGER AS ix, text FROM (
            SELECT p_partkey, 0 AS ix, 'Name: ' || p_name || ', Id: ' || p_partkey || '. Name: ' || p_name AS text FROM part WHERE length(p_name) > 20
            UNION ALL SELECT p_partkey, 1, 'Name: ' || p_name || ', Id: ' || p_partkey || '. Long note: a part that is of type ' || p_type FROM part
            UNION ALL SELECT p_partkey, 2, 'Name: ' || p_name || ', Id: ' || p_partkey || ', Title: ' || p_brand || '. Storage note: kept under the brand ' || p_brand FROM part)""",
        "csv_text": "SELECT o_custkey, string_agg(o_orderkey || ' ' || o_orderstatus || ' nan ' || o_orderpriority || ', first', ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey",
        "xml_text": "SELECT p_partkey, p_name || p_brand || p_size AS text FROM part",
        "doc_lookup": f"{_TURNS} WHERE conv_id = 7",
        "doc_delete": f"{_TURNS} WHERE conv_id <> 7",
        "catalog": "SELECT unnest(['talks', 'pictures']) AS collection",
        "tenant_filter": "SELECT doc_id, lang AS client, source AS bot_id FROM documents WHERE lang = 'en' AND source = 'src3'",
        "base64_roundtrip": "SELECT doc_id, decode(from_base64(to_base64(encode(text)))) AS text FROM documents",
        "file_routes": """SELECT p_partkey, p_brand || '.' || e AS base, e AS ext, '.' || lower(e) AS lowered, CASE WHEN e IN ('txt', 'json') THEN 'text' WHEN e = 'pdf' THEN 'image' ELSE 'rejected' END AS kind,
            CASE WHEN e IN ('TXT', 'doc') THEN 'Unsupported file type: ' || e END AS error FROM (SELECT *, ['txt', 'TXT', 'pdf', 'doc', 'json'][p_partkey % 5 + 1] AS e FROM part)""",
        "point_payload": _TURNS,
        "search_documents": _search_documents(),
        "page_batches": "SELECT (page_id // 12)::VARCHAR AS doc_id, page_id // 12 || '_' || page_id % 12 AS page_id, (page_id % 12)::INTEGER AS page_number, ((page_id % 12) // 5)::INTEGER AS batch FROM pages",
        "extract_formats": """SELECT p_partkey, e AS ext, CASE e
                WHEN 'txt' THEN p_name || chr(65533) || p_brand WHEN 'log' THEN '[now] [INFO] ' || p_name || chr(10) || p_brand
                WHEN 'csv' THEN CASE WHEN p_partkey % 2 = 0 THEN p_size || '.0 1.5 nan 7.0 2.0 nan' ELSE p_name || ', it ' || p_size || ' nan' END
                WHEN 'json' THEN CASE WHEN length(p_name) > 20 THEN 'Name: ' || p_name || ', Id: ' || p_partkey || '. Name: ' || p_name || '|' ELSE '' END || 'Name: ' || p_name || ', Id: ' || p_partkey || '. Long note: a part that is of type ' || p_type
                WHEN 'html' THEN p_brand || p_name || ' & ' || p_type || ' ' || chr(233) || chr(233) || 'A' || chr(8594)
                WHEN 'md' THEN array_to_string([p_name, '', 'Head', p_brand || ' ' || p_type || ' x a_b_c l m c', 'item', 'one', 'q', ''], chr(10))
                WHEN 'xml' THEN p_name || p_brand || p_size WHEN 'docx' THEN p_name || ' ' || p_brand || ' ' || p_type WHEN 'epub' THEN p_name || ' ' || p_brand || ' ' || p_type || ' & more' END AS text
            FROM (SELECT *, ['txt', 'docx', 'md', 'csv', 'json', 'html', 'xml', 'epub', 'log'][p_partkey % 9 + 1] AS e FROM part)""",
        "utf8_scrub": "SELECT p_partkey, p_name || p_brand AS text, p_name || p_brand || '|' || p_name || chr(65533) AS items, p_name || p_brand AS value FROM part",
        "ingest_receipts": """SELECT n_name || '.' || e AS name, e IN ('pdf', 'png', 'txt', 'jpg', 'log') AS stored, CASE WHEN e IN ('pdf', 'png', 'jpg') THEN 'pictures' WHEN e IN ('txt', 'log') THEN 'texts' END AS collection,
                CASE e WHEN 'pdf' THEN 2 WHEN 'png' THEN 1 WHEN 'txt' THEN 1 ELSE 0 END::BIGINT AS chunks, CASE WHEN e IN ('doc', 'TXT') THEN 'Unsupported file type: ' || e WHEN e = 'jpg' THEN 'not a PNG or JPEG' END AS error
            FROM nation, (SELECT unnest(['pdf', 'png', 'txt', 'doc', 'TXT', 'jpg', 'log']) AS e)""",
        "ingest_points": "SELECT n_name || '.txt' AS doc_name, 'ann' AS client, 'bot' AS bot_id, 'txt' AS type, 'Notes on ' || n_name || '. They end here.' AS text, length(n_name) + 25 AS length FROM nation".replace("length(n_name) + 25", "(length(n_name) + 25)::INTEGER"),
        "page_points": """SELECT n_name || '.pdf' AS doc_name, n::INTEGER AS page_number, true AS named, n_name AS title, CASE n WHEN 0 THEN replace(n_name, '_', ' ') || ' (land) key' || n_nationkey ELSE 'second page' END AS text_plain,
                200.0::DOUBLE AS width, 100.0::DOUBLE AS height, NULL AS image_md5, 17 AS patches, 5 AS pooled FROM nation, (SELECT unnest([0, 1]) AS n)
            UNION ALL SELECT n_name || '.png', NULL, NULL, NULL, NULL, n_nationkey + 1, n_nationkey + 2, md5(unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(n_nationkey + 1), 8, '0') || lpad(hex(n_nationkey + 2), 8, '0'))), 17, 5 FROM nation""",
        "service_query": _service_query(),
    }
