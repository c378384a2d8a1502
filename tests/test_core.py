"""Operators of the engine: against SQL, by hand-made fixtures and by invariants."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.config import Config
from lexiforge.functions import text as T
from lexiforge.functions.vectors import rescale
from lexiforge.operators import chunking, search
from lexiforge.plans import registry
from lexiforge.plans.api import Service
from lexiforge.plans.store import Store
from lexiforge.sources import extract
from lexiforge.sources.files import read_files, route
from lexiforge.streaming.ingest import ingest_stream, stream_files

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, compare, name):
    compare(spark, registry.queries()[name], SQL[name])


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def pieces(spark, sentence, config=Config()):
    return [tuple(x) for x in one(spark, lambda c: chunking.long_pieces(c, config), sentence)]


def test_long_sentence(spark):
    assert pieces(spark, "a" * 700 + "; " + "b" * 900) == [("a" * 700, 700), ("b" * 900, 901)]
    # A mark that is too early, too late or without a space is no cut.
    for s in ("a" * 599 + ". " + "b" * 900, "a" * 1200 + ". " + "b" * 10, "a" * 700 + "." + "b" * 700):
        assert pieces(spark, s) == [(s, len(s))]
    # Smaller settings allow several cuts, each after more than the least size.
    small = Config(min_chars=3, max_chars=30)
    assert pieces(spark, "aaaaa, bb, cccccc. dddd: e; " + "f" * 30, small) == [("aaaaa", 5), ("bb, cccccc", 11), ("dddd", 5), ("e; " + "f" * 30, 34)]
    assert pieces(spark, "é😀" * 400 + ", x") == [("é😀" * 400, 800), ("x", 2)]


def chunked(spark, parts, **how):
    docs = spark.createDataFrame([(1, parts), (2, []), (3, None)], "doc_id long, parts array<string>")
    rows = sorted(chunking.chunk(docs, F.col("parts"), **how).collect())
    assert [r["chunk_ix"] for r in rows] == list(range(len(rows))) and {r["doc_id"] for r in rows} <= {1}
    return [(r["text"], r["length"]) for r in rows]


def test_pack_keeps_order_and_bounds(spark):
    rng = np.random.default_rng(3)
    parts = ["x" * int(n) for n in rng.integers(1, 1200, 300)]
    packed = chunked(spark, parts)
    assert " ".join(t for t, _ in packed) == " ".join(parts)
    assert all(len(t) == n <= 1201 for t, n in packed)
    assert chunked(spark, ["a" * 100, "b" * 1150, "c" * 1300, "d"]) == [("a" * 100, 100), ("b" * 1150, 1150), ("c" * 1300, 1300), ("d", 1)]


def test_drift_ends_full_chunks_only(spark):
    lengths, apart = [500, 499, 100, 100], np.eye(4)
    # At 1000 characters every further sentence is far from the chunk: it opens the next.
    assert chunking.meaning_starts(lengths, apart) == [0, 2]
    assert chunking.meaning_starts([500, 499, 100, 1300, 5], np.eye(5)) == [0, 2, 3, 4]
    # Below the ideal size drift does nothing, and near sentences stay.
    assert chunking.meaning_starts([500, 400, 100], np.eye(3)) == [0]
    assert chunking.meaning_starts(lengths, np.ones((4, 2))) == [0, 3]
    assert [n for _, n in chunked(spark, [c * n for c, n in zip("abcd", lengths)])] == [1101, 100]
    assert not chunking.drifts(np.ones(2), np.zeros((0, 2)), 0.3)
    assert chunking.drifts(np.array([1.0, 0.0]), np.array([[0.0, 1.0]]), 0.3)
    assert chunking.drifts(np.zeros(2), np.ones((1, 2)), 0.3)


def test_balanced_and_wrap(spark):
    parts = ["a" * 600, "b" * 500, "c" * 600]
    assert [n for _, n in chunked(spark, parts, strategy="balanced")] == [1101, 600]
    assert [n for _, n in chunked(spark, ["a" * 500, "b" * 499, "c"], strategy="balanced")] == [1000, 1]
    wrap = lambda text, limit: one(spark, lambda c: chunking.wrapped(c, limit), text)
    assert wrap("aa bb cc", 6) == ["aa bb", "cc"]
    assert wrap("a" * 9 + " b", 6) == ["", "a" * 9, "b"]
    assert wrap(" a  b\tc d ", 4) == ["a b", "c d"]
    assert wrap("short", 10) == ["short"]


def test_fixtures_of_extractors(spark):
    assert one(spark, extract.xml_text, "<a>t1<b k='v'>t2</b>TAIL<c>t3</c></a>") == "t1t2t3"
    assert one(spark, extract.xml_text_safe, b"<a>t1<b k='v'>t2</b>TAIL<c>t3</c></a>", "binary") == "t1t2t3"
    assert one(spark, extract.xml_text_safe, b"<a", "binary") == ""
    assert one(spark, T.natural_key, "releaseYear") == "Release year"
    assert one(spark, T.natural_key, "recordingDetails") == "Recording details"
    assert one(spark, extract.csv_text_any, b"a,b\n1,x\n\n2,\n", "binary") == "1 x 2 nan"
    # Numbers alone take one type; a quoted line end stays in its value.
    assert one(spark, extract.csv_text_any, b"a,b\n1,\n2,0.5\n", "binary") == "1.0 nan 2.0 0.5"
    assert one(spark, extract.csv_text_any, b'a,b\n1,"x\ny"\n', "binary") == "1 x\ny"
    assert one(spark, extract.csv_text_any, b"a,b\n", "binary") == one(spark, extract.csv_text_any, b"", "binary") == ""
    assert one(spark, lambda c: extract.csv_text(c, 2), "a,b\n1,x\n\n2,\n") == "1 x 2 nan"
    assert one(spark, lambda c: extract.csv_text(c, 2), "a,b\n") == ""
    assert one(spark, extract.html_text, "<p>a<script>x</p></script> &amp;lt; <!-- c -->b</p>") == "a &lt; b"
    assert one(spark, extract.html_text, "&#8217;&eacute;&#x41;&nope; a&b &amp;amp;") == "’éA&nope; a&b &amp;"
    assert one(spark, extract.markdown_text, "# Head\n**b** [t](u) `c`") == "Head\nb t c"
    assert one(spark, extract.markdown_text, "Title\n=====\n_a_ __b__ a_b_c [t][r] ![i](u)\n[r]: http://x\nend") == "Title\na b a_b_c t i\nend"
    assert one(spark, T.decode_text, b"a\xffb", "binary") == "a�b"


def test_html_as_its_sql(spark, compare, tmp_path):
    """titles cut within an entity, and marks inside of what is dropped anyway."""
    import duckdb

    pages = {
        "<title>a&amp</title>B<h1>&lt</h1>": "a&ampB&lt", "&copy=2 &ampx; &amp;": "&copy=2 &ampx; &", "&am</b>p;": "&", "<!-- <script> -->A<script>x</script>B": "AB",
        '<a title="<script>">A</a><script>x</script>': '">A', '<a title="<!--">A--></a>': "A-->", "<style><!--</style>A<p>-->": "A-->", "<SCRIPT>a</style></script\n>A<scripts>B</script>": "AB", "<scripté>a</script>A": "A", "a < b": "a < b",
    }
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, 'u', ?)", [[i, h] for i, h in enumerate([*pages, "", None])])
    con.execute(f"copy pages to '{tmp_path}/pages.parquet'")
    compare(spark, registry.queries()["html_text"], SQL["html_text"], str(tmp_path))
    for html, text in pages.items():
        assert one(spark, extract.html_text, html) == text
    for number, text in {"1" * 5000: "\ufffd", "0" * 5000 + "65": "A", "00": "\ufffd", "12345678": "\ufffd", "128512": "\U0001f600"}.items():
        assert one(spark, extract.html_text, f"&#{number};") == extract.unescape(f"&#{number}") == text
    # Markdown has no entities without a semicolon; files of pages may.
    files = spark.createDataFrame([("html", b"<b>a&amp</b>B&#8217"), ("md", b"a&ampB &copy=2 &copy;")], "ext string, content binary")
    assert {r["ext"]: r["text"] for r in extract.extract(files).collect()} == {"html": "a&B\u2019", "md": "a&ampB &copy=2 \u00a9"}
    assert extract.strip_html("<!-- <style> --><p>A</p><style>p {}</style>") == "A"


def test_json_rules(spark):
    doc = {"users": [{"id": 1, "name": "A", "email": "x" * 20}, {"id": 2, "name": "B", "email": "y" * 21, "ok": True}], "note": "z" * 25, "deep": {"title": "t" * 21}}
    assert extract.flatten_json(json.dumps(doc)) == ["Note: " + "z" * 25, "Name: B, Id: 2. Email: " + "y" * 21, "Title: " + "t" * 21 + ". Title: " + "t" * 21]
    assert extract.flatten_json("{") == []
    assert one(spark, extract.json_texts, None) == []


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = _zip({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'})
EPUB = _zip({
    "META-INF/container.xml": '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>',
    "o/c.opf": '<package xmlns="urn:p"><manifest><item href="a.xhtml" media-type="application/xhtml+xml"/><item href="s.css" media-type="text/css"/><item href="b.xhtml" media-type="application/xhtml+xml"/></manifest></package>',
    "o/a.xhtml": "<p>first\nline</p>", "o/b.xhtml": "<p>second</p>", "o/s.css": "x",
})


def test_zip_formats(spark):
    assert extract.docx_content(DOCX) == "one two three"
    assert extract.epub_content(EPUB) == "first line second"
    assert one(spark, extract.docx_text, b"not a zip", "binary") == ""


def test_router(spark):
    files = spark.createDataFrame([("a.txt",), ("A.TXT",), ("b.pdf",), ("c.doc",)], "name string").withColumn("content", F.lit(b"x"))
    routed = route(files)
    assert [r["name"] for r in routed.text.collect()] == ["a.txt"]
    assert [r["name"] for r in routed.image.collect()] == ["b.pdf"]
    assert {r["error"] for r in routed.rejected.collect()} == {"Unsupported file type: TXT", "Unsupported file type: doc"}


def test_rescale(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (3.2,), (-0.1,)], "s double").select(rescale(F.col("s"))).collect()
    assert [r[0] for r in rows] == [5.0, 1.0, 3.2, -1.0]


def test_topk_is_a_prefix_and_commutes_with_filters(spark):
    v = registry._vectors(spark, "/root/testdata/sf0.001")
    q = registry._query(v)
    ten = search.cosine_topk(v, "vector", q, 10, "vec_id").collect()
    assert search.cosine_topk(v, "vector", q, 9, "vec_id").collect() == ten[:9]


def test_page_vectors_append_special_tokens(spark):
    patches = spark.sql("SELECT 1L AS page, r AS row, array(cast(r + c AS double), 1D) AS vector FROM (SELECT explode(sequence(0, 1)) AS r) CROSS JOIN (SELECT explode(sequence(0, 2)) AS c)")
    specials = spark.sql("SELECT 1L AS page, 0 AS place, array(9D, 9D) AS vector")
    assert search.page_vectors(patches, specials, "row").first()["vectors"] == [[1.0, 1.0], [2.0, 1.0], [9.0, 9.0]]
    assert search.page_vectors(patches, specials.limit(0), "row").first()["vectors"] == [[1.0, 1.0], [2.0, 1.0]]


def test_store_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Gravity leans on stars. " * 80)
    (source / "b.json").write_text(json.dumps({"name": "n", "text": "some long text about oceans and ships"}))
    (source / "c.docx").write_bytes(DOCX)
    (source / "d.doc").write_text("no")
    (source / "e.txt").write_text(" ")  # files of no bytes are not listed by the source
    store = Store(spark, f"file://{tmp_path}/store", config=Config())
    service = Service(store)
    receipt = service.ingest(read_files(spark, f"file://{source}"), "ann", "bot", "texts", "")
    assert receipt["d.doc"]["error"] == "Unsupported file type: doc"
    assert receipt["e.txt"]["error"] is None
    assert service.allcolumns() == ["texts"]
    hits = service.query("oceans and ships", txtcollection="texts", client="ann")
    assert hits[0]["content"]["text"].endswith("oceans and ships")
    assert service.query("oceans", txtcollection="texts", client="other") == []
    doc = receipt["a.txt"]["id"]
    points = service.searchdoc(doc, "texts")
    assert len(points) == 2 and {p["doc_name"] for p in points} == {"a.txt"}
    assert service.delete(doc, "texts") == 2
    assert service.searchdoc(doc, "texts") == []
    assert service.delete(doc, "texts") == 0
    assert len(service.searchdoc(receipt["b.json"]["id"], "texts")) == 1


def test_image_collection_search(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    pages = spark.sql("SELECT concat('p', id) AS id, array(array(cast(id AS double), 1D)) AS original, array(array(cast(id AS double), 1D)) AS mean_pooling_rows, array(array(cast(id AS double), 1D)) AS mean_pooling_columns, 'd' AS doc_id FROM range(5)")
    from lexiforge.plans.store import PAGE_POINT

    empty = spark.createDataFrame([], PAGE_POINT)
    store.add_pages("pics", empty.unionByName(pages, allowMissingColumns=True))
    tokens = spark.sql("SELECT 0 AS token, array(1D, 0D) AS query")
    hits = store.search("", img_collection="pics", tokens=tokens, limit=2).collect()
    assert [h["id"] for h in hits] == ["p4", "p3"]
    assert store.search("", img_collection="pics", tokens=tokens, client="x").count() == 0


def page_points(spark, n=5):
    from lexiforge.plans.store import PAGE_POINT

    pages = spark.sql(f"SELECT concat('p', id) AS id, array(array(cast(id AS double), 1D)) AS original, array(array(cast(id AS double), 1D)) AS mean_pooling_rows, array(array(cast(id AS double), 1D)) AS mean_pooling_columns, 'd' AS doc_id FROM range({n})")
    return spark.createDataFrame([], PAGE_POINT).unionByName(pages, allowMissingColumns=True)


def test_service_query_searches_images(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.add_pages("pics", page_points(spark))
    tokens = spark.sql("SELECT 0 AS token, array(1D, 0D) AS query")
    assert [h["id"] for h in Service(store).query("", imgcollection="pics", limit=2, tokens=tokens)] == ["p4", "p3"]
    assert Service(store).query("", imgcollection="pics") == []
    assert Service(store).query("x", imgcollection="none").startswith("ERRR:")


def test_pdf_and_image_reader():
    import zlib

    from lexiforge.sources.pages import Pdf, image_size

    shown = zlib.compress(b"BT /F 9 Tf (one \\(a\\) \\101) Tj 0 -9 Td [(tw) -20 (o)] TJ T* <74687265> Tj ET BT (four) ' ET")
    four, five = b"<</Type/Page/Contents[6 0 R]>> ", b"<</Type/Page/MediaBox[0 0 10 20]>>"
    heads = b"4 0 5 %d " % len(four)
    first, inner = len(heads), heads + four + five
    packed = zlib.compress(inner)
    pdf = b"%%PDF-1.5\n1 0 obj<</Type /Catalog /Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[5 0 R 4 0 R 9 0 R]/MediaBox[0 0 300 400]>>endobj 7 0 obj<</Type/ObjStm/N 2/First %d/Filter/FlateDecode>>stream\n%s\nendstream endobj 6 0 obj<</Filter/FlateDecode>>stream\n%s\nendstream endobj 8 0 obj<</Title(T)/Author(A\\)B)>>endobj trailer<</Info 8 0 R>>" % (first, packed, shown)
    found = Pdf(pdf)
    blank, full = found.pages()
    assert (blank.text, blank.width, blank.height) == ("", 10.0, 20.0)
    assert full.text == "one (a) A\ntwo\nthre\nfour" and full.blocks == ["one (a) A\ntwo\nthre", "four"] and full.width == 300.0
    assert found.metadata() == {"Title": "T", "Author": "A)B"}
    with pytest.raises(ValueError):
        Pdf(b"no")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00\xff\xd9"
    assert image_size(jpeg) == (9.0, 7.0)


def texts(spark, *names):
    rows = [(f"{n}-0", [1.0], n, f"{n}.txt", "c", "b", "txt", (n, len(n))) for n in names]
    from lexiforge.plans.store import TEXT_POINT

    return spark.createDataFrame(rows, TEXT_POINT)


def stored(store, name="texts"):
    return sorted(r["doc_id"] for r in store.points(name).collect())


class Killed(Exception):
    pass


def test_store_survives_a_kill_at_any_step(spark, tmp_path, monkeypatch):
    from lexiforge.plans.store import Log

    store = Store(spark, f"file://{tmp_path}/store")
    store.create("texts", True)
    names = [f"d{i}" for i in range(40)]
    store.add("texts", texts(spark, *names))
    publish, written = Log.publish, Store._written

    def die(*_, **__):
        raise Killed

    for target, name in ((Log, "publish"), (Store, "_written")):
        monkeypatch.setattr(target, name, die)
        for call in (lambda: store.delete_by_docid("d7", "texts"), lambda: store.add("texts", texts(spark, "new")), lambda: store.compact("texts")):
            with pytest.raises(Killed):
                call()
        monkeypatch.undo()
        assert stored(store) == sorted(names)
    assert (Log.publish, Store._written) == (publish, written)
    # Nothing that a killed call left behind shows as a collection.
    assert [r[0] for r in store.collections().collect()] == ["texts"]
    assert store.delete_by_docid("d7", "texts") == 1 and store.compact("texts")
    assert stored(store) == sorted(set(names) - {"d7"})
    assert [r["doc_id"] for r in store.search_by_docid("d8", "texts").collect()] == ["d8"]
    with pytest.raises(ValueError):
        store.create(".hidden", True)


def test_store_writers_do_not_lose_each_other(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    other = Store(spark, f"file://{tmp_path}/store")
    store.create("texts", True)
    store.add("texts", texts(spark, "a", "b"))
    written, beside = Store._written, [lambda: other.add("texts", texts(spark, "c")), lambda: other.add("texts", texts(spark, "d"), batch="k")]

    def slow(self, *args):
        out = written(self, *args)
        if self is store and beside:
            beside.pop(0)()  # another writer publishes first
        return out

    monkeypatch.setattr(Store, "_written", slow)
    assert store.delete_by_docid("a", "texts") == 1
    store.add("texts", texts(spark, "d"), batch="k")
    monkeypatch.undo()
    assert stored(store) == ["b", "c", "d"]


def test_stream_ingest(spark, tmp_path):
    from lexiforge.streaming.ingest import ingest_batch

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("A sentence of a stream. " * 5)
    store = Store(spark, f"file://{tmp_path}/store")
    query = ingest_stream(store, stream_files(spark, f"file://{source}"), "c", "b", "texts", f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    assert store.points("texts").count() == 1
    # The same micro-batch once more, as after a failure; then another one.
    files = read_files(spark, f"file://{source}")
    add = ingest_batch(store, f"file://{tmp_path}/checkpoint", "c", "b", "texts")
    add(files, 0)
    assert store.points("texts").count() == 1
    add(files, 1)
    add(files, 1)
    assert store.points("texts").count() == 2


def test_embedders_are_told_what_they_embed(spark, tmp_path):
    class Prompted:
        dims = 2

        def __call__(self, texts, prompt=""):
            return np.array([[1.0, 0.0] if prompt == "passage:" else [0.6, 0.8] if prompt == "query:" else [0.0, 1.0]] * len(texts))

    store = Store(spark, f"file://{tmp_path}/store", embedder=Prompted())
    store.ingest("c", "b", spark.createDataFrame([("a.txt", b"Some text.")], "name string, content binary"), "texts").collect()
    assert store.points("texts").first()["txt_vectors"] == [1.0, 0.0]
    assert [round(h["score"], 6) for h in store.search("x", "texts").collect()] == [6.0]


def test_receipts_count_their_own_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("a.txt", b"One. Two."), ("a.txt", b"One. Two."), ("a.txt", b"Other.")], "name string, content binary")
    for _ in range(2):
        got = store.ingest("c", "b", files, "texts").collect()
        assert sorted((r["name"], r["chunks"]) for r in got) == [("a.txt", 1), ("a.txt", 1)]
    assert store.points("texts").count() == 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
