"""Pages of PDF files and images: text, metadata, sizes and vectors.

The reader knows plain PDF: objects in the open or in object streams, Flate content, and
text shown as literal or hexadecimal one-byte strings.  Other fonts and filters give empty
text, never an error for the file's other pages.  Pages are not drawn: ``page_image`` holds
an image file's own bytes and is null for PDF pages.
"""

from __future__ import annotations

import base64
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.embedding import PageEmbedder
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|T\*|Td|TD|ET)(?![A-Za-z])|['\"]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}


class Page(NamedTuple):
    text: str
    blocks: list[str]
    width: float
    height: float


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def one(m):
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.S).decode("latin-1")


def shown_text(content: bytes) -> list[str]:
    """The lines that a page's content shows, by text object; strings of one line are joined."""
    blocks, line, lines, held = [], "", [], []
    for token in _SHOWN.findall(content):
        if token[:1] in b"(<":
            held.append(_string(token))
            continue
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"') and line:
                lines.append(line)
                line = ""
            line += "".join(held)
        elif line:
            lines.append(line)
            line = ""
        held = []
        if token == b"ET" and lines:
            blocks.append("\n".join(lines))
            lines = []
    return blocks + ["\n".join([*lines, line]).strip("\n")] * bool(lines or line)


class Pdf:
    """The objects of a file, its pages in order, and its metadata."""

    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.objects = {int(n): body for n, body in _OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                data, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                heads = list(map(int, data[:first].split()))
                ends = [*heads[3::2], len(data) - first]
                for number, at, end in zip(heads[::2], heads[1::2], ends):
                    self.objects.setdefault(number, data[first + at : first + end])
        self.trailer = content

    def stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        return zlib.decompressobj().decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]

    def _refs(self, body: bytes, key: bytes) -> list[int]:
        found = re.search(rb"/" + key + rb"\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body, re.S)
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", found[1] or found[2])] if found else []

    def _box(self, body: bytes):
        found = re.search(rb"/MediaBox\s*\[\s*([^\]]*)\]", body)
        values = [float(x) for x in found[1].split()] if found else []
        return (values[2] - values[0], values[3] - values[1]) if len(values) == 4 else None

    def pages(self) -> list[Page]:
        roots = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog", b)]
        todo = [(n, (612.0, 792.0)) for n in (self._refs(self.objects[roots[-1]], b"Pages") if roots else [])]
        if not todo:
            todo = [(n, (612.0, 792.0)) for n, b in sorted(self.objects.items(), reverse=True) if re.search(rb"/Type\s*/Page\b", b)]
        out, seen = [], set()
        while todo:
            number, box = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            box = self._box(body) or box
            kids = self._refs(body, b"Kids")
            todo += [(k, box) for k in reversed(kids)]
            if not kids and re.search(rb"/Type\s*/Page\b", body):
                out.append(self._page(body, box))
        return out

    def _page(self, body: bytes, box) -> Page:
        try:
            blocks = shown_text(b"\n".join(self.stream(self.objects[n]) for n in self._refs(body, b"Contents")))
        except Exception:
            blocks = []
        return Page("\n".join(blocks), blocks, *box)

    def metadata(self) -> dict[str, str]:
        found = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", self.trailer)
        body = self.objects.get(int(found[-1]), b"") if found else b""
        return {k.decode("latin-1"): _string(v) for k, v in re.findall(rb"/([A-Za-z]+)\s*(\((?:\\.|[^\\()])*\))", body, re.S)}


def image_size(content: bytes) -> tuple[float, float]:
    """Width and height of a PNG or JPEG file; other content is refused."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR":
        return float(int.from_bytes(content[16:20], "big")), float(int.from_bytes(content[20:24], "big"))
    at = 2
    while content[:2] == b"\xff\xd8" and content[at : at + 1] == b"\xff" and at + 9 < len(content):
        code, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            return float(int.from_bytes(content[at + 7 : at + 9], "big")), float(int.from_bytes(content[at + 5 : at + 7], "big"))
        at += 2 + size
    raise ValueError("not a PNG or JPEG")


VECTORS = "original array<array<double>>, mean_pooling_rows array<array<double>>, mean_pooling_columns array<array<double>>"
ROW = (
    f"id string, {VECTORS}, doc_id string, page_id string, doc_name string, page_number int, metadata map<string,string>, page_image string, "
    "text_content struct<text_plain:string,text_html:string,blocks:array<struct<bbox:array<double>,text:string,block_no:int,block_type:int>>>, page_dimensions struct<width:double,height:double>, error string"
)


def page_vectors(grid: np.ndarray, specials: np.ndarray) -> dict:
    """The three vector sets of a page: all, means over columns and rows of the grid (x, y, dim),
    each with the vectors of the tokens that are no patch."""
    sets = {"original": grid.reshape(-1, grid.shape[2]), "mean_pooling_rows": grid.mean(0), "mean_pooling_columns": grid.mean(1)}
    return {name: np.vstack([rows, specials]).tolist() for name, rows in sets.items()}


def read_pages(files: DataFrame, embedder: PageEmbedder) -> DataFrame:
    """Page points of ``files`` (doc_id, name, ext, content), one row a page or image; a file
    that cannot be read gives one row with ``error``."""

    names = [f.name for f in files.sparkSession.createDataFrame([], ROW).schema]

    def rows(doc_id, name, ext, content):
        content = bytes(content)
        blank = dict.fromkeys(names)
        base = blank | {"doc_id": doc_id, "doc_name": name.rpartition("/")[2]}
        try:
            if ext == "pdf":
                pdf = Pdf(content)
                about = pdf.metadata()
                for i, page in enumerate(pdf.pages()):
                    key = f"{doc_id}_{i}"
                    blocks = [{"bbox": None, "text": b, "block_no": k, "block_type": 0} for k, b in enumerate(page.blocks)]
                    # Lines as paragraphs stand in for a layout.
                    shown = "".join(f"<p>{x}</p>" for x in page.text.replace("&", "&amp;").replace("<", "&lt;").split("\n"))
                    yield base | page_vectors(*embedder.page(page.text)) | {"id": key, "page_id": key, "page_number": i, "metadata": about, "text_content": {"text_plain": page.text, "text_html": shown, "blocks": blocks}, "page_dimensions": {"width": page.width, "height": page.height}}
            else:
                width, height = image_size(content)
                yield base | page_vectors(*embedder.page(content.decode("latin-1"))) | {"id": doc_id, "page_image": base64.b64encode(content).decode(), "page_dimensions": {"width": width, "height": height}}
        except Exception as problem:
            yield base | {"id": doc_id, "error": str(problem)}

    def run(batches):
        for batch in batches:
            for values in zip(batch["doc_id"], batch["name"], batch["ext"], batch["content"]):
                found = list(rows(*values))
                if found:
                    yield pd.DataFrame(found)[names]

    return files.select("doc_id", "name", "ext", "content").mapInPandas(run, ROW)
