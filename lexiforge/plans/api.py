"""The service's five operations as plain calls (a web layer only has to name them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .store import Store

#: Fixed value: how an error begins in place of a result.
ERROR = "ERRR:"


def _or_error(call: Callable):
    try:
        return call()
    except Exception as problem:
        return f"{ERROR}{problem}"


class Service:
    """Fixed names: the calls' and their parameters'."""

    def __init__(self, store: Store):
        self.store = store

    def ingest(self, files: DataFrame, client: str, bot: str, txt_collection: str, img_collection: str) -> dict:
        rows = self.store.ingest(client, bot, files, txt_collection, img_collection).collect()
        return {r["name"]: {"id": r["doc_id"], "collection": r["collection"], "error": r["error"]} for r in rows}

    def delete(self, docid: str, collection: str):
        return _or_error(lambda: self.store.delete_by_docid(docid, collection))

    def searchdoc(self, docid: str, collection: str):
        return _or_error(lambda: [r.asDict(True) for r in self.store.search_by_docid(docid, collection).collect()])

    def query(self, query: str, imgcollection: str = "", txtcollection: str = "", client: str = "", bot: str = "", limit: int = 10, prefetch: int = 100, tokens: DataFrame | None = None):
        """``tokens`` (token, query) replace the page embedder's vectors of the query."""
        return _or_error(lambda: [r.asDict(True) for r in self.store.search(query, txtcollection, imgcollection, client, bot, limit, prefetch, tokens).collect()])

    def allcolumns(self) -> list[str]:
        return [r["collection"] for r in self.store.collections().collect()]
