"""Settings of the engine (fixed values: the defaults that results depend on)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    min_chars: int = 600
    ideal_chars: int = 1000
    max_chars: int = 1200
    drift: float = 0.3
    limit: int = 10
    prefetch: int = 100
    page_batch: int = 5
    dims: int = 64
    #: Buckets of a new collection: a lookup or delete touches one of them.
    buckets: int = 64
    text_formats: tuple[str, ...] = ("txt", "docx", "md", "csv", "json", "html", "xml", "epub", "log")
    image_formats: tuple[str, ...] = ("png", "jpg", "pdf")


DEFAULT = Config()
