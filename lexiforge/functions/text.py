"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a key falls into words (before an upper-case letter).
KEY_BREAKS = ("(.)([A-Z][a-z]+)", "([a-z0-9])([A-Z])")
#: White space that is stripped from the ends of pieces.
SPACES = " \t\n\x0b\f\r"


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentence_hash(text: Column) -> Column:
    """md5 of the text with white space collapsed and stripped."""
    return F.md5(collapse_spaces(text).cast("binary"))


def natural_key(name: Column) -> Column:
    """``releaseYear`` and ``release_year`` become ``Release year``."""
    for pattern in KEY_BREAKS:
        name = F.regexp_replace(name, pattern, "$1 $2")
    name = F.translate(name, "_", " ")
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))


def natural_name(name: str) -> str:
    """:func:`natural_key` of one key."""
    for pattern in KEY_BREAKS:
        name = re.sub(pattern, r"\1 \2", name)
    name = name.replace("_", " ")
    return name[:1].upper() + name[1:].lower()


def extension(name: Column) -> Column:
    """After the last dot, case kept (routing)."""
    return F.element_at(F.split(name, r"\."), -1)


def extension_lower(name: Column) -> Column:
    """With its dot, lower-cased; empty without one (extraction)."""
    return F.lower(F.regexp_extract(name, r"(?s)[^/]*?(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scrub(value: Column) -> Column:
    """Without the bytes that are no UTF-8 (halves of surrogate pairs)."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit("")))


def scrub_array(values: Column) -> Column:
    return F.transform(values, scrub)


def scrub_map(values: Column) -> Column:
    return F.transform_values(values, lambda _, v: scrub(v))


def base64_payload(text: Column) -> Column:
    """Bytes of base64 text; what stands before a first comma (a data URL's head) goes."""
    return F.unbase64(F.when(F.contains(text, F.lit(",")), F.split(text, ",")[1]).otherwise(text))
