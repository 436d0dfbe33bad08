"""Column expressions shared by several operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kinds

# Texts that stand for "no value", and names that hint at private data.
BLANKS = ["", "None", "null", "NaN"]
SENSITIVE = r"email|phone|ssn|password|secret|token|address|birth|credit"


def field(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_blank(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin(BLANKS)


def unless_blank(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def normalized_key(value: Column) -> Column:
    """Keys compared without regard to case, edge spaces or column type."""
    return F.lower(F.trim(value.cast("string")))


def is_sensitive(name: str) -> bool:
    return re.search(SENSITIVE, name, re.I) is not None


def shorten(text: Column, longest: int | None) -> Column:
    """The first ``longest`` characters, with a mark where some are left out; all by default."""
    if longest is None:
        return text
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)


def redact(text: Column) -> Column:
    """The whole text with credentials dropped; see :func:`shorten` for messages."""
    # What counts as a credential.
    urls = r"(?i)\b(postgres(?:ql)?|mysql)://[^\s]+"
    pairs = r"(?i)(password|api[_-]?key|authorization|token)\s*[:=]\s*[^\s,;]+"
    cleaned = F.regexp_replace(text, urls, "$1://[redacted]")
    return F.regexp_replace(cleaned, pairs, "$1=[redacted]")


def plain(value: Column, kind: T.DataType) -> Column:
    """A value as the text a reader would see; nested values as JSON."""
    if kinds.is_nested(kind):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def canonical(value: Column, kind: T.DataType) -> Column:
    """Text that is equal exactly when the values are equal, for distinct counting."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, T.MapType):
        value = F.array_sort(F.map_entries(value))
    return plain(value, kind)
