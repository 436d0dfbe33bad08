"""Row hashes and identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import canonical, field

LONG_TEXT = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _hashable(f: T.StructField) -> Column:
    has_map = "map<" in f.dataType.simpleString() or isinstance(f.dataType, T.VariantType)
    if has_map or isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return canonical(field(f.name), f.dataType)
    return field(f.name)


def row_hash(df: DataFrame) -> tuple[Column, Column]:
    """Two differently seeded 64-bit hashes of the whole row.

    ``xxhash64`` passes over nulls, so every column also hashes its null flag.
    """
    parts: list[Column] = []
    for f in df.schema.fields:
        parts += [_hashable(f), field(f.name).isNull()]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def compact(text: Column) -> Column:
    """Long texts shuffle as their SHA-256, never as a prefix."""
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(
        F.concat(F.lit("="), text)
    )


def logical_id(type_id: str, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(type_id + ":"), key), 256), 1, 32)
