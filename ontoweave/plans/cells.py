"""Columns turned into ``(column number, value)`` cells and counted.

``UNPIVOT`` plans as an Expand inside the scan's generated code, so a row becomes its cells
without being copied into an array, and counting combines before the shuffle. A value keeps
its own kind (whole number, double or text): numbers are never printed to be counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds
from ..functions.hashing import compact
from ..functions.text import canonical

LONG, DOUBLE, TEXT = "number", "double", "text"


def typed(value: Column, kind: T.DataType, shorten: bool = True) -> tuple[str, Column]:
    """The family a value counts in, and the value there; equal exactly when values are."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return LONG, value.cast("bigint")
    if isinstance(kind, T.DateType):
        return LONG, F.unix_date(value).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return LONG, F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return DOUBLE, value.cast("double")
    text = canonical(value, kind)
    long_texts = isinstance(kind, T.StringType) or kinds.is_nested(kind)
    return TEXT, compact(text) if shorten and long_texts else text


FAMILIES = {LONG: "bigint", DOUBLE: "double", TEXT: "string"}


def cells(df: DataFrame, columns: Mapping[int, tuple[str, Column]]) -> DataFrame:
    """``(position, number, double, text)``: one row per row and column.

    ``columns`` are :func:`typed` values by number. A null value is a cell with nothing in it.
    Families that no column uses are left out of the cells and added back as constants, to keep
    the cells narrow.
    """
    values = {position: {family: value} for position, (family, value) in columns.items()}
    used = [f for f in FAMILIES if any(f in v for v in values.values())]
    prepared = [F.lit(None).cast(FAMILIES[f]).alias(f"no_{f}") for f in used]
    slots = []
    for n, (position, given) in enumerate(values.items()):
        prepared += [F.lit(position).alias(f"p{n}")]
        prepared += [value.alias(f"{family}{n}") for family, value in given.items()]
        names = [f"{f}{n}" if f in given else f"no_{f}" for f in used]
        slots.append(f"({', '.join([f'p{n}', *names])}) AS `{n}`")
    wide = df.select(*prepared)
    shown = [f if f in used else f"CAST(NULL AS {kind}) AS {f}" for f, kind in FAMILIES.items()]
    text = (
        f"SELECT position, {', '.join(shown)} FROM {{wide}} "
        f"UNPIVOT INCLUDE NULLS ((position, {', '.join(used)}) FOR slot IN ({', '.join(slots)}))"
    )
    return df.sparkSession.sql(text, wide=wide)


def counted(cells: DataFrame) -> DataFrame:
    """How often each column holds each value, ``n``. Equal cells combine map-side."""
    per_cell = cells.groupBy("position", "number", "double", "text")
    return per_cell.agg(F.count(F.lit(1)).alias("n"))


def is_null() -> Column:
    """Whether a cell holds nothing: the column was null there."""
    return F.col("number").isNull() & F.col("double").isNull() & F.col("text").isNull()
