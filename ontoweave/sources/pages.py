"""Landed API pages and event windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import field


def _at(kind: T.DataType, path: str) -> T.DataType | None:
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def explode_items(pages: DataFrame, items_path: str) -> DataFrame:
    """The rows of every page: the array at a dotted path, one row per item."""
    kind = _at(pages.schema, items_path)
    if not isinstance(kind, T.ArrayType):
        raise ValueError("Items must be an array; set the path to it")
    item = F.explode(F.col(".".join(f"`{p}`" for p in items_path.split(".")))).alias("item")
    exploded = pages.select(item)
    return exploded.select("item.*") if isinstance(kind.elementType, T.StructType) else exploded


def explode_json_items(pages: DataFrame, column: str, items_path: str, item: str) -> DataFrame:
    """The same for pages held as JSON text; ``item`` is the item's DDL type."""
    wrapped = f"array<{item}>"
    for name in reversed(items_path.split(".")):
        wrapped = f"struct<`{name}`: {wrapped}>"
    parsed = pages.select(F.from_json(field(column), wrapped, {"mode": "FAILFAST"}).alias("page"))
    return explode_items(parsed.select("page.*"), items_path)


def last_days(df: DataFrame, time: str, days: int = 30, today: dt.date | None = None) -> DataFrame:
    """The last ``days`` whole UTC days ending today, as a half-open range on the time
    column itself, so that it reaches the scan; a ``day`` partition prunes folders too."""
    if days < 1:
        raise ValueError("days must be at least 1")
    today = today or dt.datetime.now(dt.timezone.utc).date()
    start, end = today - dt.timedelta(days=days - 1), today + dt.timedelta(days=1)
    kind = df.schema[time].dataType
    bound = lambda day: F.lit(dt.datetime(day.year, day.month, day.day)).cast(kind)
    if isinstance(kind, T.TimestampType):
        bound = lambda day: F.lit(f"{day} 00:00:00 UTC").cast(kind)
    kept = df.where((field(time) >= bound(start)) & (field(time) < bound(end)))
    if "day" in df.columns:
        kept = kept.where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
    return kept


def write_by_day(df: DataFrame, time: str, path: str) -> None:
    """Lay events out by UTC day. Rebalancing gathers small days into one file each and
    splits a day that holds a third of all events over as many tasks as its size asks for."""
    dated = df.withColumn("day", F.to_date(field(time))).hint("rebalance", "day")
    dated.write.mode("overwrite").partitionBy("day").parquet(path)


def after(keys: Sequence[str], last: Sequence) -> Column:
    """Rows whose keys come lexicographically after the last row seen."""
    steps = []
    for i, key in enumerate(keys):
        equal = [field(k) == F.lit(v) for k, v in zip(keys[:i], last)]
        steps.append(reduce(Column.__and__, [*equal, field(key) > F.lit(last[i])]))
    return reduce(Column.__or__, steps)


def keyset_page(df: DataFrame, keys: Sequence[str], last: Sequence | None, limit: int) -> DataFrame:
    rows = df if last is None else df.where(after(keys, last))
    return rows.orderBy(*[field(k) for k in keys]).limit(limit)
