"""Definition-sized rows (columns, types, links, registry entries) as local DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def at_least(name: str, value: int, least: int) -> int:
    """A caller's number as it is, or an error where it makes no sense."""
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def _plain(value):
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Rows the driver already holds, as a relation inside the plan: no job, no Python
    worker, and a size Catalyst knows when it picks a join."""
    parsed = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], parsed)
    arrays = [
        pa.array([_plain(r[i]) for r in rows], type=to_arrow_type(f.dataType))
        for i, f in enumerate(parsed.fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=parsed.names), parsed)
