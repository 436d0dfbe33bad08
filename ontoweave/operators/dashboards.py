"""Dashboards: widgets over SQL, their presentation, and the overview of an ontology."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds
from ..functions.names import plural
from ..functions.text import field
from .query import query_frames
from .suggest import Suggestion


@dataclass(frozen=True)
class Widget:
    title: str
    type: str  # metric, bar, line or table
    sql: str
    inputs: tuple[str, ...]
    x: str | None = None
    y: str | None = None


@dataclass(frozen=True)
class Dashboard:
    name: str
    widgets: tuple[Widget, ...]
    description: str = ""


def dashboard_of(stored: Mapping) -> Dashboard:
    """A dashboard from its stored form."""
    widgets = tuple(Widget(**{**w, "inputs": tuple(w["inputs"])}) for w in stored["widgets"])
    return Dashboard(stored["name"], widgets, stored["description"])


def presented(rows: DataFrame, w: Widget) -> Widget:
    """The presentation the result's shape allows, with axis names that exist."""
    columns = rows.columns
    if w.type == "metric":
        many = rows.limit(2).count()
        if many != 1 or len(columns) != 1:
            numeric = len(columns) == 2 and kinds.is_numeric(rows.schema.fields[1].dataType)
            if numeric and many > 1:
                w = replace(w, type="bar", x=columns[0], y=columns[1])
            else:
                w = replace(w, type="table")
    for axis in ("x", "y"):
        name = getattr(w, axis)
        bare = name.split(".")[-1] if name else None
        if name and name not in columns and bare in columns:
            w = replace(w, **{axis: bare})
        if getattr(w, axis) and getattr(w, axis) not in columns and w.type in ("bar", "line"):
            raise ValueError(f"Unknown chart {axis} field")
    return w


def widget(inputs: Mapping[str, tuple[str, DataFrame]], w: Widget) -> tuple[DataFrame, Widget]:
    """A widget's rows over its declared inputs, and how to show them."""
    missing = [i for i in w.inputs if i not in inputs]
    if missing:
        raise ValueError(f"Unknown dataset {', '.join(missing)}")
    rows = query_frames({i: inputs[i] for i in w.inputs}, w.sql)
    return rows, presented(rows, w)


def records_by_type(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Records of each type, most first. Counts come from Parquet footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("type"), "records")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy(F.col("records").desc(), "type")


def records_by_month(df: DataFrame, time: str) -> DataFrame:
    month = F.date_format(field(time).cast("timestamp_ntz"), "yyyy-MM")
    return (
        df.where(field(time).isNotNull())
        .groupBy(month.alias("month"))
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy("month")
    )


# Names of columns that date a record, the likelier first.
DATED = [r"creat", r"date|start|sign.?up|joined"]


def dated_column(tables: Mapping[str, DataFrame]) -> tuple[str, str] | None:
    """The first table and column that say when its records came to be."""
    for pattern in DATED:
        for name, df in tables.items():
            for f in df.schema.fields:
                if kinds.is_temporal(f.dataType) and re.search(pattern, f.name, re.I):
                    return name, f.name
    return None


def overview(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, DataFrame]]:
    """The overview of an ontology: the hub's records (the first table), records by type,
    and new records by month, as (title, presentation, rows)."""
    if not tables:
        raise ValueError("Connect or upload a dataset first")
    hub = next(iter(tables))
    out = [(hub, "metric", tables[hub].agg(F.count(F.lit(1)).alias("records")))]
    if len(tables) > 1:
        out.append(("Records by type", "bar", records_by_type(tables)))
    dated = dated_column(tables)
    if dated:
        name, column = dated
        out.append((f"New {name.lower()} per month", "line", records_by_month(tables[name], column)))
    return out


def overview_tables(s: Suggestion, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The record types of an ontology by their plural, the best linked first."""
    links = lambda e: sum(e.id in (x.source, x.target) for x in s.links)
    records = [e for e in s.entities if e.kind == "record" and e.anchor in tables]
    return {plural(e.name): tables[e.anchor] for e in sorted(records, key=links, reverse=True)}


def save_analysis(dashboards: Sequence[Dashboard], name: str, title: str, sql: str, inputs: Sequence[str]) -> list[Dashboard]:
    """Keep an answered query as a table widget; a dashboard of that name is replaced."""
    saved = Dashboard(name, (Widget(title, "table", sql, tuple(inputs)),))
    return [*[d for d in dashboards if d.name != name], saved]
