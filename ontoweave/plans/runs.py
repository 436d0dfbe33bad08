"""What surrounds a graph run: quality checks, rejected rows, previews, re-runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field
from ..operators.profile import sample_rows, small
from ..operators.query import sql_over
from ..operators.snapshots import Snapshots
from .nodes import Node, build, source_ids


@dataclass(frozen=True)
class Check:
    name: str
    sql: str


@dataclass(frozen=True)
class PipelineDef:
    """A graph of nodes whose output is a derived dataset of a bundle, and what must hold of it."""

    id: str
    name: str
    nodes: tuple[Node, ...]
    checks: tuple[Check, ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(source_ids(self.nodes))


def run_checks(output: DataFrame, sources: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Each check's first row must be all true (or 1). One row per check: name, passed.

    A check reads one row, so only that row reaches the driver.
    """
    results = []
    for check in checks:
        first = sql_over({**sources, "output": output}, check.sql).first()
        passed = first is not None and all(v is True or v == 1 or v == "1" for v in first)
        results.append((check.name, passed))
    return small(output, results, "name string, passed boolean")


def rejected_rows(source: DataFrame, output: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Source rows whose key no output row has; a caller showing a few sets a limit."""
    missing = source.join(output.select(field(key)), key, "left_anti").select(*source.columns)
    return missing if limit is None else sample_rows(missing, limit)


def kept_key(facts: Mapping[str, dict], output: DataFrame) -> str | None:
    """The source's first key that the output still has, to tell rejected rows by."""
    return next((c for c, f in facts.items() if f["primary_key"] and c in output.columns), None)


def preview(sources: Mapping[str, DataFrame], output: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows of every input and of the output, each row as JSON."""
    parts = [
        sample_rows(df, rows).select(F.lit(name).alias("dataset"), F.to_json(F.struct("*")).alias("row"))
        for name, df in [*sources.items(), ("output", output)]
    ]
    return reduce(DataFrame.unionByName, parts)


def rerun(store: Snapshots, graph: Sequence[Node], output_id: str, name: str, version: str | None = None) -> dict:
    """Run a graph again over the active versions of its datasets, and serve the result as
    a new version of its output."""
    ids = source_ids(graph)
    result = build(graph, {i: store.active(i) for i in ids})
    state = store.commit(output_id, name, result, version)
    store.record_lineage(output_id, ids)
    return state
