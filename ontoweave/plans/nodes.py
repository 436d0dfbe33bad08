"""Graphs of data-preparation nodes, folded to one DataFrame.

Each node is a small function of its input DataFrames. The fold evaluates a shared node
once, so Catalyst sees one plan and fuses, prunes and pushes down across nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds
from ..functions.names import unique_name
from ..functions.text import field
from ..operators.profile import _orderable
from ..operators.query import sql_over


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    inputs: tuple[str, ...] = ()
    config: Mapping = default(default_factory=dict)
    dataset: str | None = None
    sql: str | None = None


def _required(config: Mapping, name: str, kind: type):
    value = config.get(name)
    if not isinstance(value, kind) or not value:
        raise ValueError(f"Set {name}")
    return value


def _check_columns(df: DataFrame, wanted) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown column {', '.join(missing)}")


def distinct_names(names: Sequence[str]) -> list[str]:
    """Output names made unique ignoring case: a repeated ``id`` becomes ``id_1``."""
    taken: set[str] = set()
    return [unique_name(n, taken, first=1) for n in names]


def select(df: DataFrame, config: Mapping) -> DataFrame:
    columns = _required(config, "columns", list)
    _check_columns(df, columns)
    return df.select(*[field(c) for c in columns])


def rename(df: DataFrame, config: Mapping) -> DataFrame:
    mapping = _required(config, "mapping", dict)
    _check_columns(df, mapping)
    return df.withColumnsRenamed(mapping)


def cast(df: DataFrame, config: Mapping) -> DataFrame:
    columns = _required(config, "columns", dict)
    _check_columns(df, columns)
    return df.withColumns(
        {c: field(c).cast(kinds.spark_type(kind)) for c, kind in columns.items()}
    )


def keep(df: DataFrame, config: Mapping) -> DataFrame:
    return df.where(_required(config, "condition", str))


def derive(df: DataFrame, config: Mapping) -> DataFrame:
    columns = _required(config, "columns", dict)
    added = [f"{expression} AS `{name}`" for name, expression in columns.items()]
    widened = df.selectExpr("*", *added)
    return widened.toDF(*distinct_names(widened.columns))


def deduplicate(df: DataFrame, config: Mapping) -> DataFrame:
    """One row per key: the least row in the order of all columns.

    A minimum combines map-side, so a key that holds a third of the rows never meets in
    one task, as it would under ``row_number``.
    """
    keys = config.get("keys")
    if not keys:
        return df.distinct()
    _check_columns(df, keys)
    whole = F.struct(*[field(c) for c in df.columns])
    maps = any("map<" in f.dataType.simpleString() for f in df.schema.fields)
    least = F.min_by(whole, F.struct(*_orderable(df))) if maps else F.min(whole)
    groups = [field(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    picked = df.groupBy(*groups).agg(least.alias("__row"))
    return picked.select("__row.*")


def join(left: DataFrame, right: DataFrame, config: Mapping) -> DataFrame:
    condition = _required(config, "on", str)
    how = "LEFT" if config.get("joinType") == "left" else "INNER"
    chosen = config.get("select") or "a.*, b.*"
    plain = lambda text: text.replace("{", "{{").replace("}", "}}")
    joined = left.sparkSession.sql(
        f"SELECT {plain(chosen)} FROM {{left}} a {how} JOIN {{right}} b ON {plain(condition)}",
        left=left,
        right=right,
    )
    return joined.toDF(*distinct_names(joined.columns))


def aggregate(df: DataFrame, config: Mapping) -> DataFrame:
    keys = config.get("groupBy") or []
    metrics = _required(config, "metrics", dict)
    _check_columns(df, keys)
    return df.groupBy(*[field(k) for k in keys]).agg(
        *[F.expr(expression).alias(name) for name, expression in metrics.items()]
    )


ONE_INPUT: dict[str, Callable[[DataFrame, Mapping], DataFrame]] = {
    "select": select,
    "rename": rename,
    "cast": cast,
    "filter": keep,
    "derive": derive,
    "deduplicate": deduplicate,
    "aggregate": aggregate,
}


def order(nodes: Sequence[Node]) -> list[Node]:
    """Nodes with every input before its reader; raises on a graph that is not one."""
    if not nodes:
        raise ValueError("Add at least one node")
    by_id = {n.id: n for n in nodes}
    if len(by_id) != len(nodes):
        raise ValueError("Node IDs must be unique")
    for node in nodes:
        for i in node.inputs:
            if i not in by_id:
                raise ValueError(f"Unknown node {i}")
    read = {i for n in nodes for i in n.inputs}
    placed: dict[str, Node] = {}
    while len(placed) < len(nodes):
        ready = [n for n in nodes if n.id not in placed and all(i in placed for i in n.inputs)]
        if not ready:
            raise ValueError("The graph has a cycle")
        placed.update((n.id, n) for n in ready)
    leaves = [n for n in nodes if n.id not in read]
    if len(leaves) != 1:
        raise ValueError("Connect every branch to one output node")
    rest = [n for n in placed.values() if n.id != leaves[0].id]
    return [*rest, leaves[0]]


def build(nodes: Sequence[Node], datasets: Mapping[str, DataFrame]) -> DataFrame:
    """The graph's one output. ``datasets`` are the declared inputs by id."""
    done: dict[str, DataFrame] = {}
    result = None
    for node in order(nodes):
        inputs = [done[i] for i in node.inputs]
        if node.type == "source":
            if not node.dataset:
                raise ValueError("Select a source dataset")
            if node.dataset not in datasets:
                raise ValueError(f"Unknown dataset {node.dataset}")
            result = datasets[node.dataset]
        elif node.type == "sql":
            if not node.sql:
                raise ValueError(f"Write the SQL of {node.id}")
            views = {f"node_{i}": done[i] for i in done} | dict(datasets)
            result = sql_over(views, node.sql)
        elif not inputs:
            raise ValueError(f"Connect an input to {node.id}")
        elif node.type == "join":
            if len(inputs) != 2:
                raise ValueError("A join needs two inputs")
            result = join(*inputs, node.config)
        elif node.type in ONE_INPUT:
            result = ONE_INPUT[node.type](inputs[0], node.config)
        else:
            raise ValueError(f"Unknown node type {node.type}")
        done[node.id] = result
    return result


def source_ids(nodes: Sequence[Node]) -> list[str]:
    return list(dict.fromkeys(n.dataset for n in nodes if n.type == "source" and n.dataset))
