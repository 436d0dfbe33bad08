"""SQL text over declared DataFrames, and nothing else.

The text runs in a session of its own that holds only the declared views. Spark's parser
reads it first; the parsed plan may name declared views, its own CTEs and ordinary
functions, and nothing that reaches files, processes or the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field
from ..session import SETTINGS

# Spark features that leave the query, refused in user text.
REFUSED_NODES = {"ScriptTransformation"}
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


class QueryRefused(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    """Rows of one declared input whose column equals a value; null equals null."""

    dataset: str
    column: str
    value: object


def single_select(sql: str) -> str:
    text = re.sub(r";\s*$", "", sql.strip())
    if not re.match(r"(select|with)\b", text, re.I):
        raise QueryRefused("Only a single SELECT query is allowed")
    return text


def _seq(items) -> Iterable:
    return (items.apply(i) for i in range(items.size()))


def _parts(names) -> str:
    return ".".join(str(p) for p in _seq(names))


def _undeclared(node, visible: frozenset[str]) -> set[str]:
    """The relations a parsed plan names that are neither ``visible`` nor defined by a WITH
    whose scope they stand in. A WITH clause is seen by its own statement and by the
    definitions after it, not outside."""
    kind = node.getClass().getSimpleName()
    if kind in REFUSED_NODES:
        raise QueryRefused(f"{kind} is not allowed")
    if kind == "UnresolvedTableValuedFunction":
        _refuse_function(_parts(node.name()))
    found: set[str] = set()
    if kind == "UnresolvedRelation":
        name = _parts(node.multipartIdentifier()).lower()
        found |= set() if name in visible else {name}
    if kind == "UnresolvedWith":
        for relation in _seq(node.cteRelations()):
            name = str(relation._1()).lower()
            itself = {name} if node.allowRecursion() else set()
            found |= _undeclared(relation._2(), visible | itself)
            visible = visible | {name}
        return found | _undeclared(node.child(), visible)
    for expression in _seq(node.expressions()):
        found |= _undeclared_in(expression, visible)
    for child in [*_seq(node.children()), *_seq(node.innerChildren())]:
        found |= _undeclared(child, visible)
    return found


def _undeclared_in(expression, visible: frozenset[str]) -> set[str]:
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        _refuse_function(_parts(expression.nameParts()))
    found: set[str] = set()
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        found |= _undeclared(expression.plan(), visible)
    for child in _seq(expression.children()):
        found |= _undeclared_in(child, visible)
    return found


def _refuse_function(name: str) -> None:
    if name.lower().split(".")[-1] in REFUSED_FUNCTIONS:
        raise QueryRefused(f"Function {name} is not allowed")


def check(spark: SparkSession, sql: str, declared: Iterable[str]) -> str:
    """The statement, once every relation it names is declared; else raises."""
    text = single_select(sql)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    unknown = _undeclared(plan, frozenset(d.lower() for d in declared))
    if unknown:
        raise QueryRefused(f"Undeclared input {', '.join(sorted(unknown))}")
    return text


def sql_over(views: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Run one SELECT in a session whose only tables are the given views."""
    if not views:
        raise QueryRefused("Declare at least one input")
    source = next(iter(views.values())).sparkSession
    session = source.newSession()
    for key, value in SETTINGS.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", source.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    text = check(session, sql, views)
    for name, df in views.items():
        _in_session(df, session).createOrReplaceTempView("`" + name.replace("`", "``") + "`")
    return session.sql(text)


def _in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same plan, owned by another session, whose catalog its views then join."""
    plan = df._jdf.queryExecution().analyzed()
    dataset = session._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(session._jsparkSession, plan), session)


def dataset_table(dataset_id: str) -> str:
    return "d_" + dataset_id.replace("-", "")


def aliases(name: str) -> list[str]:
    """A dataset's display name and the same with underscores."""
    options = [name, re.sub(r"[^a-zA-Z0-9]+", "_", name)]
    return list({o.lower(): o for o in options if o}.values())


def bind(inputs: Mapping[str, tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Views for declared inputs ``{id: (name, DataFrame)}``: the table name of each, and
    its aliases where no other input and no table has the same one."""
    views = {dataset_table(i): df for i, (_, df) in inputs.items()}
    taken = {v.lower() for v in views} | {"result"}
    wanted = [(a, i) for i, (name, _) in inputs.items() for a in aliases(name)]
    for alias, dataset_id in wanted:
        claims = sum(other.lower() == alias.lower() for other, _ in wanted)
        if claims == 1 and alias.lower() not in taken:
            views[alias] = inputs[dataset_id][1]
            taken.add(alias.lower())
    return views


def prefilter(dataset_id: str, df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Apply an input's filters before the query; they push down to its scan."""
    for f in filters:
        if f.dataset != dataset_id:
            continue
        if f.column not in df.columns:
            raise ValueError("Unknown filter column")
        df = df.where(field(f.column).eqNullSafe(F.lit(f.value)))
    return df


def query_frames(
    inputs: Mapping[str, tuple[str, DataFrame]], sql: str, filters: Sequence[Filter] = ()
) -> DataFrame:
    """SQL over named inputs with declared filters applied to them first."""
    for f in filters:
        if f.dataset not in inputs:
            raise ValueError("Filter input is not declared")
    narrowed = {i: (name, prefilter(i, df, filters)) for i, (name, df) in inputs.items()}
    return sql_over(bind(narrowed), sql)


def infer_inputs(sql: str, listed: Sequence[str], names: Mapping[str, str]) -> list[str]:
    """Listed datasets (by id, or by a name or table only one has) and those the SQL names.

    ``names`` is ``{dataset id: display name}``.
    """
    mentioned = {t.lower() for t in re.findall(r"\bd_[a-z0-9_]+\b", sql, re.I)}
    found: list[str] = []
    for ref in listed:
        matches = [ref] if ref in names else [
            i for i, n in names.items() if n.lower() == ref.lower() or dataset_table(i) == ref
        ]
        found += matches if len(matches) == 1 else []
    found += [i for i in names if dataset_table(i).lower() in mentioned]
    return list(dict.fromkeys(found))
