"""Checking definitions against the data before they are published."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jobs import together
from ..functions.local import local_frame
from ..functions.text import field
from ..plans.runs import PipelineDef, run_checks
from . import dashboards as D
from . import entities as E
from .dashboards import Widget
from .entities import Bundle, RelationshipDef, TypeDef
from .query import QueryRefused
from .profile import facts_by_name, key_counts, key_flag, profile_columns

REPORT = "kind string, name string, passed boolean, detail string"


@dataclass(frozen=True)
class CheckResult:
    kind: str  # names, table, pipeline, type, relationship, dashboard, action or catalog
    name: str
    passed: bool
    detail: str


def fits(t: TypeDef, facts: Mapping[str, dict]) -> bool:
    """Whether a dataset has the type's unique key and all its properties."""
    return bool(facts.get(t.key, {}).get("primary_key")) and all(p in facts for p in t.properties)


def rehome(types: Sequence[TypeDef], facts: Mapping[str, Mapping[str, dict]], derived: set[str]) -> list[TypeDef]:
    """Move a type that does not fit its dataset to the only one it fits. A type on a
    derived table stays, as that table may not exist yet."""
    out = []
    for t in types:
        stays = t.dataset in derived or t.dataset.startswith("pipeline_") or fits(t, facts.get(t.dataset, {}))
        owners = [] if stays else [i for i, f in facts.items() if fits(t, f)]
        out.append(replace(t, dataset=owners[0]) if len(owners) == 1 else t)
    return out


def type_key_check(df: DataFrame, t: TypeDef) -> DataFrame:
    """One row: whether the columns exist and the key is unique and non-null."""
    unknown = [c for c in (t.key, *t.properties) if c not in df.columns]
    if unknown:
        row = (t.name, False, f"Unknown property {unknown[0]}", None)
        return local_frame(df.sparkSession, [row], "type string, passed boolean, detail string, rows bigint")
    flag = profile_columns(df, only=[t.key])
    return flag.select(
        F.lit(t.name).alias("type"),
        F.col("primary_key").alias("passed"),
        F.when(F.col("primary_key"), F.concat("rows", F.lit(" objects; unique non-null key")))
        .otherwise(F.lit("Primary key must be unique and non-null"))
        .alias("detail"),
        "rows",
    )


def relationship_coverage(
    source: DataFrame, target: DataFrame, source_key: str, target_key: str, from_column: str, to_column: str
) -> DataFrame:
    """Distinct source keys, those with a match, and joined pairs, in one row.

    The target is counted per join value first, so each source row meets at most one count
    and pairs are never formed. A value that many source rows share is a skewed join with a
    single row on the other side, which AQE splits.
    """
    right = (
        target.groupBy(field(to_column).alias("v"))
        .agg(F.count(field(target_key)).alias("pairs"))
        .where(F.col("v").isNotNull())
    )
    left = source.select(field(source_key).alias("k"), field(from_column).alias("v"))
    per_key = (
        left.join(right, "v", "left")
        .groupBy("k")
        .agg(
            F.max(F.coalesce("pairs", F.lit(0)) > 0).alias("matched"),
            F.sum("pairs").alias("pairs"),
        )
    )
    return per_key.agg(
        F.count("k").alias("total"),
        F.count(F.when(F.col("matched") & F.col("k").isNotNull(), 1)).alias("matched"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
    )


def cardinality(from_unique: Column, to_unique: Column) -> Column:
    side = lambda unique: F.when(unique, "one").otherwise("many")
    return F.concat(side(from_unique), F.lit("-to-"), side(to_unique))


def column_flags(df: DataFrame, column: str) -> DataFrame:
    """Key flag of one column, as a single row."""
    value = field(column)
    per_value = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows, nulls = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    return per_value.agg(key_flag(rows, nulls, F.count("v")).alias("unique"))


def relationship_cardinality(source: DataFrame, target: DataFrame, from_column: str, to_column: str) -> DataFrame:
    flags = [
        column_flags(df, c).select(F.lit(side).alias("side"), "unique")
        for side, df, c in [("from", source, from_column), ("to", target, to_column)]
    ]
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("unique")))
    return flags[0].unionByName(flags[1]).agg(cardinality(pick("from"), pick("to")).alias("cardinality"))


def _named_once(bundle: Bundle) -> CheckResult:
    groups = [bundle.tables, bundle.pipelines, bundle.types, bundle.relationships, bundle.dashboards, bundle.actions]
    ok = all(len({x.name for x in g}) == len(g) for g in groups)
    return CheckResult("names", "Definition identities", ok, "Names must be unique within each asset type")


def validate_bundle(tables: Mapping[str, DataFrame], columns: E.Columns, bundle: Bundle) -> list[CheckResult]:
    """Every definition checked on the data, in two jobs: one counts all keys and join
    columns, the other all relationships. A row per column and per relationship comes back.
    Pipelines are built in the order of their inputs, and each of their checks and each widget of
    a dashboard is one more query.
    """
    built, unbuilt = E.try_tables(bundle, tables, columns)
    types = {t.name: t for t in bundle.types}
    flaws = {("type", t.name): _type_flaw(t, built) for t in bundle.types}
    flaws |= {("relationship", r.name): _relationship_flaw(r, types, built) for r in bundle.relationships}
    sound_types = [t for t in bundle.types if not flaws["type", t.name]]
    sound_links = [r for r in bundle.relationships if not flaws["relationship", r.name]]

    wanted: dict[str, dict[str, None]] = {}
    for t in [*(t for t in bundle.tables if t.id not in unbuilt), *sound_types]:
        wanted.setdefault(t.id if isinstance(t, E.TableDef) else t.dataset, {})[t.key] = None
    for r in sound_links:
        wanted.setdefault(types[r.from_type].dataset, {})[r.from_column] = None
        wanted.setdefault(types[r.to_type].dataset, {})[r.to_column] = None
    columns_wanted = {i: (built[i], list(names)) for i, names in wanted.items()}
    counts, covered = together(
        [lambda: key_counts(columns_wanted) if wanted else {}, lambda: _coverages(sound_links, types, built)]
    )

    results = [_named_once(bundle)]
    for dataset, _, _ in bundle.catalog:
        known = dataset in tables
        results.append(CheckResult("catalog", dataset, known, "Described" if known else "Unknown dataset"))
    for p in bundle.pipelines:
        results.append(_pipeline_result(p, built, unbuilt))
    for t in bundle.tables:
        if t.id in unbuilt:
            results.append(CheckResult("table", t.name, False, unbuilt[t.id]))
            continue
        key, name = counts[t.id, t.key], E.checks(bundle)[t.id]
        ok = key["nulls"] == 0 and key["distinct"] == key["rows"]
        results.append(CheckResult("table", t.name, ok, name if ok else f"Quality check failed: {name}"))
    for t in bundle.types:
        flaw = flaws["type", t.name]
        if not flaw and not counts[t.dataset, t.key]["primary_key"]:
            flaw = "Primary key must be unique and non-null"
        detail = flaw or f"{counts[t.dataset, t.key]['rows']} objects; unique non-null key"
        results.append(CheckResult("type", t.name, not flaw, detail))
    for r in bundle.relationships:
        detail = flaws["relationship", r.name]
        if detail is None:
            shape = "-to-".join(
                "one" if counts[types[name].dataset, c]["primary_key"] else "many"
                for name, c in ((r.from_type, r.from_column), (r.to_type, r.to_column))
            )
            found = covered[r.name]
            detail = (
                f"{found['matched']}/{found['total']} source objects matched; {shape}; {found['pairs']} relationship pairs"
            )
        results.append(CheckResult("relationship", r.name, flaws["relationship", r.name] is None, detail))
    results += [result for _, result in widgets(bundle, built)]
    for a in bundle.actions:
        t = types.get(a.type)
        ok = t is not None and editable(t, a.fields)
        unfit = "Action fields must exist and cannot change identity" if t else "Unknown action type"
        results.append(CheckResult("action", a.name, ok, "Editable fields verified" if ok else unfit))
    return results


def _pipeline_result(p: PipelineDef, built: Mapping[str, DataFrame], unbuilt: Mapping[str, str]) -> CheckResult:
    if p.id in unbuilt:
        return CheckResult("pipeline", p.name, False, unbuilt[p.id])
    report = run_checks(built[p.id], {i: built[i] for i in p.inputs}, p.checks)
    failed = [r["name"] for r in report.collect() if not r["passed"]]
    detail = f"Quality check failed: {', '.join(failed)}" if failed else f"{len(p.checks)} quality checks passed"
    return CheckResult("pipeline", p.name, not failed, detail)


def widgets(bundle: Bundle, built: Mapping[str, DataFrame]) -> list[tuple[tuple[str, Widget], CheckResult]]:
    """Each widget, as its result allows to show it, under its dashboard's name, and whether its
    query runs."""
    names = {x.id: x.name for x in [*bundle.tables, *bundle.pipelines]}
    inputs = {i: (names.get(i, i), df) for i, df in built.items()}
    out = []
    for d in bundle.dashboards:
        for w in d.widgets:
            about = f"{d.name} / {w.title}"
            try:
                rows, shown = D.widget(inputs, w)
                out.append(((d.name, shown), CheckResult("dashboard", about, True, f"{rows.count()} result rows; query executed")))
            except (ValueError, AnalysisException, ParseException, QueryRefused) as e:
                out.append(((d.name, w), CheckResult("dashboard", about, False, str(e).strip().split("\n")[0])))
    return out


def presented(bundle: Bundle, tables: Mapping[str, DataFrame], columns: E.Columns) -> Bundle:
    """The bundle with its widgets as their results are to be shown."""
    shown = [placed for placed, _ in widgets(bundle, E.try_tables(bundle, tables, columns)[0])]
    return replace(
        bundle,
        dashboards=tuple(replace(d, widgets=tuple(w for name, w in shown if name == d.name)) for d in bundle.dashboards),
    )


def _type_flaw(t: TypeDef, tables: Mapping[str, DataFrame]) -> str | None:
    if t.dataset not in tables:
        return "Unknown dataset"
    unknown = [c for c in (t.key, *t.properties) if c not in tables[t.dataset].columns]
    return f"Unknown property {unknown[0]}" if unknown else None


def _relationship_flaw(
    r: RelationshipDef, types: Mapping[str, TypeDef], tables: Mapping[str, DataFrame]
) -> str | None:
    source, target = types.get(r.from_type), types.get(r.to_type)
    if source is None or target is None:
        return f"Unknown object type in {r.from_type} → {r.to_type}"
    for t, column in ((source, r.from_column), (target, r.to_column)):
        if t.dataset not in tables or not {column, t.key} <= set(tables[t.dataset].columns):
            return "Unknown relationship column"
    return None


def _coverages(
    links: Sequence[RelationshipDef], types: Mapping[str, TypeDef], tables: Mapping[str, DataFrame]
) -> dict[str, dict]:
    """Coverage of every relationship, by name, from one job."""
    parts = []
    for r in links:
        a, b = types[r.from_type], types[r.to_type]
        one = relationship_coverage(tables[a.dataset], tables[b.dataset], a.key, b.key, r.from_column, r.to_column)
        parts.append(one.withColumn("name", F.lit(r.name)))
    return {row["name"]: row.asDict() for row in reduce(DataFrame.unionByName, parts).collect()} if parts else {}


def editable(t: TypeDef, fields: Sequence[str]) -> bool:
    """Fields a person may edit: properties of the type, never its key."""
    return all(f in t.properties and f != t.key for f in fields)


def drop_failing(bundle: Bundle, report: Sequence[CheckResult]) -> Bundle:
    """The bundle without what failed, and without what depends on a failed table or type."""
    failed = {(c.kind, c.name) for c in report if not c.passed}
    gone = {t.id for t in bundle.tables if ("table", t.name) in failed}
    gone |= {p.id for p in bundle.pipelines if ("pipeline", p.name) in failed}
    for x in E.build_order(bundle):
        if any(i in gone for i in x.inputs):
            gone.add(x.id)
    types = {t.name for t in bundle.types if ("type", t.name) not in failed and t.dataset not in gone}
    kept = [
        replace(d, widgets=tuple(w for w in d.widgets if ("dashboard", f"{d.name} / {w.title}") not in failed and not gone & set(w.inputs)))
        for d in bundle.dashboards
    ]
    return replace(
        bundle,
        tables=tuple(t for t in bundle.tables if t.id not in gone),
        pipelines=tuple(p for p in bundle.pipelines if p.id not in gone),
        dashboards=tuple(d for d in kept if d.widgets),
        types=tuple(t for t in bundle.types if t.name in types),
        relationships=tuple(
            r for r in bundle.relationships
            if ("relationship", r.name) not in failed and {r.from_type, r.to_type} <= types
        ),
        actions=tuple(a for a in bundle.actions if a.type in types and ("action", a.name) not in failed),
        catalog=tuple(entry for entry in bundle.catalog if ("catalog", entry[0]) not in failed),
    )


def report_frame(spark, report: Sequence[CheckResult]) -> DataFrame:
    return local_frame(spark, [(c.kind, c.name, c.passed, c.detail) for c in report], REPORT)


def dataset_facts(tables: Mapping[str, DataFrame]) -> dict[str, dict[str, dict]]:
    return {i: facts_by_name(profile_columns(df)) for i, df in tables.items()}
