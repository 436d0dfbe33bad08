"""Profiles: exact counts per column, duplicates, fingerprint, samples, schema cards.

One scan melts every row into ``(column, value)`` cells. Counting equal cells first (combined
map-side) and then cells per column gives the null count and the exact distinct count from one
shuffle of cells, however many columns there are. Duplicate rows and the fingerprint come from the
rows' hashes, which a second scan counts: they hardly ever combine, and in one hash table with the
cells they push it to disk.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds
from ..functions.hashing import digest, row_hash
from ..functions.local import at_least, local_frame
from ..functions.text import canonical, field, is_sensitive, plain, shorten, unless_blank
from ..plans.cells import cells, counted, is_null, typed
from ..plans.ordered import Key, page_of

ROW = -1
FACTS = "position int, name string, type string, sensitive boolean"


def _measures(counts: DataFrame) -> DataFrame:
    """One row per column from counted cells."""
    return counts.groupBy("position").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(is_null(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(F.when(~is_null(), 1)).alias("distinct"),
    )


def _row_measures(df: DataFrame) -> DataFrame:
    """One row about whole rows, from their counted hashes; none for an empty table."""
    a, b = row_hash(df)
    times = F.col("a").cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)")
    counts = df.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.lit(ROW).alias("position")).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct"),
        # Equal rows cancel in pairs, as they do one by one.
        F.bit_xor(F.when(F.col("n") % 2 == 1, F.col("a")).otherwise(0)).alias("xor_hash"),
        F.sum(times).alias("sum_hash"),
    )


def _cells(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    columns = {
        position: typed(field(f.name), f.dataType)
        for position, f in enumerate(df.schema.fields)
        if only is None or f.name in only
    }
    return counted(cells(df, columns))


def key_counts(tables: Mapping[str, tuple[DataFrame, list[str]]]) -> dict[tuple[str, str], dict]:
    """Rows, nulls and distinct values of some columns of several tables, by table and
    column name. All cells meet in one shuffle; one row per column reaches the driver."""
    names: dict[int, tuple[str, str]] = {}
    parts = []
    for table, (df, only) in tables.items():
        columns = {}
        for f in df.schema.fields:
            if f.name in only:
                columns[len(names)] = typed(field(f.name), f.dataType)
                names[len(names)] = (table, f.name)
        parts.append(cells(df, columns))
    return measured_keys(counted(reduce(DataFrame.unionByName, parts)), names)


def measured_keys(counts: DataFrame, names: Mapping[int, tuple[str, str]]) -> dict[tuple[str, str], dict]:
    """The measures of counted cells by table and column name, from the numbers they have there."""
    measured = _measures(counts)
    flag = key_flag(F.col("rows"), F.col("nulls"), F.col("distinct"))
    found = {
        names[r["position"]]: r.asDict()
        for r in measured.select("position", "rows", "nulls", "distinct", flag.alias("primary_key")).collect()
        if r["position"] in names
    }
    empty = {"rows": 0, "nulls": 0, "distinct": 0, "primary_key": False}
    return {name: found.get(name, empty) for name in names.values()}


def _facts(df: DataFrame) -> DataFrame:
    """Schema as a small DataFrame: position, name, type, sensitive."""
    rows = [
        (i, f.name, kinds.sql_name(f.dataType), is_sensitive(f.name))
        for i, f in enumerate(df.schema.fields)
    ]
    return small(df, rows, FACTS)


def small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return local_frame(df.sparkSession, rows, schema)


def profile_columns(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Exact null and distinct counts and the key flag, one row per column in order.

    Both sides have one row per column, so the join is a broadcast of a few rows.
    """
    counts = F.broadcast(_measures(_cells(df, only)))
    facts = _facts(df) if only is None else _facts(df).where(F.col("name").isin(only))
    return facts.join(counts, "position", "left").select(
        "position",
        "name",
        "type",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("nulls", F.lit(0)).alias("nulls"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "sensitive",
        key_flag(
            F.coalesce("rows", F.lit(0)),
            F.coalesce("nulls", F.lit(0)),
            F.coalesce("distinct", F.lit(0)),
        ).alias("primary_key"),
    )


def key_flag(rows: Column, nulls: Column, distinct: Column) -> Column:
    return (rows > 0) & (nulls == 0) & (distinct == rows)


def profile_rows(df: DataFrame) -> DataFrame:
    """Row and column counts and the described schema."""
    described = [f"{f.name} {kinds.sql_name(f.dataType)}" for f in df.schema.fields]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(described)).alias("columns"),
        F.lit(", ".join(described)).alias("schema"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls are equal."""
    a, b = row_hash(df)
    return (
        df.groupBy(a.alias("a"), b.alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def _described(schema: T.StructType) -> str:
    return json.dumps([[f.name, kinds.sql_name(f.dataType)] for f in schema.fields])


def fingerprint(df: DataFrame) -> DataFrame:
    """A digest of schema and content that row order does not change.

    XOR alone cancels a pair of equal rows, so the sum of hashes is part of it too.
    """
    a, _ = row_hash(df)
    wide = a.cast("decimal(38,0)")
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(a).alias("x"), F.sum(wide).alias("s"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("rows", "x", "s")]
    mark = F.sha2(F.concat_ws("|", F.lit(_described(df.schema)), *parts), 256)
    return counted.select("rows", mark.alias("fingerprint"))


def profile_cells(df: DataFrame) -> DataFrame:
    """The counts of a whole profile, one row per column."""
    return _measures(_cells(df))


def profile(df: DataFrame) -> dict:
    """The whole dataset profile: counts, duplicates, fingerprint, columns. One job, from
    which one row per column comes back."""
    measured = profile_cells(df).unionByName(_row_measures(df), allowMissingColumns=True)
    found = {r["position"]: r for r in measured.collect()}
    whole = found.get(ROW)
    rows = whole["rows"] if whole else 0
    columns = []
    for position, f in enumerate(df.schema.fields):
        nulls, distinct = (found[position]["nulls"], found[position]["distinct"]) if whole else (0, 0)
        columns.append(
            {
                "position": position,
                "name": f.name,
                "type": kinds.sql_name(f.dataType),
                "rows": rows,
                "nulls": nulls,
                "distinct": distinct,
                "sensitive": is_sensitive(f.name),
                "primary_key": rows > 0 and nulls == 0 and distinct == rows,
            }
        )
    marks = [str(whole[c]) if whole and whole[c] is not None else "-" for c in ("xor_hash", "sum_hash")]
    return {
        "rows": rows,
        "duplicate_rows": rows - whole["distinct"] if whole else 0,
        "fingerprint": digest("|".join([_described(df.schema), str(rows), *marks])),
        "columns": columns,
    }


def _orderable(df: DataFrame) -> list[Column]:
    """A total order over whole rows; maps and variants take part as text."""
    return [
        canonical(field(f.name), f.dataType)
        if "map<" in f.dataType.simpleString() or isinstance(f.dataType, T.VariantType)
        else field(f.name)
        for f in df.schema.fields
    ]


def sample_rows(df: DataFrame, n: int = 50) -> DataFrame:
    """The first rows in the order of all columns, so a rerun shows the same rows."""
    return df.orderBy(*_orderable(df)).limit(at_least("n", n, 0))


def page(df: DataFrame, order_by: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page under a total order: the named columns, ties broken by the others."""
    ranked = [Key(c) for c in [*(field(c) for c in order_by), *_orderable(df)]]
    return page_of(df, ranked, at_least("offset", offset, 0), at_least("limit", limit, 0))


def counted_page(df: DataFrame, order_by: list[str], offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
    """One page, and how many rows there are in all."""
    return page(df, order_by, offset, limit), df.count()


def examples(df: DataFrame, n: int = 3) -> DataFrame:
    """The first values of each column, as text, from the sample."""
    top = sample_rows(df, n)
    pairs = [
        F.struct(F.lit(f.name).alias("name"), plain(field(f.name), f.dataType).alias("example"))
        for f in df.schema.fields
    ]
    return top.select(F.inline(F.array(*pairs))).groupBy("name").agg(
        F.array_sort(F.collect_list("example")).alias("examples")
    )


def category_columns(df: DataFrame, columns: Mapping[str, dict], most: int = 50) -> list[str]:
    """Names of low-cardinality, public, non-key text or boolean columns."""
    out = []
    for f in df.schema.fields:
        facts = columns.get(f.name)
        if (
            facts
            and isinstance(f.dataType, (T.StringType, T.BooleanType))
            and not facts["sensitive"]
            and not facts["primary_key"]
            and 1 <= facts["distinct"] <= most
        ):
            out.append(f.name)
    return out


def column_roles(df: DataFrame, columns: Mapping[str, dict]) -> dict[str, set[str]]:
    """Which roles each column can play: time, number, category, key, nested."""
    categories = set(category_columns(df, columns))
    roles = {}
    for f in df.schema.fields:
        roles[f.name] = {
            role
            for role, holds in [
                ("time", kinds.is_temporal(f.dataType)),
                ("number", kinds.is_numeric(f.dataType)),
                ("nested", kinds.is_nested(f.dataType)),
                ("category", f.name in categories),
                ("key", bool(columns.get(f.name, {}).get("primary_key"))),
            ]
            if holds
        }
    return roles


def facts_by_name(profile_df: DataFrame) -> dict[str, dict]:
    """Column profile rows (one per column) keyed by name, for definition rules."""
    return {r["name"]: r.asDict() for r in profile_df.collect()}


def observed_values(df: DataFrame, names: list[str], most: int = 12) -> DataFrame:
    """Up to ``most`` distinct non-blank values per column, read from all rows.

    Meant for category columns, whose profile already bounds their distinct values.
    """
    pairs = [
        F.struct(F.lit(c).alias("name"), unless_blank(field(c).cast("string")).alias("value"))
        for c in names
    ]
    if not pairs:
        return small(df, [], "name string, values array<string>")
    return (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .distinct()
        .groupBy("name")
        .agg(F.slice(F.array_sort(F.collect_list("value")), 1, most).alias("values"))
    )


def schema_card(df: DataFrame, profile_df: DataFrame) -> DataFrame:
    """One readable line per non-nested column: type, uniqueness, nulls, category values."""
    facts = facts_by_name(profile_df)
    few = category_columns(df, facts, most=12)
    keep = [f.name for f in df.schema.fields if not kinds.is_nested(f.dataType)]
    values = F.broadcast(observed_values(df, few))
    lines = small(
        df,
        [
            (facts[c]["position"], c, facts[c]["type"], facts[c]["primary_key"], facts[c]["nulls"])
            for c in keep
        ],
        "position int, name string, type string, unique boolean, nulls bigint",
    )
    return lines.join(values, "name", "left").select(
        "position",
        "name",
        F.concat_ws(
            " ",
            "name",
            "type",
            F.when(F.col("unique"), F.lit("unique")),
            F.when(F.col("nulls") > 0, F.concat(F.col("nulls"), F.lit(" null"))),
            F.concat(F.lit("values: "), F.array_join("values", "|")),
        ).alias("card"),
    )


def _shortened(value: Column, kind: T.DataType, longest: int | None) -> Column:
    if longest is None:
        return value
    if isinstance(kind, T.StringType):
        return shorten(value, longest)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _shortened(x, kind.elementType, longest))
    if isinstance(kind, T.StructType):
        inner = [_shortened(value[f.name], f.dataType, longest).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _shortened(v, kind.valueType, longest))
    return value


def mask_sample(df: DataFrame, hide: bool = True, longest: int | None = None) -> DataFrame:
    """Sensitive columns read ``[masked]``; texts, nested ones too, keep ``longest`` characters
    if one is given."""
    return df.select(
        *[
            F.lit("[masked]").alias(f.name)
            if hide and is_sensitive(f.name)
            else _shortened(field(f.name), f.dataType, longest).alias(f.name)
            for f in df.schema.fields
        ]
    )
