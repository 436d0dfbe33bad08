"""Value overlap between key columns, and the edges it supports.

Every key column's values are counted once per column, then once per value, which gives
each value the sorted list of columns that hold it (at most one entry per key column).
Values with the same list are counted together, so the pairs of columns are formed from a
few distinct lists and never from values: the work is linear in distinct values, however
popular a value is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.text import field
from ..plans.cells import cells, counted, typed
from .keys import same_stem

EXACT, FOLDED = 0, 1
STEM_LETTERS = 3


def index_of(counts: DataFrame) -> DataFrame:
    """``(c, v, n)`` from counted cells: how often each column holds each non-blank value, as text."""
    # Numbers are counted as numbers; only distinct ones are printed.
    text = F.coalesce("text", F.col("number").cast("string"))
    return counts.select(F.col("position").alias("c"), text.alias("v"), "n").where(F.trim("v") != "")


def value_index(tables: Mapping[str, DataFrame], columns: Sequence[Row]) -> DataFrame:
    """``(c, v, n)``: how often each key column holds each non-blank value, as text.

    One scan per dataset, whatever number of its columns take part.
    """
    parts = []
    for dataset in dict.fromkeys(c["dataset"] for c in columns):
        df = tables[dataset]
        held = {}
        for c in columns:
            if c["dataset"] == dataset:
                value, kind = field(c["column"]), df.schema[c["column"]].dataType
                if c["field"]:
                    value, kind = value[c["field"]], kind[c["field"]].dataType
                held[c["i"]] = typed(value, kind, shorten=False)
        parts.append(cells(df, held))
    return index_of(counted(reduce(DataFrame.unionByName, parts)))


def _pairs(spark: SparkSession, columns: Sequence[Row], declared: set[tuple[int, int]]) -> tuple[DataFrame, DataFrame, Column]:
    """Key columns with what decides whether two of them compare, the declared pairs, and the rule
    over a pair ``a``, ``b`` of such columns.

    Texts pair freely across datasets; an integer only with a column whose noun starts the same, or
    with one a database declares. Only pairs that share a value come to the rule, so neither the
    driver nor a broadcast holds more than a row per column.
    """
    rows = [(c["i"], c["d"], c["integer"], c["stem"][:STEM_LETTERS]) for c in columns]
    about = local_frame(spark, rows, "i int, d int, integer boolean, stem string")
    stated = local_frame(spark, [(a, b, True) for a, b in sorted(declared)], "a int, b int, declared boolean")
    texts = ~F.col("x.integer") & ~F.col("y.integer")
    alike = texts | (F.col("x.stem") == F.col("y.stem")) | F.col("declared")
    return about, stated, (F.col("a") == F.col("b")) | ((F.col("x.d") != F.col("y.d")) & alike)


def key_overlap(
    tables: Mapping[str, DataFrame],
    columns: Sequence[Row],
    declared: set[tuple[int, int]] = frozenset(),
    index: DataFrame | None = None,
) -> DataFrame:
    """Shared values of each ordered pair of key columns, exactly and ignoring case:
    distinct shared values, rows of ``a`` that hold them, and the totals of ``a``.

    ``columns`` are rows of :func:`keys.key_columns`; ``index`` is their :func:`value_index`, where
    their values have been counted already.
    """
    spark = next(iter(tables.values())).sparkSession
    index = value_index(tables, columns) if index is None else index
    # One exchange and one sort, by folded text, bring the spellings of a value and the columns that
    # hold each together. Rows are counted per column and value already, so no value brings more of
    # them than key columns times its spellings; its digest is what the sort mostly compares.
    folded = F.lower(F.trim("v"))
    spelled = (
        index.repartition(folded)
        .select("c", "v", "n", folded.alias("f"))
        .withColumn("h", F.xxhash64("f"))
        .sortWithinPartitions("h", "f", "v", "c")
    )
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    text, spellings = Window.partitionBy("h", "f", "v").orderBy("c"), Window.partitionBy("h", "f").orderBy("v", "c")
    earlier = F.collect_set("c").over(spellings.rowsBetween(Window.unboundedPreceding, -1))
    held = spelled.select(
        "c",
        "n",
        F.collect_list("c").over(text.rowsBetween(*whole)).alias("exact"),
        F.array_sort(F.collect_set("c").over(spellings.rowsBetween(*whole))).alias("folded"),
        # A column that spells a value in several ways holds it once.
        (~F.array_contains(earlier, F.col("c"))).cast("bigint").alias("once"),
    )
    # Linear again: one row per value and column, combined map-side per list of columns.
    per_list = (
        held.groupBy("exact", "folded", "c")
        .agg(F.count(F.lit(1)).alias("written"), F.sum("once").alias("values"), F.sum("n").alias("rows"))
        .select(
            F.inline(
                F.array(
                    F.struct(F.lit(EXACT).alias("kind"), F.col("exact").alias("list"), "c", F.col("written").alias("values"), "rows"),
                    F.struct(F.lit(FOLDED).alias("kind"), F.col("folded").alias("list"), "c", "values", "rows"),
                )
            )
        )
    )
    about, stated, comparable = _pairs(spark, columns, set(declared))
    both = per_list.select("kind", F.col("c").alias("a"), F.explode("list").alias("b"), "values", "rows")

    def total(kind: int, what: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(what))), F.lit(0))

    # Per pair and list of columns first, so that the small tables meet few rows.
    met = both.groupBy("a", "b", "kind").agg(F.sum("values").alias("values"), F.sum("rows").alias("rows"))
    met = met.join(F.broadcast(stated), ["a", "b"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))
    met = met.join(F.broadcast(about).alias("x"), F.col("a") == F.col("x.i")).join(F.broadcast(about).alias("y"), F.col("b") == F.col("y.i"))
    counted = (
        met.where(comparable)
        .groupBy("a", "b", "declared")
        .agg(
            total(EXACT, "values").alias("m_exact"),
            total(FOLDED, "values").alias("m_ci"),
            total(EXACT, "rows").alias("a_rows_exact"),
            total(FOLDED, "rows").alias("a_rows_ci"),
        )
    )
    # A column against itself gives its totals; these windows span column pairs only.
    itself = F.col("a") == F.col("b")
    of_a, of_b = Window.partitionBy("a"), Window.partitionBy("b")
    return (
        counted.withColumns(
            {
                "a_distinct": F.max(F.when(itself, F.col("m_exact"))).over(of_a),
                "a_distinct_ci": F.max(F.when(itself, F.col("m_ci"))).over(of_a),
                "a_rows": F.max(F.when(itself, F.col("a_rows_exact"))).over(of_a),
                "b_distinct_ci": F.max(F.when(itself, F.col("m_ci"))).over(of_b),
            }
        )
        .where(~itself & (F.col("m_ci") > 0))
        .where(
            (F.col("m_ci") >= 0.5 * F.least("a_distinct_ci", "b_distinct_ci"))
            | (F.col("m_ci") >= 20)
            | F.col("declared")
        )
        .drop("b_distinct_ci")
    )


# Edges. From here on rows are pairs of key columns.

OVERLAP = (
    "a int, b int, declared boolean, m_exact bigint, m_ci bigint, a_rows_exact bigint, a_rows_ci bigint, "
    "a_distinct bigint, a_distinct_ci bigint, a_rows bigint"
)


def settled(overlap: DataFrame) -> DataFrame:
    """The overlap counted once, as local rows (at most one per pair of key columns), for
    rules that read it several times."""
    names = [part.split()[0] for part in OVERLAP.split(", ")]
    return local_frame(overlap.sparkSession, overlap.select(*names).collect(), OVERLAP)


def _sides(overlap: DataFrame, columns: DataFrame) -> DataFrame:
    kept = [c for c in columns.columns if c != "i"]
    a = columns.select(F.col("i").alias("a"), F.struct(*kept).alias("src"))
    b = columns.select(F.col("i").alias("b"), F.struct(*kept).alias("dst"))
    return overlap.join(F.broadcast(a), "a").join(F.broadcast(b), "b")


def link_candidates(overlap: DataFrame, columns: DataFrame) -> DataFrame:
    """Overlaps that point at a key: at least 80% of the distinct values, or 90% of the rows.

    The target is a table's own key or an alternate key (any key, if declared); integers
    need the same noun. Case is ignored for emails and where that finds more rows.
    """
    pair = _sides(overlap, columns)
    integers = F.col("src.integer") | F.col("dst.integer")
    undeclared = (
        (F.col("dst.own") | F.col("dst.alt"))
        & ~(F.col("dst.alt") & F.col("src.own"))
        & (~integers | same_stem(F.col("src.stem"), F.col("dst.stem")))
    )
    fold = F.col("src.email") | (F.col("a_rows_exact") < F.col("a_rows_ci"))
    shared = F.when(fold, F.col("m_ci")).otherwise(F.col("m_exact"))
    distinct = F.when(fold, F.col("a_distinct_ci")).otherwise(F.col("a_distinct"))
    matched = F.when(fold, F.col("a_rows_ci")).otherwise(F.col("a_rows_exact"))
    return (
        pair.where(F.col("dst.field").isNull())
        .where(F.when(F.col("declared"), F.col("dst.primary_key")).otherwise(undeclared))
        .withColumns(
            {
                "shared": shared,
                "of_distinct": distinct,
                "matched": matched,
                "case_rows": F.when(fold, F.col("a_rows_ci") - F.col("a_rows_exact")).otherwise(F.lit(0)),
            }
        )
        .where(
            F.when(F.col("declared"), F.col("shared") > 0).otherwise(
                (F.col("shared") / F.col("of_distinct") >= 0.8) | (F.col("matched") / F.col("a_rows") >= 0.9)
            )
        )
    )


def classify_edges(candidates: DataFrame) -> DataFrame:
    """What each edge says: the same record (identity), a 1:1 extension, or a reference;
    and why it is believed: declared, by name, or by values."""
    a, b = (lambda c: F.col(f"src.{c}")), (lambda c: F.col(f"dst.{c}"))
    same_words = a("words") == b("words")
    conventional = same_words | ((a("word_count") > 1) & a("id_name") & (a("prefix") == b("noun")))
    uploads = (a("source") == "upload") & (b("source") == "upload")
    # Merged records join without folding case, so identity asks for exact matches.
    exact = (F.col("m_exact") / F.col("a_distinct") >= 0.8) | (F.col("a_rows_exact") / F.col("a_rows") >= 0.9)
    identity = (
        a("field").isNull()
        & a("unique")
        & b("primary_key")
        & (a("system") != b("system"))
        & ~(uploads & conventional)
        & exact
    )
    extension = (
        a("own")
        & b("own")
        & (a("system") == b("system"))
        & (F.col("declared") | (F.col("shared") / F.col("of_distinct") >= 0.8))
        & (a("noun") != a("stem"))
        & (b("noun") == a("stem"))
    )
    by_name = (
        same_words
        | F.array_contains(a("singular_words"), b("stem"))
        | ((b("word_count") == 1) & (a("last_word") == b("first_word")))
    )
    return (
        candidates.withColumn("identity", identity)
        .withColumn("extension", extension & ~F.col("identity"))
        .where(~(a("own") | a("alt")) | F.col("identity") | F.col("extension"))
        .withColumn(
            "evidence",
            F.when(F.col("declared"), "declared").when(by_name, "name").otherwise("values"),
        )
    )


def serial_guard(edges: DataFrame) -> DataFrame:
    """Drop undeclared identities between integer own keys, which overlap by chance, unless
    something that is not an integer also matches the two datasets."""
    serial = (
        F.col("identity")
        & ~F.col("declared")
        & F.col("src.integer")
        & F.col("dst.integer")
        & F.col("src.own")
        & F.col("dst.own")
    )
    ends = F.array_sort(F.array("src.dataset", "dst.dataset"))
    confirmed = (
        edges.where((F.col("identity") | F.col("src.field").isNotNull()) & ~F.col("src.integer"))
        .select(ends.alias("ends"))
        .distinct()
        .withColumn("confirmed", F.lit(True))
    )
    return (
        edges.withColumn("ends", ends)
        .join(F.broadcast(confirmed), "ends", "left")
        .where(~serial | F.coalesce("confirmed", F.lit(False)))
        .drop("ends", "confirmed")
    )


def edge_rows(edges: DataFrame) -> DataFrame:
    """Classified edges, flat: the columns users and the suggestion read."""
    return edges.select(
        F.col("src.dataset").alias("from_dataset"),
        F.col("src.name").alias("from_column"),
        F.col("dst.dataset").alias("to_dataset"),
        F.col("dst.name").alias("to_column"),
        F.col("src.field").isNotNull().alias("from_field"),
        (F.col("src.own") | F.col("src.alt")).alias("from_key"),
        F.col("src.own").alias("from_own"),
        F.col("src.stem").alias("from_stem"),
        F.col("dst.noun").alias("to_noun"),
        "identity",
        "extension",
        "declared",
        "evidence",
        F.col("m_exact").alias("exact"),
        "matched",
        F.col("a_rows").alias("total"),
        "case_rows",
    )


# Paths and merges, counted on the rows.


def key_text(column: str, fold: bool) -> Column:
    text = field(column).cast("string")
    return F.lower(F.trim(text)) if fold else text


def two_hop_agreement(tables: Mapping[str, DataFrame], paths: Sequence[dict]) -> DataFrame:
    """For each path A→B→C beside a direct A→C: rows with the direct key, and how many of
    them reach the same record through B. A missing path is a disagreement.

    A path is ``{k, from, direct, first, via_dataset, via_key, via_column, fold_hop,
    fold_end}``. Both sides are counted per key before they meet, so a key held by a third
    of the rows is one row in the join.
    """
    parts = []
    for p in paths:
        starts = (
            tables[p["from"]]
            .where(field(p["direct"]).isNotNull())
            .groupBy(key_text(p["first"], p["fold_hop"]).alias("hop"), key_text(p["direct"], p["fold_end"]).alias("direct"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        middle = (
            tables[p["via_dataset"]]
            .groupBy(key_text(p["via_key"], p["fold_hop"]).alias("hop"), key_text(p["via_column"], p["fold_end"]).alias("via"))
            .agg(F.count(F.lit(1)).alias("m"))
        )
        rows = F.col("n") * F.coalesce("m", F.lit(1))
        parts.append(
            starts.join(middle, "hop", "left")
            .agg(
                F.coalesce(F.sum(rows), F.lit(0)).alias("n"),
                F.coalesce(F.sum(F.when(F.col("direct") == F.col("via"), rows)), F.lit(0)).alias("agree"),
            )
            .select(F.lit(p["k"]).alias("k"), "n", "agree")
        )
    return reduce(DataFrame.unionByName, parts)


def member_values(tables: Mapping[str, DataFrame], members: Mapping[str, dict], dataset: str, column: str) -> DataFrame:
    """Distinct texts of a member's column among the rows that reach the entity's anchor."""
    member = members[dataset]
    rows = tables[dataset]
    if member.get("via"):
        via = member["via"]
        reached = member_values(tables, members, via["target_dataset"], via["target_column"])
        linked = rows.select(key_text(column, False).alias("value"), key_text(via["column"], False).alias("v"))
        rows = linked.join(reached, "v", "left_semi").select(F.col("value").alias("v"))
    else:
        rows = rows.select(key_text(column, False).alias("v"))
    return rows.where(F.col("v").isNotNull()).distinct()


def through_anchor(tables: Mapping[str, DataFrame], links: Sequence[dict]) -> DataFrame:
    """Rows of each link that resolve through the merged dataset they point at.

    A link is ``{k, from, column, to, to_column, fold, members}``.
    """
    parts = []
    for link in links:
        reached = member_values(tables, link["members"], link["to"], link["to_column"])
        if link["fold"]:
            reached = reached.select(F.lower(F.trim("v")).alias("v")).distinct()
        counts = (
            tables[link["from"]]
            .groupBy(key_text(link["column"], link["fold"]).alias("v"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        parts.append(
            counts.join(reached, "v", "left_semi")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            .select(F.lit(link["k"]).alias("k"), "n")
        )
    return reduce(DataFrame.unionByName, parts)


