"""Keys of datasets, read from profiles and names.

Profiles are collected (one row per column), name rules are added on the driver, and the
key rules run as ordinary DataFrame operations over those column facts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds, names
from ..functions.local import local_frame
from ..functions.text import field
from ..plans.cells import cells, counted, typed
from ..session import cut
from .profile import measured_keys

# One row per column (or text field of a struct column) that may take part in a link.
FACTS = (
    "i int, dataset string, d int, system string, source string, table string, position int, "
    "name string, column string, field string, type string, rows bigint, nulls bigint, distinct bigint, "
    "primary_key boolean, key_type boolean, integer boolean, temporal boolean, nested boolean, "
    "id_name boolean, key_name boolean, email boolean, names_table boolean, refers boolean, "
    "stem string, noun string, words string, word_count int, first_word string, last_word string, "
    "singular_words array<string>, prefix string"
)


FLAGGED = FACTS + ", own boolean, alt boolean, unique boolean, links boolean"


@dataclass(frozen=True)
class Dataset:
    """A named table of one system. Uploads are systems of their own."""

    id: str
    name: str
    df: DataFrame
    source: str = "upload"
    system: str = ""
    source_name: str = ""

    @property
    def home(self) -> str:
        return self.system or (f"dataset:{self.id}" if self.source == "upload" else self.source)

    @property
    def table(self) -> str:
        return names.table_name(self.name, self.source)


def ordered(datasets: Iterable[Dataset]) -> list[Dataset]:
    """By name, so that results do not depend on the order of the input."""
    return sorted(datasets, key=lambda d: (d.name, d.id))


@dataclass(frozen=True)
class Counted:
    """The cells of all columns that could be keys, counted once and written: profiles and overlap
    both read them. ``places`` are the numbers of columns, by dataset, column and field."""

    counts: DataFrame
    places: Mapping[tuple[str, str, str | None], int]

    def index(self, columns: Sequence) -> DataFrame:
        """:func:`overlap.value_index` of some columns, under the numbers ``i`` they have there."""
        from .overlap import index_of

        numbers = [(self.places[c["dataset"], c["column"], c["field"]], c["i"]) for c in columns]
        wanted = local_frame(self.counts.sparkSession, numbers, "position int, i int")
        kept = self.counts.join(F.broadcast(wanted), "position").drop("position").withColumnRenamed("i", "position")
        return index_of(kept)


def count_keys(datasets: Sequence[Dataset], declared: DataFrame | None = None) -> Counted:
    """Count the values of all columns that could be keys, from one scan per dataset and one shuffle.

    Of columns that may link, by their name or by a declared key, the whole text counts, of others
    a digest of long ones.
    """
    stated = set() if declared is None else {
        (r[f"{end}_dataset"], r[f"{end}_column"]) for r in declared.collect() for end in ("from", "to")
    }
    places: dict[tuple[str, str, str | None], int] = {}
    parts = []
    for d in datasets:
        others = {names.noun(x.table) for x in datasets if x is not d}
        held = {}
        for f in d.df.schema.fields:
            if kinds.is_key_type(f.dataType):
                links = names.is_key(f.name) or names.noun(f.name) in others or (d.id, f.name) in stated
                places[d.id, f.name, None] = len(places)
                held[places[d.id, f.name, None]] = typed(field(f.name), f.dataType, shorten=not links)
            for inner in kinds.text_fields(f.dataType):
                if names.is_key(inner):
                    places[d.id, f.name, inner] = len(places)
                    value = field(f.name)[inner]
                    held[places[d.id, f.name, inner]] = typed(value, f.dataType[inner].dataType, shorten=False)
        if not any(k[0] == d.id and k[2] is None for k in places):
            first = d.df.schema.fields[0]
            places[d.id, first.name, None] = len(places)
            held[places[d.id, first.name, None]] = typed(field(first.name), first.dataType)
        parts.append(cells(d.df, held))
    return Counted(cut(counted(reduce(DataFrame.unionByName, parts))), places)


def profiles(datasets: Sequence[Dataset], known: Counted | None = None) -> dict[str, list[dict]]:
    """Column profiles by dataset id. Only counts reach the driver, one row per column.

    Only columns that could be keys are counted; of the others rules read just the type.
    """
    known = count_keys(datasets) if known is None else known
    counted = measured_keys(known.counts, {n: (d, c) for (d, c, inner), n in known.places.items() if inner is None})
    rows = {i: c["rows"] for (i, _), c in counted.items()}
    out: dict[str, list[dict]] = {}
    for d in datasets:
        out[d.id] = []
        for position, f in enumerate(d.df.schema.fields):
            about = {"position": position, "name": f.name, "type": kinds.sql_name(f.dataType)}
            none = {"rows": rows[d.id], "nulls": 0, "distinct": 0, "primary_key": False}
            out[d.id].append(counted.get((d.id, f.name), none) | about)
    return out


def _name_facts(name: str, table: str, others: set[str]) -> tuple:
    parts = names.words(name)
    stem = names.stem(name, table)
    table_nouns = {names.singular(w) for w in names.words(table)}
    return (
        names.is_id(name),
        names.is_key(name),
        names.is_email(name),
        parts == ["id"] or (names.is_id(name) and stem in table_nouns),
        names.noun(name) in others,
        stem,
        names.noun(table),
        "_".join(parts),
        len(parts),
        parts[0] if parts else "",
        parts[-1] if parts else "",
        [names.singular(w) for w in parts],
        "_".join(names.singular(w) for w in parts[:-1]),
    )


def column_facts(datasets: Sequence[Dataset], profiled: Mapping[str, list[dict]] | None = None) -> DataFrame:
    datasets = ordered(datasets)
    profiled = profiled or profiles(datasets)
    rows: list[tuple] = []
    for d, dataset in enumerate(datasets):
        others = {names.noun(x.table) for x in datasets if x is not dataset}
        place = (dataset.id, d, dataset.home, dataset.source, dataset.table)
        for c, f in zip(profiled[dataset.id], dataset.df.schema.fields):
            flags = (
                kinds.is_key_type(f.dataType),
                kinds.is_integer(f.dataType),
                kinds.is_temporal(f.dataType),
                kinds.is_nested(f.dataType),
            )
            counts = (c["rows"], c["nulls"], c["distinct"])
            rows.append(
                (len(rows), *place, c["position"], f.name, f.name, None, c["type"], *counts, c["primary_key"],
                 *flags, *_name_facts(f.name, dataset.table, others))
            )
            for inner in kinds.text_fields(f.dataType):
                named = f"{f.name}.{inner}"
                facts = list(_name_facts(named, dataset.table, others))
                facts[1] = names.is_key(inner)
                rows.append(
                    (len(rows), *place, c["position"], named, f.name, inner, "VARCHAR", *counts, False,
                     True, False, False, False, *facts)
                )
    return local_frame(datasets[0].df.sparkSession, rows, FACTS)


def own_keys(facts: DataFrame) -> DataFrame:
    """Each dataset's own key: a unique column of key type, the one named for the table
    first; a name that is not an identifier is a last resort."""
    rank = (
        F.when(F.col("names_table"), 0)
        .when(F.col("id_name"), 1)
        .when(F.col("key_name") & ~F.col("email"), 2)
        .when(~F.col("integer") & ~F.col("email"), 3)
        .when(F.col("integer"), 4)
    )
    return (
        facts.where(F.col("primary_key") & F.col("key_type") & F.col("field").isNull())
        .withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy("dataset")
        .agg(F.min_by("name", F.struct("rank", "position")).alias("key"))
    )


def alternate_keys(facts: DataFrame, own: DataFrame) -> DataFrame:
    """Other unique columns named like natural keys: email, sku, code."""
    return (
        facts.where(
            F.col("primary_key") & F.col("key_type") & F.col("key_name") & ~F.col("id_name") & F.col("field").isNull()
        )
        .join(F.broadcast(own), "dataset", "left")
        .where(~F.col("name").eqNullSafe(F.col("key")))
        .select("dataset", "name")
    )


def declared_keys(datasets: DataFrame, edges: DataFrame) -> DataFrame:
    """Foreign keys a database declares, matched to datasets of the same system.

    ``datasets(dataset, d, system, source_name)``; ``edges(system, table_name, column_name,
    referenced_table, referenced_column)``. Table names match ignoring case, and with a
    schema in front; definitions only, so both sides are small.
    """

    def match(side: DataFrame, table: str, target: str) -> DataFrame:
        wanted, have = F.lower(table), F.lower(F.col("source_name"))
        exact = have == wanted
        found = side.join(
            F.broadcast(datasets.select(F.col("system").alias("s"), "source_name", "dataset", "d")),
            (F.col("system") == F.col("s")) & (exact | have.endswith(F.concat(F.lit("."), wanted))),
        )
        # An exact name before a qualified one.
        return found.groupBy(*side.columns).agg(
            F.min_by("dataset", F.struct(~exact, F.col("d"))).alias(target)
        )

    both = match(match(edges, "table_name", "from_dataset"), "referenced_table", "to_dataset")
    return (
        both.where("from_dataset <> to_dataset")
        .select("from_dataset", F.col("column_name").alias("from_column"), "to_dataset", F.col("referenced_column").alias("to_column"))
        .distinct()
    )


EDGES = "system string, table_name string, column_name string, referenced_table string, referenced_column string"


def edges_of(spark: SparkSession, links: Mapping[str, Sequence[tuple[str, str, str, str]]]) -> DataFrame:
    """Links that sources state (``billing.relationships()`` and the like), by system."""
    return local_frame(spark, [(system, *link) for system, some in links.items() for link in some], EDGES)


def declared_for(datasets: Sequence[Dataset], edges: DataFrame) -> DataFrame:
    """Declared keys among datasets, for :func:`suggest.suggest_ontology`. A dataset is
    known by its source's name for it, else by its table name."""
    known = [(d.id, n, d.home, d.source_name or d.table) for n, d in enumerate(ordered(datasets))]
    return declared_keys(
        local_frame(edges.sparkSession, known, "dataset string, d int, system string, source_name string"), edges
    )


def flag_columns(facts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Column facts with what each column is: the own key, an alternate key, unique, and
    ``links``: whether its values may link datasets.

    Linking columns are named like a key or after another dataset, are text fields with key
    names inside a struct, or are declared.
    """
    own = own_keys(facts)
    alternate = alternate_keys(facts, own).withColumn("alt", F.lit(True))
    plain = F.col("field").isNull()
    named = F.when(
        plain, F.col("key_type") & (F.col("key_name") | F.col("refers")) & (F.col("distinct") >= 2)
    ).otherwise(F.col("key_name"))
    flagged = (
        facts.join(F.broadcast(own), "dataset", "left")
        .join(F.broadcast(alternate), ["dataset", "name"], "left")
        .withColumn("own", F.col("key").eqNullSafe(F.col("name")) & plain)
        .withColumn("alt", F.coalesce("alt", F.lit(False)))
        .withColumn("unique", plain & (F.col("distinct") > 0) & (F.col("distinct") == F.col("rows") - F.col("nulls")))
        .drop("key")
    )
    if declared is None:
        return flagged.withColumn("links", named)
    ends = (
        declared.select(F.col("from_dataset").alias("dataset"), F.col("from_column").alias("name"))
        .unionByName(declared.select(F.col("to_dataset").alias("dataset"), F.col("to_column").alias("name")))
        .distinct()
        .withColumn("stated", F.lit(True))
    )
    stated = plain & F.col("key_type") & F.coalesce("stated", F.lit(False))
    return (
        flagged.join(F.broadcast(ends), ["dataset", "name"], "left")
        .withColumn("links", named | stated)
        .drop("stated")
    )


def key_columns(facts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """The columns whose values may link datasets."""
    return flag_columns(facts, declared).where("links")


def settled(columns: DataFrame) -> DataFrame:
    """Flagged columns read once, as local rows, for rules that use them several times."""
    names = [part.split()[0] for part in FLAGGED.split(", ")]
    return local_frame(columns.sparkSession, columns.select(*names).collect(), FLAGGED)


def same_stem(a: Column, b: Column) -> Column:
    shortened = (F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a))
    return (a == b) | shortened
