"""Objects and relations published from typed tables, and their generations.

An object's id is computed from its type and key, so relations are a join of two tables
and need no lookup of what was written before.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as default
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest, logical_id
from ..functions.jobs import together
from ..functions.local import local_frame
from ..functions.text import BLANKS, field, plain
from .dashboards import Dashboard, dashboard_of
from .entities import Bundle, RelationshipDef, TypeDef
from .log import Fact, Log

if TYPE_CHECKING:
    from .editstore import EditStore

OBJECT = (
    "id string, generation string, type string, type_id string, key string, logical_id string, "
    "name string, base map<string,string>, source_version string, manual boolean"
)
RELATION = "generation string, name string, from_id string, to_id string"


class PublicationRefused(RuntimeError):
    pass


def type_id(name: str) -> str:
    return digest(name)[:20]


def object_id(type_name: str, key: Column) -> Column:
    return logical_id(type_id(type_name), key.cast("string"))


def base_values(df: DataFrame) -> Column:
    """A row as a map of texts; a null stays a null."""
    pairs = []
    for f in df.schema.fields:
        pairs += [F.lit(f.name), plain(field(f.name), f.dataType)]
    return F.create_map(*pairs)


def objects(df: DataFrame, t: TypeDef, generation: str, version: str | None = None) -> DataFrame:
    """One object per row of a type's table."""
    key = field(t.key).cast("string")
    logical = object_id(t.name, key)
    return df.select(
        F.concat(F.lit(generation + "_"), logical).alias("id"),
        F.lit(generation).alias("generation"),
        F.lit(t.name).alias("type"),
        F.lit(type_id(t.name)).alias("type_id"),
        key.alias("key"),
        logical.alias("logical_id"),
        F.concat(F.lit(t.name + " "), key).alias("name"),
        base_values(df).alias("base"),
        F.lit(version).cast("string").alias("source_version"),
        F.lit(False).alias("manual"),
    )


def relations(
    source: DataFrame, target: DataFrame, a: TypeDef, b: TypeDef, r: RelationshipDef, generation: str
) -> DataFrame:
    """One relation per matching pair of rows. Only the two keys and the two join columns
    are read; AQE splits a join value that holds a large share of the rows."""
    left = source.select(field(a.key).cast("string").alias("from_key"), field(r.from_column).alias("v"))
    right = target.select(field(b.key).cast("string").alias("to_key"), field(r.to_column).alias("v"))
    left, right = left.where("from_key IS NOT NULL"), right.where("to_key IS NOT NULL")
    return left.join(right, "v").select(
        F.lit(generation).alias("generation"),
        F.lit(r.name).alias("name"),
        F.concat(F.lit(generation + "_"), object_id(a.name, F.col("from_key"))).alias("from_id"),
        F.concat(F.lit(generation + "_"), object_id(b.name, F.col("to_key"))).alias("to_id"),
    )


def object_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type").agg(F.count(F.lit(1)).alias("objects"))


def ends(relations: DataFrame) -> DataFrame:
    """Both ends of every relation, from one read of the relations."""
    return relations.select(F.explode(F.array("from_id", "to_id")).alias("id"))


def link_counts(relations: DataFrame) -> DataFrame:
    """Relations at each record, counted at both ends."""
    return ends(relations).groupBy("id").agg(F.count(F.lit(1)).alias("links"))


def visible(df: DataFrame, generation: str | None) -> DataFrame:
    """Rows of the active generation, and rows that belong to none."""
    return df.where(F.col("generation").isNull() | F.col("generation").eqNullSafe(F.lit(generation)))


def publication_counts(
    objects: DataFrame, relations: DataFrame, bundle: Bundle, rows: Mapping[str, int], generation: str
) -> DataFrame:
    """Records and relations written so far, all records to write, and an estimate of the
    relations: one per row of each relationship's source type."""
    size = {t.name: rows.get(t.dataset, 0) for t in bundle.types}
    counts = [
        df.where(F.col("generation") == generation).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        for what, df in (("records", objects), ("relations", relations))
    ]
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("n")))
    return counts[0].unionByName(counts[1]).agg(
        pick("records").alias("records"),
        pick("relations").alias("relations"),
        F.lit(sum(size.values())).cast("bigint").alias("total_records"),
        F.lit(sum(size.get(r.from_type, 0) for r in bundle.relationships)).cast("bigint").alias("estimated_relations"),
    )


# Publication.


@dataclass
class Graph:
    """Published generations under one folder.

    ``objects`` and ``relations`` are partitioned by generation, and files lie in the order they
    are looked up in: objects by type and id, relations by the record they start from, and once
    more (``relations_to``) by the one they lead to. The statistics of Parquet then leave a read
    of one record a few files, however large the generation is. A generation is visible only once
    the log states it, which happens last; of two publications on one base the second is refused.
    """

    spark: SparkSession
    root: str
    log: Log = default(init=False, repr=False)

    def __post_init__(self) -> None:
        self.log = Log(self.spark, f"{self.root}/log")

    def _table(self, name: str, schema: str) -> DataFrame:
        parsed = T._parse_datatype_string(schema)
        try:
            return self.spark.read.schema(parsed).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return local_frame(self.spark, [], schema)

    def pointer(self) -> dict | None:
        """The active publication: generation, previous, bundle_hash, actor, types, edits_version."""
        return self.log.get("pointer", "active")

    def active(self) -> str | None:
        row = self.pointer()
        return row["generation"] if row else None

    def _of(self, name: str, schema: str, generation: str | None) -> DataFrame:
        return self._table(name, schema).where(F.col("generation") == (generation or self.active()))

    def objects(self, generation: str | None = None) -> DataFrame:
        return self._of("objects", OBJECT, generation)

    def relations(self, generation: str | None = None) -> DataFrame:
        """Relations, by the record they start from."""
        return self._of("relations", RELATION, generation)

    def relations_to(self, generation: str | None = None) -> DataFrame:
        """The same relations, by the record they lead to."""
        return self._of("relations_to", RELATION, generation)

    def dashboards(self, generation: str | None = None) -> list[Dashboard]:
        found = self.log.get("dashboards", generation or self.active() or "")
        return [dashboard_of(d) for d in found["dashboards"]] if found else []

    def publish(
        self,
        bundle: Bundle,
        tables: Mapping[str, DataFrame],
        base: str | None = None,
        expected_hash: str | None = None,
        recorded: Mapping[str, str] | None = None,
        versions: Mapping[str, str] | None = None,
        manual: DataFrame | None = None,
        relation_edits: DataFrame | None = None,
        actor: str = "",
        generation: str | None = None,
        stored: EditStore | None = None,
    ) -> str:
        """Write all objects and relations of a validated bundle as a new generation.

        ``base`` is the generation the bundle was validated on, ``recorded`` the input
        versions of then and ``versions`` those of now; a difference refuses. ``tables``
        hold the bundle's derived tables too. Edits that people made are applied again: those
        given, and those ``stored`` up to now; the publication says how far that was, and
        :meth:`records` adds what came later.
        """
        from . import edits

        if expected_hash is not None and expected_hash != bundle_hash(bundle):
            raise PublicationRefused("Definitions changed; review the current version")
        versions = versions or {}
        if any(versions.get(d) != v for d, v in (recorded or {}).items()):
            raise PublicationRefused("Input data changed. Revalidate these definitions.")
        current = self.pointer()
        if (current["generation"] if current else None) != base:
            raise PublicationRefused("Published definitions changed. Revalidate these definitions.")
        generation = generation or str(uuid.uuid4())
        by_name = {t.name: t for t in bundle.types}
        pinned = stored.version() if stored else 0
        if stored and pinned:
            made_by_hand, linked_by_hand = stored.manual(pinned), stored.relation_edits(pinned)
            manual = made_by_hand if manual is None else manual.unionByName(made_by_hand).dropDuplicates(["type", "key"])
            relation_edits = linked_by_hand if relation_edits is None else relation_edits.unionByName(linked_by_hand)
        made = reduce(
            DataFrame.unionByName,
            [objects(tables[t.dataset], t, generation, versions.get(t.dataset)) for t in bundle.types],
        )
        if manual is not None:
            made = edits.with_manual_objects(made, manual, list(by_name), generation)
        if bundle.relationships:
            linked = reduce(
                DataFrame.unionByName,
                [
                    relations(
                        tables[by_name[r.from_type].dataset],
                        tables[by_name[r.to_type].dataset],
                        by_name[r.from_type],
                        by_name[r.to_type],
                        r,
                        generation,
                    )
                    for r in bundle.relationships
                ],
            )
        else:
            linked = local_frame(self.spark, [], RELATION)

        def write_objects() -> None:
            self._write("objects", made, generation, ["type", "id"])

        def write_relations(linked: DataFrame) -> None:
            self._write("relations", linked, generation, ["from_id", "to_id"])
            self._write("relations_to", self.relations(generation), generation, ["to_id", "from_id"])

        if relation_edits is None:
            together([write_objects, lambda: write_relations(linked)])
        else:
            # Edited relations are checked against the objects as written.
            write_objects()
            write_relations(edits.with_relation_edits(linked, relation_edits, self.objects(generation), generation))
        row = {
            "seq": (current["seq"] if current else 0) + 1,
            "generation": generation,
            "previous": current["generation"] if current else None,
            "bundle_hash": bundle_hash(bundle),
            "actor": actor,
            "types": list(by_name),
            "edits_version": pinned,
            "published_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        }
        shown = {"dashboards": [dataclasses.asdict(d) for d in bundle.dashboards]}

        def decide() -> list[Fact]:
            if self.pointer() != current:
                raise PublicationRefused("Published definitions changed. Revalidate these definitions.")
            return [("pointer", "active", row), ("publication", generation, row), ("dashboards", generation, shown)]

        self.log.update(decide)
        return generation

    def _write(self, name: str, df: DataFrame, generation: str, order: Sequence[str]) -> None:
        path = f"{self.root}/{name}/generation={generation}"
        ranged = df.drop("generation").repartitionByRange(*order).sortWithinPartitions(*order)
        # A generation is new, so an overwrite only replaces a failed attempt of itself.
        ranged.write.mode("overwrite").parquet(path)

    def records(self, stored: EditStore) -> DataFrame:
        """The active generation's records with all edits there are by now, and with the objects
        people created since it was published."""
        from . import edits

        row = self.pointer()
        since = stored.manual(since=row["edits_version"])
        objects = edits.with_manual_objects(self.objects(row["generation"]), since, row["types"], row["generation"])
        return edits.effective_records(objects, stored.overlays())

    def links(self, stored: EditStore) -> DataFrame:
        """The active generation's relations after the links and unlinks since it was published."""
        from . import edits

        row = self.pointer()
        since = stored.relation_edits(since=row["edits_version"])
        created = stored.manual(since=row["edits_version"])
        objects = edits.with_manual_objects(self.objects(row["generation"]), created, row["types"], row["generation"])
        return edits.with_relation_edits(self.relations(row["generation"]), since, objects, row["generation"])

    def rollback(self, bundles: Mapping[str, Bundle], tables: Mapping[str, DataFrame], validate, **how) -> str:
        """Publish the previous generation's definitions again, on today's inputs, after
        ``validate(bundle)`` finds nothing wrong with them. ``bundles`` are by hash."""
        current = self.pointer()
        if not current or not current["previous"]:
            raise PublicationRefused("No previous publication")
        old = self.log.get("publication", current["previous"])
        bundle = bundles.get(old["bundle_hash"]) if old else None
        if bundle is None:
            raise PublicationRefused("Previous definitions unavailable")
        if not all(c.passed for c in validate(bundle)):
            raise PublicationRefused("Previous definitions no longer validate against current inputs")
        return self.publish(bundle, tables, base=current["generation"], **how)


def bundle_hash(bundle: Bundle) -> str:
    return digest(repr(bundle))


# Labels.

# Which value names a record, the likelier first.
FIRST_NAME, LAST_NAME = r"(?i)(^|_)first_?name$", r"(?i)(^|_)last_?name$"
NAMED = [
    r"(?i)^(name|full_?name|display_?name|title|subject|company(_?name)?)$",
    r"(?i)(^|_)(name|title)$",
    r"(?i)^e-?mail$",
]


def record_label(type_name: Column, key: Column, values: Column, names: Sequence[str], longest: int = 80) -> Column:
    """A readable name: a person's, else a name or title, else the record's own email (of those
    the first ``longest`` characters), else its type and a shortened key. ``values`` is a map;
    ``names`` its possible keys, in the order the type lists them."""
    def filled(name: str) -> Column:
        value = F.try_element_at(values, F.lit(name))
        return F.when(value.isNotNull() & ~F.trim(value).isin(BLANKS), value)

    def first(rule: str) -> Column:
        found = [filled(n) for n in names if re.search(rule, n)]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    given, family = first(FIRST_NAME), first(LAST_NAME)
    person = F.when(given.isNotNull() | family.isNotNull(), F.concat_ws(" ", given, family))
    named = F.substring(F.coalesce(*[first(rule) for rule in NAMED]), 1, longest)
    short = F.when(F.length(key) > 14, F.concat(F.substring(key, 1, 12), F.lit("…"))).otherwise(key)
    return F.coalesce(person, named, F.concat_ws(" ", type_name, short))


def with_labels(objects: DataFrame, types: Sequence[TypeDef], values: str = "base") -> DataFrame:
    """Objects with their label; each type's property names are read in their own order."""
    label = F.lit(None).cast("string")
    for t in types:
        found = record_label(F.col("type"), F.col("key"), F.col(values), t.properties)
        label = F.when(F.col("type") == t.name, found).otherwise(label)
    return objects.withColumn("label", label)
