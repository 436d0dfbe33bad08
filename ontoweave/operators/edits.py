"""Edits people make, kept apart from generations and applied to every new one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .entities import TypeDef
from .objects import base_values, object_id, type_id

OVERLAY = "logical_id string, values map<string,string>, revision bigint"
EDIT = (
    "edit_id string, logical_id string, values map<string,string>, revision bigint, "
    "idempotency_key string, revert boolean, actor string, submitted_at timestamp"
)
MANUAL = "type string, key string, values map<string,string>"
RELATION_EDIT = "from_logical_id string, to_logical_id string, name string, enabled boolean"


def overlaid(base: Column, values: Column) -> Column:
    """A map with another's entries in place of its own; an edited null stays."""
    empty = F.expr("CAST(map() AS map<string,string>)")
    edits = F.coalesce(values, empty)
    kept = F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.map_contains_key(edits, k))
    return F.map_concat(kept, edits)


def effective_records(objects: DataFrame, overlays: DataFrame) -> DataFrame:
    """Objects with their edits applied."""
    return objects.join(
        overlays.select("logical_id", F.col("values").alias("edits"), "revision"), "logical_id", "left"
    ).withColumns(
        {
            "effective": overlaid(F.col("base"), F.col("edits")),
            "revision": F.coalesce("revision", F.lit(0)),
        }
    )


def _named_in(df: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of a large table that a small one names. A semi join may broadcast the small
    side, so that the large one is read and never shuffled; joins that keep unmatched rows of
    the small side come after it."""
    return df.join(few.select(*on).distinct(), list(on), "left_semi")


def preview_edits(objects: DataFrame, overlays: DataFrame, edits: DataFrame) -> DataFrame:
    """What each edit would change: the record before and after."""
    named = (_named_in(df, edits, ["logical_id"]) for df in (objects, overlays))
    current = effective_records(*named).select("logical_id", F.col("effective").alias("before"), "revision")
    return edits.select("logical_id", "values").join(current, "logical_id").select(
        "logical_id", "before", overlaid(F.col("before"), F.col("values")).alias("after"), "revision"
    )


def request_hash() -> Column:
    """What an edit asks for, whoever sends it and under whichever key."""
    asked = [
        F.col("logical_id"),
        F.to_json(F.array_sort(F.map_entries("values"))),
        F.col("revision").cast("string"),
        F.col("revert").cast("string"),
    ]
    return F.sha2(F.concat_ws("|", *[F.coalesce(a, F.lit("-")) for a in asked]), 256)


def value_kinds(df: DataFrame) -> dict[str, str]:
    """What each property of a type's table holds: number, boolean or text."""
    return {
        f.name: "number"
        if isinstance(f.dataType, T.NumericType)
        else "boolean"
        if isinstance(f.dataType, T.BooleanType)
        else "text"
        for f in df.schema.fields
    }


def _literal_map(pairs: Mapping[str, str]) -> Column:
    flat = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.create_map(*flat) if flat else F.expr("CAST(map() AS map<string,string>)")


def _fits(value: Column, old: Column, kind: Column) -> Column:
    """A null fits anything, and anything replaces a null; a number stays a number."""
    number = value.try_cast("double").isNotNull()
    boolean = F.lower(value).isin("true", "false")
    wrong = (kind.eqNullSafe("number") & ~number) | (kind.eqNullSafe("boolean") & ~boolean)
    return value.isNull() | old.isNull() | ~wrong


def with_first_uses(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests (with ``edit_id``, ``idempotency_key``, ``submitted_at``, ``request_hash``) and two
    flags: ``repeated``, the same was asked under this key before, and ``misused``, something
    else was. ``done(idempotency_key, request_hash)`` are requests already applied.

    Firsts are minima, so a key with most of the requests needs no big group.
    """
    first_of_key = requests.groupBy("idempotency_key").agg(F.min_by(F.struct("edit_id", "request_hash"), _order()).alias("first"))
    seen = done.select("idempotency_key", F.col("request_hash").alias("done_hash"))
    joined = requests.join(first_of_key, "idempotency_key").join(
        _named_in(seen, requests, ["idempotency_key"]), "idempotency_key", "left"
    )
    stated = F.coalesce("done_hash", "first.request_hash")
    again = F.col("done_hash").isNotNull() | (F.col("edit_id") != F.col("first.edit_id"))
    same = F.col("request_hash") == stated
    return joined.withColumns({"repeated": again & same, "misused": ~same}).drop("first", "done_hash")


MISUSED = "Idempotency key reused for different action"


def _order() -> Column:
    return F.struct("submitted_at", "edit_id")


def first_fine(judged: DataFrame, about: Sequence[str], late: str) -> tuple[DataFrame, DataFrame]:
    """Of the requests without a ``reason`` the first about each thing; all others are refused,
    ``(edit_id, <about>, reason)``, the later ones with ``late``."""
    fine = judged.where(F.col("reason").isNull())
    winners = fine.groupBy(*about).agg(F.min_by(F.struct(*fine.columns), _order()).alias("w")).select("w.*")
    shown = ["edit_id", *about, "reason"]
    behind = fine.join(winners.select("edit_id"), "edit_id", "left_anti").withColumn("reason", F.lit(late))
    return winners, judged.where(F.col("reason").isNotNull()).select(*shown).unionByName(behind.select(*shown))


CHANGED = "Object was edited; refresh the preview"


def judge_edits(
    objects: DataFrame,
    overlays: DataFrame,
    edits: DataFrame,
    types: Sequence[TypeDef],
    done: DataFrame,
    kinds: Mapping[str, Mapping[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The edits of a batch that apply, one per record with its state before, and the refused
    ones with the reason."""
    allowed = F.lit(None).cast("array<string>")
    kind_of = _literal_map({})
    for t in types:
        here = F.col("type") == t.name
        editable = F.array(*[F.lit(p) for p in t.properties if p != t.key]).cast("array<string>")
        allowed = F.when(here, editable).otherwise(allowed)
        kind_of = F.when(here, _literal_map((kinds or {}).get(t.name, {}))).otherwise(kind_of)
    known = _named_in(objects.select("logical_id", "id", "type", "name", "base"), edits, ["logical_id"])
    current = _named_in(overlays, edits, ["logical_id"]).select(
        "logical_id", F.col("values").alias("old_values"), F.col("revision").alias("old_revision")
    )
    placed = (
        with_first_uses(edits.withColumn("request_hash", request_hash()), done)
        .join(known, "logical_id", "left")
        .join(current, "logical_id", "left")
        .withColumn("allowed", allowed)
        .withColumn("kind_of", kind_of)
    )
    names = F.map_keys("values")
    none = F.array().cast("array<string>")
    unknown = F.size(F.array_except(names, F.coalesce("allowed", none))) > 0
    wrong = F.exists(
        names,
        lambda k: ~_fits(
            F.element_at("values", k), F.try_element_at("base", k), F.try_element_at("kind_of", k)
        ),
    )
    reason = (
        F.when(F.col("misused"), MISUSED)
        .when(F.col("id").isNull(), "Object unavailable")
        .when(unknown, "Invalid editable field")
        .when(wrong, "Invalid type for a field")
        .when(F.col("revision") != F.coalesce("old_revision", F.lit(0)), CHANGED)
    )
    # Written once: all that follows starts from it.
    judged = cut(placed.where(~F.col("repeated")).withColumn("reason", reason))
    return first_fine(judged, ["logical_id"], CHANGED)


def new_overlays(winners: DataFrame) -> DataFrame:
    """The overlays that applied edits leave."""
    empty = F.expr("CAST(map() AS map<string,string>)")
    merged = overlaid(F.col("old_values"), F.col("values"))
    return winners.select(
        "logical_id", F.when(F.col("revert"), empty).otherwise(merged).alias("values"), (F.col("revision") + 1).alias("revision")
    )


def edit_audit(winners: DataFrame) -> DataFrame:
    """An audit row per applied edit."""
    return winners.select(
        F.concat(F.lit("action_"), F.sha2("idempotency_key", 256)).alias("id"),
        F.concat(F.lit("Updated "), "name").alias("name"),
        "actor",
        F.col("id").alias("object_id"),
        "logical_id",
        overlaid(F.col("base"), F.col("old_values")).alias("before"),
        "values",
        "request_hash",
        "idempotency_key",
        F.col("submitted_at").alias("created_at"),
    )


def apply_edits(
    objects: DataFrame,
    overlays: DataFrame,
    edits: DataFrame,
    types: Sequence[TypeDef],
    done: DataFrame,
    kinds: Mapping[str, Mapping[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a batch of edits: new overlays, refused edits with the reason, audit rows.

    ``done(idempotency_key, request_hash)`` are requests already applied: the same one again
    changes nothing, another one under its key is refused. Of several edits on one record
    the first submitted wins and the others find the record changed, as they would one by
    one. ``kinds`` are :func:`value_kinds` by type.
    """
    winners, refused = judge_edits(objects, overlays, edits, types, done, kinds)
    written = new_overlays(winners)
    kept = overlays.join(written.select("logical_id"), "logical_id", "left_anti")
    return kept.unionByName(written), refused, edit_audit(winners)


def manual_from(df: DataFrame, t: TypeDef) -> DataFrame:
    """Objects people create, from rows of the type's properties. A key is required."""
    unknown = [c for c in df.columns if c not in t.properties]
    if unknown:
        raise ValueError("Unknown object property")
    key = F.col(f"`{t.key}`").cast("string")
    return df.where(key.isNotNull() & (F.length(key) > 0)).select(
        F.lit(t.name).alias("type"), key.alias("key"), base_values(df).alias("values")
    )


def with_manual_objects(objects: DataFrame, manual: DataFrame, types: Sequence[str], generation: str) -> DataFrame:
    """Published objects and the created ones whose key no source row has."""
    published = _named_in(objects.select("type", "key"), manual, ["type", "key"])
    kept = manual.where(F.col("type").isin(list(types))).join(published, ["type", "key"], "left_anti")
    return objects.unionByName(_as_objects(kept, types, generation))


def _as_objects(manual: DataFrame, types: Sequence[str], generation: str) -> DataFrame:
    logical = type_ids = F.lit(None).cast("string")
    for name in types:
        here = F.col("type") == name
        logical = F.when(here, object_id(name, F.col("key"))).otherwise(logical)
        type_ids = F.when(here, F.lit(type_id(name))).otherwise(type_ids)
    return manual.select(
        F.concat(F.lit(generation + "_"), logical).alias("id"),
        F.lit(generation).alias("generation"),
        "type",
        type_ids.alias("type_id"),
        "key",
        logical.alias("logical_id"),
        F.concat_ws(" ", "type", "key").alias("name"),
        F.col("values").alias("base"),
        F.lit(None).cast("string").alias("source_version"),
        F.lit(True).alias("manual"),
    )


def with_relation_edits(relations: DataFrame, edits: DataFrame, objects: DataFrame, generation: str) -> DataFrame:
    """Relations after people's links and unlinks: an edited pair follows its edit, and a
    forced link needs both records to exist."""
    placed = edits.select(
        F.lit(generation).alias("generation"),
        "name",
        F.concat(F.lit(generation + "_"), "from_logical_id").alias("from_id"),
        F.concat(F.lit(generation + "_"), "to_logical_id").alias("to_id"),
        "enabled",
    )
    untouched = relations.join(placed, ["name", "from_id", "to_id"], "left_anti")
    ends = placed.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    ids = _named_in(objects.select("id"), ends, ["id"])
    forced = (
        placed.where("enabled")
        .drop("enabled")
        .join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
        .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    )
    columns = ["generation", "name", "from_id", "to_id"]
    return untouched.select(columns).unionByName(forced.select(columns))


def relation_audit(edits: DataFrame, actor: str, at) -> DataFrame:
    """Audit rows for links and unlinks."""
    ends = F.concat_ws(":", "from_logical_id", "to_logical_id", "name")
    return edits.select(
        F.concat(F.lit("action_"), F.sha2(ends, 256)).alias("id"),
        F.concat(F.when(F.col("enabled"), F.lit("Linked ")).otherwise(F.lit("Unlinked ")), "name").alias("name"),
        F.lit(actor).alias("actor"),
        "from_logical_id",
        "to_logical_id",
        (~F.col("enabled")).alias("before"),
        F.col("enabled").alias("after"),
        F.lit(at).alias("created_at"),
    )
