"""Reading the record graph: the best-connected records, neighbourhoods, lists, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.local import at_least
from ..functions.text import BLANKS
from ..plans.ordered import Key, page_of
from ..session import cut
from .objects import link_counts

# A set of records that a caller limits to this many may be broadcast; others are left to
# size-based planning.
BROADCAST_RECORDS = 10_000


def _few(kept: DataFrame, limit: int | None) -> DataFrame:
    return F.broadcast(kept) if limit is not None and limit <= BROADCAST_RECORDS else kept


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(at_least("limit", limit, 1))


def existing(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """Relations whose two records exist."""
    ids = objects.select("id")
    return relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(
        ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"
    )


def _edges_between(relations: DataFrame, kept: DataFrame, limit: int | None) -> DataFrame:
    """Relations inside a set of records."""
    ids = kept.select("id")
    inside = relations.join(_few(ids.withColumnRenamed("id", "from_id"), limit), "from_id", "left_semi")
    inside = inside.join(_few(ids.withColumnRenamed("id", "to_id"), limit), "to_id", "left_semi")
    return inside.select("from_id", "to_id", "name")


def top_graph(
    objects: DataFrame, relations: DataFrame, limit: int | None = None, published: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` best-connected records (all without one) and the relations among them.

    Relations of a ``published`` generation have both their records, so they need no check.
    """
    degree = link_counts(relations if published else existing(relations, objects))
    # Only ids are ranked; the records themselves join the few that are kept. The nodes and
    # both ends of the edges read the ranking, so it is settled once.
    top = objects.select("id").join(degree, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("degree"))
    if limit is not None:
        top = _limited(top.orderBy(F.col("degree").desc(), "id"), limit)
    top = cut(top)
    return objects.join(_few(top, limit), "id"), _edges_between(relations, top, limit)


def _next_to(relations: DataFrame, ids: DataFrame, limit: int | None) -> DataFrame:
    """Records one relation away from a set, whichever way the relation points."""
    near = _few(ids.select("id"), limit)
    out = relations.join(near, F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id"))
    into = relations.join(near, F.col("to_id") == F.col("id"), "left_semi").select(F.col("from_id").alias("id"))
    return out.unionByName(into).distinct()


def k_hop(relations: DataFrame, focus: str, depth: int = 1, limit: int | None = None) -> DataFrame:
    """All records within ``depth`` relations of one; with a ``limit``, the nearest so many.

    Steps are cut, so a later one does not repeat an earlier one, and end where nothing new
    is reached. A limit is met by whole hops first, then by id within the last one.
    """
    at_least("depth", depth, 1)
    spark = relations.sparkSession
    seen = spark.range(1).select(F.lit(focus).alias("id"), F.lit(0).alias("hops"))
    frontier, found = seen, 1
    for hop in range(1, depth + 1):
        if limit is not None and found >= at_least("limit", limit, 1):
            break
        reached = _next_to(relations, frontier, limit).join(_few(seen, limit), "id", "left_anti")
        if limit is not None:
            reached = reached.orderBy("id").limit(limit - found)
        frontier = cut(reached.withColumn("hops", F.lit(hop)))
        new = frontier.count()
        if not new:
            break
        found += new
        seen = seen.unionByName(frontier)
    return seen


def neighborhood(
    objects: DataFrame, relations: DataFrame, focus: str, depth: int = 1, limit: int | None = None, published: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The records around one, and the relations among them."""
    real = relations if published else existing(relations, objects)
    reached = k_hop(real, focus, depth, limit)
    return objects.join(_few(reached, limit), "id"), _edges_between(relations, reached, limit)


def neighbors(relations: DataFrame, ids: DataFrame, incoming: DataFrame | None = None) -> DataFrame:
    """Distinct neighbours of each given record, ``(id, neighbor)``, in both directions.

    ``incoming`` are the same relations in a second copy, such as :meth:`Graph.relations_to`, whose
    files are in the order of their ends.
    """
    if incoming is not None:
        out = relations.select(F.col("from_id").alias("id"), F.col("to_id").alias("neighbor"))
        into = incoming.select(F.col("to_id").alias("id"), F.col("from_id").alias("neighbor"))
        near = [side.join(ids.select("id"), "id", "left_semi") for side in (out, into)]
        return near[0].unionByName(near[1]).distinct()
    both = relations.select(
        F.inline(
            F.array(
                F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("neighbor")),
                F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("neighbor")),
            )
        )
    )
    return both.join(ids.select("id"), "id", "left_semi").distinct()


def _blank(value: Column) -> Column:
    return value.isNull() | value.isin(BLANKS)


def _natural(text: Column) -> Column:
    """Text that sorts digits by their number: runs of digits padded to one width."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{19})", "$1")


def sort_keys(value: Column, label: Column, descending: bool = False, by_label: bool = False) -> list[Key]:
    """A total order of records: blanks last, numbers by value, then natural text, then the
    label and the id."""
    if by_label:
        return [Key(_natural(label), descending), Key(label, descending), Key(F.col("id"))]
    number = F.when(F.trim(value) != "", value.try_cast("double"))
    ordered = [Key(c, descending) for c in (number.isNull().cast("int"), number, _natural(value), value)]
    return [Key(_blank(value).cast("int")), *ordered, Key(_natural(label)), Key(label), Key(F.col("id"))]


def search(records: DataFrame, text: str | None, values: str = "effective") -> DataFrame:
    """Records whose name, description or values contain a text, ignoring case."""
    if not text:
        return records
    parts = [F.col("name"), F.to_json(F.col(values), {"ignoreNullFields": "false"})]
    if "description" in records.columns:
        parts.append(F.col("description"))
    return records.where(F.lower(F.concat_ws("\n", *parts)).contains(text.lower()))


def narrow(records: DataFrame, type_name: str | None = None, field: str | None = None, value=None, values: str = "effective") -> DataFrame:
    """Records of a type, and of one exact field value."""
    if type_name:
        records = records.where(F.col("type") == type_name)
    if field is not None and value is not None:
        found = F.try_element_at(F.col(values), F.lit(field))
        records = records.where(F.map_contains_key(values, F.lit(field)) & (found == F.lit(str(value))))
    return records


def list_records(
    records: DataFrame,
    links: DataFrame | None = None,
    text: str | None = None,
    type_name: str | None = None,
    field: str | None = None,
    value=None,
    sort: str | None = None,
    descending: bool = False,
    offset: int = 0,
    limit: int = 100,
    values: str = "effective",
) -> tuple[DataFrame, int]:
    """One page of records and how many there are in all.

    ``sort`` is ``record`` (the label), ``links`` or a field. Records carry ``label``.
    """
    found = narrow(search(records, text, values), type_name, field, value, values)
    total = found.count()
    if links is not None:
        found = found.join(links, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    by_label = sort in (None, "", "record")
    key = F.col("links").cast("string") if sort == "links" else F.try_element_at(F.col(values), F.lit(sort or ""))
    order = sort_keys(key, F.col("label"), descending and sort is not None, by_label)
    page = page_of(found, order, at_least("offset", offset, 0), at_least("limit", limit, 1))
    return page, total


# So many ids may stand in a filter, which prunes files; more of them are joined.
FILTERED_IDS = 1000


def record_detail(
    records: DataFrame,
    relations: DataFrame,
    audit: DataFrame,
    object_id: str,
    history_limit: int | None = None,
    incoming: DataFrame | None = None,
    related_limit: int | None = None,
) -> dict[str, DataFrame]:
    """One record, the records related to it (all, or the ``related_limit`` first by id), and the
    audit entries that name it, newest first: all, or the last ``history_limit``.

    ``audit(id, name, object_id, logical_id, from_logical_id, to_logical_id, created_at)``.
    ``incoming`` are the relations once more, by the record they lead to: each copy is then read
    by the end it is ordered by, which leaves a few files of each.
    """
    record = records.where(F.col("id") == object_id)
    logical = object_id.split("_", 1)[1]
    starts, ends = F.col("from_id") == object_id, F.col("to_id") == object_id
    if incoming is None:
        touching = relations.where(starts | ends)
        near = touching.select(F.when(starts, F.col("to_id")).otherwise(F.col("from_id")).alias("id"))
    else:
        near = relations.where(starts).select(F.col("to_id").alias("id"))
        near = near.unionByName(incoming.where(ends).select(F.col("from_id").alias("id")))
    if related_limit is None or related_limit > FILTERED_IDS:
        related = _limited(records.join(near, "id", "left_semi"), related_limit)
    else:
        first = [r["id"] for r in near.distinct().orderBy("id").limit(at_least("related_limit", related_limit, 1)).collect()]
        related = records.where(F.col("id").isin(first) if first else F.lit(False))
    named = (F.col("object_id") == object_id) | F.col("object_id").endswith("_" + logical)
    for column in ("logical_id", "from_logical_id", "to_logical_id"):
        if column in audit.columns:
            named = named | F.coalesce(F.col(column) == logical, F.lit(False))
    history = _limited(audit.where(named).orderBy(F.col("created_at").desc(), "id"), history_limit)
    return {"record": record, "related": related, "history": history}
