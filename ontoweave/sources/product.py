"""Product-analytics objects: persons, groups, events with JSON properties."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import field

# Properties that become columns of their own.
PROMOTED = {
    "persons": {"email": "email", "name": "name"},
    "groups": {"name": "name"},
    "events": {"session_id": "$session_id", "current_url": "$current_url"},
}
# Declared links as (table, column, referenced table, referenced column).
LINKS = [
    ("person_distinct_ids", "person_id", "persons", "person_id"),
    ("events", "person_id", "persons", "person_id"),
    ("events", "distinct_id", "person_distinct_ids", "distinct_id"),
    ("daily_event_counts", "person_id", "persons", "person_id"),
]


def relationships() -> list[tuple[str, str, str, str]]:
    return list(LINKS)


def properties(text: Column) -> Column:
    """Properties as a map of texts; text that is not a JSON object is an empty map."""
    parsed = F.from_json(text, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def promote(df: DataFrame, column: str, chosen: Mapping[str, str]) -> DataFrame:
    """Parse a properties column and lift chosen properties to columns."""
    parsed = df.withColumn(column, properties(field(column)))
    return parsed.withColumns({name: field(column)[key] for name, key in chosen.items()})


def normalize(df: DataFrame, object_name: str) -> DataFrame:
    return promote(df, "properties", PROMOTED[object_name])


def with_group_types(groups: DataFrame, types: Mapping[int, str]) -> DataFrame:
    """Name each group's type by its index. A project has a handful of group types, so
    they are a literal map inside the plan."""
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair]) if types else None
    numbered = F.concat(F.lit("group_"), field("index").cast("string"))
    named = F.coalesce(F.try_element_at(names, field("index")), numbered) if types else numbered
    return groups.withColumn("group_type", named).withColumnRenamed("key", "group_key").drop("index")


def daily_event_counts(events: DataFrame, time: str, event: str, person: str) -> DataFrame:
    """Events per UTC day, event and person; partial counts combine before the shuffle."""
    return events.groupBy(
        F.to_date(field(time)).alias("day"), field(event).alias("event"), field(person).alias("person_id")
    ).agg(F.count(F.lit(1)).alias("events"))
