"""Database tables and catalogs over JDBC.

A table is read by parallel range partitions of one integer column. Each partition is its
own connection, so only a single partition (or a predicate that pins a moment) gives the
rows of one transaction; ``consistent=True`` asks for that.
"""

from __future__ import annotations

from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column types read as text so that no digit or zone is lost.
AS_TEXT = {
    "mysql": ["bigint", "decimal", "date", "datetime", "timestamp", "time"],
    "postgres": ["bigint", "numeric", "decimal"],
}


@dataclass(frozen=True)
class Connection:
    url: str
    kind: str
    options: dict[str, str] = default(default_factory=dict)


def custom_schema(kind: str, columns: list[tuple[str, str]]) -> str:
    """Spark column types for a table's ``(name, database type)`` columns that must stay
    exact; the others keep the driver's types."""
    exact = AS_TEXT.get(kind, [])
    return ", ".join(
        f"`{name}` STRING"
        for name, type_name in columns
        if type_name.lower().split("(")[0].split()[0] in exact
    )


def read_options(
    table: str,
    fetch_size: int = 10_000,
    schema: str = "",
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    consistent: bool = False,
) -> dict[str, str]:
    options = {"dbtable": table, "fetchsize": str(fetch_size)}
    if schema:
        options["customSchema"] = schema
    if partition_column and not consistent and partitions > 1:
        if bounds is None:
            raise ValueError("Give the bounds of the partition column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, connection: Connection, table: str, **how) -> DataFrame:
    options = connection.options | read_options(table, **how)
    return spark.read.format("jdbc").option("url", connection.url).options(**options).load()


def column_bounds(spark: SparkSession, connection: Connection, table: str, column: str) -> tuple[int, int] | None:
    """The least and greatest value, found by the database, to size range partitions."""
    text = f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {table}) bounds"
    row = read_table(spark, connection, text).first()
    return None if row is None or row[0] is None else (int(row[0]), int(row[1]))


# Catalog views, as subqueries the database answers.
CATALOG = {
    "mysql": {
        "tables": "SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS name, TABLE_ROWS AS estimated_rows "
        "FROM information_schema.TABLES WHERE TABLE_TYPE = 'BASE TABLE' AND TABLE_SCHEMA = DATABASE()",
        "columns": "SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS table_name, COLUMN_NAME AS name, "
        "COLUMN_TYPE AS type, IS_NULLABLE AS nullable FROM information_schema.COLUMNS "
        "WHERE TABLE_SCHEMA = DATABASE()",
        "foreign_keys": "SELECT TABLE_NAME AS table_name, COLUMN_NAME AS column_name, "
        "REFERENCED_TABLE_NAME AS referenced_table, REFERENCED_COLUMN_NAME AS referenced_column "
        "FROM information_schema.KEY_COLUMN_USAGE WHERE TABLE_SCHEMA = DATABASE() "
        "AND REFERENCED_TABLE_NAME IS NOT NULL",
    },
    "postgres": {
        "tables": "SELECT table_schema, table_name AS name, CAST(NULL AS bigint) AS estimated_rows "
        "FROM information_schema.tables WHERE table_type = 'BASE TABLE' "
        "AND table_schema NOT IN ('pg_catalog', 'information_schema')",
        "columns": "SELECT table_schema, table_name, column_name AS name, data_type AS type, "
        "is_nullable AS nullable FROM information_schema.columns "
        "WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
        "foreign_keys": "SELECT fk.table_name, fk.column_name, pk.table_name AS referenced_table, "
        "pk.column_name AS referenced_column FROM information_schema.referential_constraints rc "
        "JOIN information_schema.key_column_usage fk ON fk.constraint_name = rc.constraint_name "
        "AND fk.constraint_schema = rc.constraint_schema "
        "JOIN information_schema.key_column_usage pk ON pk.constraint_name = rc.unique_constraint_name "
        "AND pk.constraint_schema = rc.unique_constraint_schema "
        "AND pk.ordinal_position = fk.position_in_unique_constraint",
    },
}


def discover(spark: SparkSession, connection: Connection) -> dict[str, DataFrame]:
    """Tables, columns and foreign keys of a database, as DataFrames."""
    texts = CATALOG[connection.kind]
    return {
        name: read_table(spark, connection, f"({text}) {name}") for name, text in texts.items()
    }


def declared_edges(foreign_keys: DataFrame, system: str) -> DataFrame:
    """Foreign keys of one system in the shape :func:`keys.declared_keys` reads."""
    columns = ["table_name", "column_name", "referenced_table", "referenced_column"]
    return foreign_keys.select(F.lit(system).alias("system"), *columns).distinct()
