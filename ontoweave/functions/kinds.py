"""What a column's type lets it be: a time, a number, a category, a key."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.BinaryType: "BLOB",
    T.VariantType: "JSON",
}

# SQL type names users write, and the Spark type each one means.
SQL_TYPES = {
    "varchar": "string",
    "text": "string",
    "uuid": "string",
    "hugeint": "decimal(38,0)",
    "ubigint": "decimal(20,0)",
    "uinteger": "bigint",
    "usmallint": "int",
    "utinyint": "smallint",
    "integer": "int",
    "real": "float",
    "timestamp": "timestamp_ntz",
    "datetime": "timestamp_ntz",
    "timestamptz": "timestamp",
    "timestamp with time zone": "timestamp",
    "blob": "binary",
    "bool": "boolean",
    "numeric": "decimal(18,3)",
    "decimal": "decimal(18,3)",
}

# Declared source types of an import that brought no rows.
DECLARED_TYPES = {
    "int": T.LongType(),
    "integer": T.LongType(),
    "bigint": T.StringType(),
    "smallint": T.IntegerType(),
    "tinyint": T.IntegerType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
}


def sql_name(kind: T.DataType) -> str:
    """The type's SQL name, as profiles and schema comparisons show it."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return sql_name(kind.elementType) + "[]"
    if isinstance(kind, T.MapType):
        return f"MAP({sql_name(kind.keyType)}, {sql_name(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {sql_name(f.dataType)}" for f in kind.fields) + ")"
    return _NAMES.get(type(kind), kind.simpleString().upper())


def spark_type(name: str) -> str:
    """The Spark type for a SQL type name; names Spark knows pass through."""
    cleaned = " ".join(name.lower().split())
    if cleaned.startswith(("numeric(", "decimal(")):
        return "decimal" + cleaned[cleaned.index("("):]
    if cleaned.startswith(("varchar(", "char(")):
        return "string"
    return SQL_TYPES.get(cleaned, cleaned)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType))


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_key_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType) or is_integer(kind)


def text_fields(kind: T.DataType) -> list[str]:
    """Names of a struct's direct text fields."""
    if not isinstance(kind, T.StructType):
        return []
    return [f.name for f in kind.fields if isinstance(f.dataType, T.StringType)]
