"""Files in, files out: scans with inference, landed rows, listings, exports."""

from __future__ import annotations

import json
import re
from functools import reduce
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds
from ..functions.local import local_frame
from ..functions.text import field

# File kinds a folder listing offers for import.
LISTED = r"(?i)\.(csv|json|jsonl|parquet)$"


def scan(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: Sequence[Mapping[str, str]] | T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read one dataset by its file kind. Give ``schema`` where it is known: inference
    reads CSV and JSON twice. Spark splits large CSV files unless a quoted value holds a line
    break, which a pass over the plain lines finds out; ``multi_line`` answers it beforehand."""
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    known = schema if schema is None or isinstance(schema, T.StructType) else declared(schema)
    reader = spark.read if known is None else spark.read.schema(known)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        multi_line = _breaks_lines(spark, path) if multi_line is None else multi_line
        reader = reader.options(header=True, escape='"', multiLine=multi_line)
        if known is None:
            reader = reader.schema(_widened(_inferred_csv(spark, path, multi_line)))
        return reader.csv(path)
    if kind not in ("json", "jsonl", "ndjson"):
        raise ValueError(f"Unknown file kind {kind}")
    df = reader.option("multiLine", kind == "json").json(path)
    return df if known is not None else with_times(df)


def _breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value holds a line break: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _inferred_csv(spark: SparkSession, path: str, multi_line: bool) -> T.StructType:
    """The schema Spark infers; times without a zone stay without one."""
    session = spark.newSession()
    session.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    reader = session.read.options(header=True, escape='"', multiLine=multi_line, inferSchema=True)
    return reader.csv(path).schema


def _widened(schema: T.StructType) -> T.StructType:
    """Whole numbers are BIGINT, however small those seen were."""
    wide = lambda kind: T.LongType() if isinstance(kind, T.IntegerType) else kind
    return T.StructType([T.StructField(f.name, wide(f.dataType)) for f in schema.fields])


# How JSON texts write dates and times, and the type each one is read as.
TIMES = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$",
}


FIRST_ROWS = 100


def _time_tests(df: DataFrame) -> list[tuple[str, str]]:
    """Text columns, and the kinds of times that each may hold."""
    broken = df.sparkSession.conf.get("spark.sql.columnNameOfCorruptRecord", "_corrupt_record")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != broken]
    return [(name, kind) for name in texts for kind in TIMES]


def _held(tests: Sequence[tuple[str, str]]) -> list[Column]:
    """Whether every value of a column is a time of a kind, test by test; null without values."""
    return [
        F.bool_and(F.when(field(name).isNotNull(), field(name).rlike(TIMES[kind]) & field(name).try_cast(kind).isNotNull())).alias(str(n))
        for n, (name, kind) in enumerate(tests)
    ]


def with_times(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a date or time, as one; JSON has no such types.

    All rows decide, in one aggregate. What the first rows already rule out is not asked of
    the others, which leaves the columns that do hold times, each with its own rule.
    """
    open_tests = _time_tests(df)
    for rows in (df.limit(FIRST_ROWS), df):
        if not open_tests:
            return df
        found = rows.agg(*_held(open_tests)).first()
        # A column without values so far is still open.
        passed = (True,) if rows is df else (True, None)
        open_tests = [test for n, test in enumerate(open_tests) if found[str(n)] in passed]
    return df.withColumns({name: field(name).cast(kind) for name, kind in open_tests}) if open_tests else df


def land_json_lines(spark: SparkSession, path: str, target: str) -> DataFrame:
    """JSON lines as Parquet of the types that :func:`scan` gives them.

    Inference reads the lines once. They are parsed once more, as they are written: the first rows
    suggest which texts are times, and the same pass finds out whether all rows agree. Only if
    they do not are the lines written again.
    """
    df = spark.read.json(path)
    tests = _time_tests(df)
    first = df.limit(FIRST_ROWS).agg(*_held(tests)).first() if tests else {}
    open_tests = [test for n, test in enumerate(tests) if first[str(n)] is not False]
    suggested = {name: kind for n, (name, kind) in enumerate(tests) if first[str(n)]}

    def write(rows: DataFrame, times: Mapping[str, str]) -> None:
        rows.withColumns({n: field(n).try_cast(kind) for n, kind in times.items()}).write.mode("overwrite").parquet(target)

    if open_tests:
        watched = Observation()
        write(df.observe(watched, *_held(open_tests)), suggested)
        found = watched.get
        times = {name: kind for n, (name, kind) in enumerate(open_tests) if found[str(n)]}
        if times != suggested:
            write(df, times)
    else:
        write(df, {})
    return spark.read.parquet(target)


def declared(columns: Sequence[Mapping[str, str]]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(c["name"], kinds.DECLARED_TYPES.get(c["type"].lower(), T.StringType()))
            for c in columns
        ]
    )


def scan_or_empty(spark: SparkSession, path: str, format: str, columns: Sequence[Mapping[str, str]]) -> DataFrame:
    """The scan, or an empty table of the declared columns when the files hold no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    if size == 0 and columns:
        return spark.createDataFrame([], declared(columns))
    return scan(spark, path, format)


def land_rows(spark: SparkSession, rows: Iterable[Mapping], path: str) -> DataFrame:
    """Land the objects of one request, so that they are inferred like any other import."""
    lines = [(json.dumps(r, ensure_ascii=False, default=str),) for r in rows]
    if not lines:
        raise ValueError("Provide at least one row")
    return land_json(local_frame(spark, lines, "value string"), path)


def land_json(lines: DataFrame, path: str) -> DataFrame:
    """Write JSON text, one object per row, and read it with inference."""
    lines.write.mode("overwrite").text(path)
    return scan(lines.sparkSession, path, "jsonl")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Importable files under a folder. Reads names and sizes, never contents."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .where(F.col("path").rlike(LISTED))
        .select(F.col("path").alias("name"), F.col("length").alias("size"))
    )


def export(df: DataFrame, path: str, format: str = "parquet", records_per_file: int = 0) -> None:
    """Write the rows to a target outside the snapshot folder; 0 sets no limit to a file."""
    writer = df.write.mode("errorifexists")
    if format == "parquet":
        writer.option("compression", "zstd").option("maxRecordsPerFile", records_per_file).parquet(path)
    elif format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif format in ("json", "jsonl"):
        writer.json(path)
    else:
        raise ValueError(f"Unknown export kind {format}")


class ExportFailed(RuntimeError):
    pass


DIGESTED_BYTES = 256 << 20


def _records_to_digest(df: DataFrame, rows: int) -> int:
    """Rows per file, so that a file is small enough for one task to digest whole."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1000, min(5_000_000, DIGESTED_BYTES * rows // max(size, 1)))


def verified_export(tables: Mapping[str, DataFrame], expected: Mapping[str, int], path: str) -> DataFrame:
    """Copies tables to ZSTD Parquet; returns name, rows, file, bytes and SHA-256 of each file.

    Every copy is proved at once: the tables asked for, their rows, and the rows read back
    must be the same counts. Digests are computed where the files are read.
    """
    unfit = [name for name in tables if not re.fullmatch(r"[a-z][a-z0-9_]*", name)]
    if unfit:
        raise ExportFailed(f"Not a table name: {', '.join(unfit)}")
    counts = {name: df.count() for name, df in tables.items()}
    _same_counts("source", dict(expected), counts)
    places = {name: f"{path}/tables/{name}.parquet" for name in tables}
    for name, df in tables.items():
        export(df, places[name], records_per_file=_records_to_digest(df, counts[name]))
    read = {name: df.sparkSession.read for name, df in tables.items()}
    _same_counts("copy", counts, {name: read[name].parquet(places[name]).count() for name in tables})
    manifests = [
        read[name].format("binaryFile").option("pathGlobFilter", "*.parquet").load(place).select(
            F.lit(name).alias("name"),
            F.lit(counts[name]).cast("bigint").alias("rows"),
            F.element_at(F.split("path", "/"), -1).alias("file"),
            F.col("length").alias("bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
        for name, place in places.items()
    ]
    return reduce(DataFrame.unionByName, manifests)


def _same_counts(what: str, wanted: Mapping[str, int], got: Mapping[str, int]) -> None:
    differing = sorted(n for n in {*wanted, *got} if wanted.get(n) != got.get(n))
    if differing:
        raise ExportFailed(f"Rows of the {what} differ for " + ", ".join(differing))
