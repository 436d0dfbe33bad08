from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from ontoweave.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows of plain values as a DataFrame."""

    def make(rows, schema):
        from ontoweave.functions.local import local_frame

        return local_frame(spark, rows, schema)

    return make


@pytest.fixture
def from_dicts(spark):
    """Rows of JSON-like objects, inferred as an import would infer them."""
    import json

    def make(rows):
        lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
        schema = spark.read.json(lines.rdd.map(lambda r: r[0])).schema
        from pyspark.sql import functions as F

        names = list(dict.fromkeys(k for r in rows for k in r))
        parsed = lines.select(F.from_json("value", schema).alias("v")).select("v.*")
        return parsed.select(*[F.col(f"`{n}`") for n in names])

    return make


def rows(df, *columns):
    """Values of a DataFrame as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
