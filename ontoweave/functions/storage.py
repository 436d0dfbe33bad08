"""Small files in the folders that a session shares, through Hadoop's file systems.

A commit needs one thing that DataFrame writers do not give: a file that is there whole or not
at all, and that only one of several writers can create. A rename that refuses to overwrite is
that on HDFS and on the object stores whose connectors support it.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, or None where there is none."""
    files, place = _located(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(files, place, text: str) -> None:
    out = files.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with all of its text; False where another writer was first."""
    files, place = _located(spark, path)
    if files.exists(place):
        return False
    draft = place.suffix(f".{uuid.uuid4().hex}.tmp")
    _write(files, draft, text)
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    keep_existing = context._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        target = hadoop.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration())
        target.rename(files.makeQualified(draft), files.makeQualified(place), keep_existing)
        return True
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write the file anew. A reader may find the old text, the new one or, for a moment, none."""
    _write(*_located(spark, path), text)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _located(spark, path)
    files.delete(place, True)
