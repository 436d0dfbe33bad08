"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, shared_dir

# Words: maximal runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the place all executors share."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written once to the shared folder and read back from there."""
    path = fresh_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 256


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands at most ``BATCH_ROWS`` rows at once to Python.

    Spark's own bound counts rows only (10,000), which for long texts is tens of megabytes in
    the JVM and again in each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(name, "0"))
    if not 0 < held <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return freed memory to the system. Spark keeps Python workers for later tasks, and what an
    earlier stage needed would otherwise stay with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work over a partition, after which the worker gives back its memory."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their position, from 0, in a total order.

    Range partitions are sorted and written once; a position is the start of the partition
    plus the place in it. The only window without a key sees one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(spread.withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"__part": part, "__inside": inside})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__inside"))
        .drop("__at", "__part", "__inside", "__n", "__start")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``u``, ``v`` (bigint): ``node`` and ``root``, the
    smallest node it reaches, for every node that has an edge.

    Stars are contracted in turn (first every node links its larger neighbours to its
    smallest one, then its smaller neighbours), which takes a number of rounds that grows
    with the logarithm of the longest path. A round is two minima per node, which combine
    before the shuffle, and two joins by node; each round is cut through the shared folder.
    """
    edges = cut(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = edges.distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        smaller = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        pair = F.xxhash64("u", "v").cast("decimal(38,0)")
        seen = edges.agg(F.count(F.lit(1)), F.sum(pair)).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
