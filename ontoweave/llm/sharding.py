"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a score for a key from the hash of both, and the lowest score wins. A
shard's score does not depend on the others, so a new shard takes only the records it now
wins and no record moves between old shards. With ``-ln(u) / weight`` as the score a shard
wins in proportion to its weight.

Everything is column expressions: placing a record needs its key alone, so it is a
projection without any shuffle. Only numbering the records of a shard shuffles, by narrow
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "key"


def _score(key: Sequence[str], shard: int, weight: float) -> Column:
    """An exponential draw with the weight as its rate, from the top 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key], F.lit(shard).cast("bigint")), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


def place(df: DataFrame, key: Sequence[str], weights: Sequence[float], name: str = "shard") -> DataFrame:
    """Adds the shard, 0 to ``len(weights) - 1``, that wins each record's key.

    Equal keys share a shard; a null key is a key like any other. Equal scores go to the
    smaller shard. An empty table stays empty. A column that bears the name is replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("Every shard needs a weight above zero")
    draws = [F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return df.withColumn(name, F.array_min(F.array(*draws))["shard"])


def numbered(df: DataFrame, key: Sequence[str], by: str = "shard", name: str = "slot", blocks: int = 256) -> DataFrame:
    """The distinct rows of a narrow table, each as often as it occurs, with gapless numbers
    from 0 inside each ``by``.

    A shard is cut into ``blocks`` by the hash of the key, so that no task numbers a whole
    shard. Equal rows are counted before the shuffle and spread out again at the end, in
    runs, so that a row that fills a third of the table is one row until then.
    """
    columns = df.columns
    block = F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.lit("block")), F.lit(blocks))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", block)
    earlier = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(by, "__block").agg(F.sum("__n").alias("__n"))
    starts = starts.select(by, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__block").orderBy(*key, *[c for c in columns if c not in (by, *key)])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ready = counted.join(starts, [by, "__block"]).withColumn(
        "__start", F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    )
    run = 1_000_000
    chunks = ready.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / run))))
    left = F.least(F.col("__n") - F.col("__run") * run, F.lit(run))
    rows = chunks.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), left - 1)))
    place_in = (F.col("__start") + F.col("__run") * run + F.col("__i")).cast("bigint")
    return rows.select(*columns, place_in.alias(name))


def shard_documents(docs: DataFrame, shards: int = 24, weight: float = 1.0) -> DataFrame:
    """Each document's shard, its place there and its shard once there is one more.

    ``size`` counts the UTF-8 bytes of the text (a null text has none) plus 8. Repeated rows
    get a place each; rows without doc_id share a shard. Other columns are not read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit(LAW).alias("law"))
    placed = place(narrow, ["doc_id"], [weight] * shards)
    won = _score(["doc_id"], shards, weight) < F.least(*[_score(["doc_id"], i, weight) for i in range(shards)])
    grown = F.when(won, F.lit(shards)).otherwise(F.col("shard"))
    return numbered(placed.withColumn("grown_shard", grown), ["doc_id"])
