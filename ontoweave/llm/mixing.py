"""Mixing sources to target weights by repeating documents.

Tokens are summed per source, which gives each source a target and a repetition rate; a
document is then emitted ``floor(rate)`` times, plus one copy drawn with the rate's
fraction as its probability. The draw is a hash of the seed, the document's id and its text, so
a rerun and a lost executor draw the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD, ranked


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: int, key: str = "doc_id", text: str = "text") -> Column:
    """A number from 0 to 1 that depends on the seed, the key and the text alone (52 bits of an
    MD5), so that rows without a key of their own draw apart by their texts."""
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    named = F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of ``source`` and ``size``.

    Sources in code-point order, null last, take the weights in turn. Together they get
    ``share`` times all sizes; no target exceeds ``most`` times its source's size, and what
    is left over is shared again by weight among the rest until none exceeds it. A source
    whose documents are all empty gets no target beyond 0.

    Sharing again is a loop over one scalar, the level: the sources whose cap lies under
    ``level * weight`` are capped and the rest gives the next level. Levels only rise, and
    a round is one aggregate over the sources, of which the driver sees one row.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    turn = F.element_at(F.lit(list(weights)), (F.col("__place") % len(weights) + 1).cast("int"))
    sources = cut(ranked(sums, order, "__place").withColumn("weight", turn.cast("bigint")).drop("__place"))
    cap = F.col("source_size") * F.lit(float(most))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        capped = cap < F.col("weight") * F.lit(level)
        given, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        following = (total - given) / open_weight if open_weight else level
        if following <= level:
            break
        level = following
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def plan(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The documents with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    Columns of these four names are replaced. A null or empty text has size 0. Documents without a source form a source of their own.
    Rows that repeat both a doc_id and its text draw alike. The join to the targets is by source: small targets
    are broadcast by their size, else a hot source is split by the adaptive skew join.
    """
    sized = docs.withColumn("__size", words())
    goals = targets(sized.select("source", F.col("__size").alias("size")), weights, share, most)
    goals = goals.select(
        F.col("source").alias("__source"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
    )
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    rate = F.least(rate, F.lit(float(most)))
    extra = F.when(draw(seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("__copies", (F.floor(rate) + extra).cast("int"))


def emit(planned: DataFrame) -> DataFrame:
    """Each document of a plan as often as it is to be taken, with its own columns only."""
    copies = planned.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copies.drop("__size", "__source_size", "__target", "__copies", "__copy")
