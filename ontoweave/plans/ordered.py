"""Pages and runs of equal neighbours in a total order, without one task seeing it whole.

A deep page is found by value, not by position: quantiles of the order key bound the value at the
page's first row, exact counts confirm it, and the bounds go back into the scan as filters, where
they prune files. Rows that share a value are paged by the next key. Nothing is written, and only
the rows of the page are sorted.

Runs of neighbours range-partition rows by the full order, so a group that holds a third of all
rows still spreads evenly. Each block is read on its own; what a block needs to know of the one
before it is one row per block.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.local import local_frame
from ..session import cut

# Up to here a page is a top-k, which one task merges.
SHALLOW = 100_000
# So many values of a key may come to the driver to find one of them.
FEW = 10_000
ACCURACY = 10_000
# Characters of a text that one number stands for.
TEXT_STEP = 2
LETTER = 1 << 21


@dataclass(frozen=True)
class Key:
    """One key of an order: nulls come first, or last if descending, as Spark sorts."""

    value: Column
    descending: bool = False

    def order(self) -> Column:
        return self.value.desc() if self.descending else self.value.asc()


@dataclass(frozen=True)
class _Level:
    """A number that rows are in the order of, among rows whose earlier numbers agree.

    ``plain`` is the key itself where its own type compares as the number does, ``text`` the key
    whose beginning the number stands for; filters on them reach the scan. ``ends`` says of a
    number that rows which share it share the key.
    """

    number: Column
    descending: bool
    ends: Callable[[int], bool]
    plain: Column | None = None
    text: Column | None = None

    def between(self, low=None, high=None, open_low: bool = False, open_high: bool = False) -> Column:
        on = self.number if self.plain is None else self.plain
        parts = [F.lit(True)]
        if low is not None:
            parts.append(on > F.lit(low) if open_low else on >= F.lit(low))
            if self.text is not None and low:
                parts.append(self.text >= F.lit(_beginning(low)))
        if high is not None:
            parts.append(on < F.lit(high) if open_high else on <= F.lit(high))
            beyond = self.text is not None and high and _next_text(_beginning(high))
            if beyond:
                parts.append(self.text < F.lit(beyond))
        return reduce(Column.__and__, parts)


def _beginning(number: int) -> str:
    return "".join(chr(code - 1) for code in divmod(number, LETTER) if code)


def _next_text(text: str) -> str | None:
    """The least text after all that begin with this one."""
    code = ord(text[-1]) + 1
    code = 0xE000 if 0xD800 <= code < 0xE000 else code
    return text[:-1] + chr(code) if code <= 0x10FFFF else None


NUMBERS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
NARROWED = (*NUMBERS, T.BooleanType, T.StringType)


def _levels(key: Key, kind: T.DataType) -> Iterator[_Level]:
    """The numbers that order a key: null or not, then the value, or a text's characters step by
    step; a text has no last step but the one where it ends. Other types narrow no further."""
    nan = F.isnan(key.value) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False)
    yield _Level(F.when(key.value.isNull(), 0).when(nan, 2).otherwise(1), key.descending, lambda v: v != 1)
    if isinstance(kind, NUMBERS):
        yield _Level(key.value, key.descending, lambda v: True, plain=key.value)
    elif isinstance(kind, T.BooleanType):
        yield _Level(key.value.cast("int"), key.descending, lambda v: True)
    elif isinstance(kind, T.StringType):
        for at in itertools.count(1, TEXT_STEP):
            letters = [F.substr(key.value, F.lit(at + i), F.lit(1)) for i in range(TEXT_STEP)]
            codes = [F.when(x == "", 0).otherwise(F.ascii(x) + 1).cast("bigint") for x in letters]
            scan = key.value if at == 1 else None
            yield _Level(codes[0] * LETTER + codes[1], key.descending, lambda v: v % LETTER == 0, text=scan)


def _value_at(df: DataFrame, level: _Level, rank: int, n: int) -> tuple[object, int, int]:
    """The level's value in the row of a rank, how many rows come before that value and how many
    hold it. ``n`` rows are there."""
    number = level.number
    region, before, slack = df, 0, 2.0
    while True:
        here = rank - before
        if n <= FEW:
            counts = region.groupBy(number.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
            for r in sorted(counts, key=lambda r: r["v"], reverse=level.descending):
                if here < r["n"]:
                    return r["v"], before, r["n"]
                before, here = before + r["n"], here - r["n"]
            raise ValueError("A page beyond the last row")
        share = (n - 1 - here if level.descending else here) / n
        near = [max(0.0, share - slack / ACCURACY), min(1.0, share + slack / ACCURACY)]
        low, high = region.agg(F.percentile_approx(number, near, ACCURACY).alias("q")).first()["q"]
        inside = (number >= F.lit(low)) & (number <= F.lit(high))
        ahead = number > F.lit(high) if level.descending else number < F.lit(low)
        first, last = (high, low) if level.descending else (low, high)
        counted = region.agg(F.count_if(ahead), F.count_if(inside), F.count_if(number == F.lit(first)), F.count_if(number == F.lit(last))).first()
        skipped, held, at_first, at_last = counted
        if not skipped <= here < skipped + held:
            slack *= 4  # the quantiles were further off than they should be
            continue
        before, here = before + skipped, here - skipped
        if here < at_first:
            return first, before, at_first
        if here >= held - at_last:
            return last, before + held - at_last, at_last
        region, slack = region.where(level.between(low, high, True, True)), 2.0
        before, n = before + at_first, held - at_first - at_last


def page_of(df: DataFrame, order: Sequence[Key | str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order."""
    keys = [k if isinstance(k, Key) else Key(F.col(k)) for k in order]
    by = [k.order() for k in keys]
    if offset + limit <= SHALLOW:
        return df.orderBy(*by).offset(offset).limit(limit)
    n = df.count()
    if offset >= n:
        return df.limit(0)
    kinds = [f.dataType for f in df.select(*[k.value.alias(str(i)) for i, k in enumerate(keys)]).schema.fields]
    # A key of another type ends the narrowing: rows that agree before it are sorted.
    known = next((i for i, kind in enumerate(kinds) if not isinstance(kind, NARROWED)), len(kinds))
    levels = [_levels(k, kind) for k, kind in zip(keys[: known + 1], kinds)]
    whole = known == len(kinds)
    return _page(df, by, levels, whole, offset, min(limit, n - offset), n).orderBy(*by)


def _page(df: DataFrame, by: list[Column], levels: list[Iterator[_Level]], whole: bool, offset: int, limit: int, n: int) -> DataFrame:
    """The rows of a page among ``n`` rows that agree in all levels taken so far; ``whole`` if rows
    that agree in every level are equal in all keys."""
    if offset + limit <= SHALLOW:
        return df.orderBy(*by).offset(offset).limit(limit)
    if not levels:
        return df.limit(limit) if whole else df.orderBy(*by).offset(offset).limit(limit)
    level = next(levels[0], None)
    if level is None:
        return _page(df, by, levels[1:], whole, offset, limit, n)
    value, before, ties = _value_at(df, level, offset, n)
    here = min(limit, before + ties - offset)
    deeper = levels[1:] if level.ends(value) else levels
    found = _page(df.where(level.between(value, value)), by, deeper, whole, offset - before, here, ties)
    if here == limit:
        return found
    # The rest lies after that value, and no further than the value of the page's last row.
    last = _value_at(df, level, offset + limit - 1, n)[0]
    rest = level.between(last, value, open_high=True) if level.descending else level.between(value, last, open_low=True)
    return found.unionByName(df.where(rest).orderBy(*by).limit(limit - here))


def in_blocks(df: DataFrame, order: Sequence[Column | str], blocks: int | None = None) -> DataFrame:
    """The rows with a ``block`` number that grows with the order.

    Written to the shared folder once: range boundaries are sampled, and a rerun must not
    draw others.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()))


def numbered_runs(df: DataFrame, group: str, key: str, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows with ``run``: neighbours of one group with the same key share a number; a null
    key is a run of its own. ``order`` must start with the group and be total."""
    placed = in_blocks(df, order, blocks)
    inside = Window.partitionBy("block").orderBy(*order)
    same = (F.col(group) == F.lag(group).over(inside)) & F.coalesce(
        F.col(key) == F.lag(key).over(inside), F.lit(False)
    )
    marked = placed.withColumns(
        {"__nth": F.row_number().over(inside), "__starts": ~F.coalesce(same, F.lit(False))}
    )
    place = F.struct(*order)
    edge = F.struct(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("k"))
    edges = (
        marked.groupBy("block")
        .agg(
            F.min_by(edge, place).alias("head"),
            F.max_by(edge, place).alias("tail"),
            F.sum(F.when((F.col("__nth") > 1) & F.col("__starts"), 1).otherwise(0)).alias("starts"),
        )
        .orderBy("block")
        .collect()
    )
    # One row per block from here to the next statement.
    offsets, total, tail = [], 0, None
    for e in edges:
        continues = tail is not None and e["head"]["k"] is not None and e["head"] == tail
        offsets.append((e["block"], not continues, total))
        total += e["starts"] + (not continues)
        tail = e["tail"]
    begin = local_frame(df.sparkSession, offsets, "block int, __first boolean, __before bigint")
    starts = F.when(F.col("__nth") == 1, F.col("__first")).otherwise(F.col("__starts"))
    running = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(F.broadcast(begin), "block")
        .withColumn("run", F.col("__before") + F.sum(starts.cast("bigint")).over(running))
        .drop("block", "__nth", "__starts", "__first", "__before")
    )
