"""Hard negatives of anchors by threshold joins over an inverted index (after L2AP).

Vectors are scaled to integers, so scores are integers and exact. Rows and anchors are dealt into
blocks, and every two blocks of one length meet in one tile; a join of a tile works so:

* Dimensions are ordered by the energy of the block. For a threshold, a row's posting lists end
  where its suffix norm, times the largest suffix norm that an anchor has in proportion to its
  threshold, stays below 1: a pair that shares no indexed dimension cannot reach the threshold.
* Lists are read dimension group by dimension group. Partial scores accumulate, and a row leaves
  where the partial score plus the product of the remaining norms stays below the threshold of
  every anchor. The pairs that reach the end are scored exactly.
* Thresholds start high and are lowered, for the anchors whose windows are not full, until every
  window holds its best ``k`` rows or its lower end is passed. What a window holds after one part
  of a block raises its lower end for the next, so later parts start where earlier ones ended.

Two such joins follow each other: an anchor's positives are the best of its own label, one window
without ends; the negatives are the best of other labels inside the windows that the positives'
scores set. A tile returns ``k`` rows per window at most, which Spark merges per window. A tile
holds blocks of bounded bytes; labels and crowds of equal vectors do not decide where a row goes.

``label`` is an integer. Rows with a null label, a null vector, or a null or non-finite component
take no part, nor do those beyond the integer scale (a norm of 2**31 or more after scaling).
Vectors of different lengths have no inner product and never meet; empty ones score 0. Zero vectors
take part. Ties go to the smaller vec_id, null last. Rows that repeat a vec_id are rows of their own,
only the anchor's own row is left out. An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
NORM = 2**31
LAST = np.iinfo(np.int64).max
#: Bytes of integers in a block, rows of a part, anchors at once, dimensions read at once.
BLOCK_BYTES, PART, ANCHORS, GROUP = 8 << 20, 2048, 1024, 8
#: Where the thresholds of successive rounds lie between the lower end of a window (0) and the highest possible score (1).
ROUNDS = (0.8, 0.65, 0.5, 0.25, 0.0)


def scaled(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """``row``, ``vec_id``, ``label``, ``anchor``, ``length`` and the integers ``x`` of the rows that
    take part, written once."""
    value = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < NORM))
    plain = vectors.select(
        F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "embedding",
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    squares = F.aggregate("x", F.lit(0.0), lambda total, x: total + x * x)
    inside = plain.withColumn("x", value).where(squares < F.lit(float(NORM)) ** 2)
    integers = F.transform("x", lambda x: x.cast("int")).alias("x")
    return written(
        inside.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", F.size("x").alias("length"), integers),
        "integers",
    )


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows whose norms lie below 2**31.

    Doubles are exact below 2**53; larger ones are split into halves that stay there.
    """
    a, b = left.astype(np.float64), right.astype(np.float64)
    most = (np.linalg.norm(a, axis=1).max(initial=0) + 1) * (np.linalg.norm(b, axis=1).max(initial=0) + 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    a_high, b_high = np.floor(a / 65536), np.floor(b / 65536)
    a_low, b_low = a - a_high * 65536, b - b_high * 65536
    cross = (a_high @ b_low.T).astype(np.int64) + (a_low @ b_high.T).astype(np.int64)
    return ((a_high @ b_high.T).astype(np.int64) << 32) + (cross << 16) + (a_low @ b_low.T).astype(np.int64)


def suffix_norms(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of what each row holds from each cut on."""
    squares = rows.astype(np.float64) ** 2
    tail = np.zeros((len(rows), rows.shape[1] + 1))
    tail[:, :-1] = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(tail[:, cuts])


class Index:
    """Rows of one part of a block with their dimensions in the order of energy."""

    def __init__(self, rows: np.ndarray, order: np.ndarray):
        self.rows = rows[:, order]
        self.cuts = [*range(0, rows.shape[1], GROUP), rows.shape[1]]
        self.tails = suffix_norms(self.rows, self.cuts)

    def reaching(self, anchors: np.ndarray, tails: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Rows that may reach the threshold ``least`` of one of the anchors."""
        kept = np.arange(len(self.rows))
        if (least <= 0).any() or len(self.cuts) < 3:
            return kept  # no norm is small enough to leave a dimension out
        share = (tails / least[:, None]).max(0)
        indexed = self.tails * share[None, :] >= 1 - 1e-9
        partial = np.zeros((len(anchors), len(kept)))
        slack = 1e-9 * tails[:, 0]
        for g, (low, high) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            # The lists of this group: rows that have not ended, or that already hold a score.
            listed = indexed[kept, g] | (partial != 0).any(0)
            kept, partial = kept[listed], partial[:, listed]
            if not len(kept):
                break
            partial = partial + anchors[:, low:high].astype(np.float64) @ self.rows[kept, low:high].T.astype(np.float64)
            rest = tails[:, g + 1][:, None] * self.tails[kept, g + 1][None, :] + slack[:, None] * self.tails[kept, 0][None, :]
            alive = (partial + rest >= least[:, None]).any(0)
            kept, partial = kept[alive], partial[:, alive]
        return kept


class Windows:
    """The best ``k`` rows of every window of every anchor, highest score, then smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        # One row per anchor, one column per window; a window whose ends cross stays empty.
        self.low, self.high, self.k = low, high, k
        self.width = low.shape[1]
        self.slot, self.place = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.floor = low.copy()

    def add(self, anchor: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.width):
            fits = (score >= self.floor[anchor, w]) & (score <= self.high[anchor, w])
            self.slot = np.concatenate([self.slot, anchor[fits] * self.width + w])
            self.place = np.concatenate([self.place, place[fits]])
            self.score = np.concatenate([self.score, score[fits]])
        order = np.lexsort((self.place, ids[self.place], -self.score, self.slot))
        slot = self.slot[order]
        rank = np.arange(len(order)) - np.searchsorted(slot, slot)
        order, full = order[rank < self.k], order[rank == self.k - 1]
        self.floor.reshape(-1)[self.slot[full]] = self.score[full]
        self.slot, self.place, self.score = self.slot[order], self.place[order], self.score[order]


def threshold_join(anchors, rows, low, high, k, meets, ids) -> Windows:
    """The windows ``low`` to ``high`` of the anchors, filled from ``rows``; ``meets(a, b)`` says
    which of the anchors and rows with these places may pair, as a matrix."""
    windows = Windows(low, high, k)
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
    turned = anchors[:, order]
    for at in range(0, len(rows), PART):
        part = Index(rows[at : at + PART], order)
        tails = suffix_norms(turned, part.cuts)
        limit = np.ceil(tails[:, 0] * part.tails[:, 0].max() * (1 + 1e-9) + 1)
        seen = np.full(len(anchors), np.inf)  # scores from here on have been found
        for share in ROUNDS:
            possible = windows.floor <= np.minimum(windows.high, limit[:, None])
            top = np.where(possible, np.minimum(windows.high, limit[:, None]), -np.inf).max(1)
            bottom = np.where(possible, np.maximum(windows.floor, -limit[:, None]), np.inf).min(1)
            active = np.flatnonzero(possible.any(1) & (bottom < seen))
            if not len(active):
                break
            top, bottom = np.minimum(top, seen)[active], bottom[active]
            least = np.ceil(bottom + (top - bottom) * share) if share else bottom
            kept = part.reaching(turned[active], tails[active], least)
            if len(kept):
                score = product(turned[active], part.rows[kept])
                found = (score >= least[:, None]) & (score < seen[active][:, None]) & meets(active, at + kept)
                a, b = np.nonzero(found)
                windows.add(active[a], at + kept[b], score[a, b], ids)
            seen[active] = least
    return windows


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _tiles(rows: DataFrame, anchors: DataFrame, join) -> DataFrame:
    """What ``join`` (anchors' table, rows' table) makes of every tile: ``anchor``, ``low``, ``high``,
    ``vec_id`` and ``score``.

    As many blocks as keep each below ``BLOCK_BYTES`` on average, and 16 parts of a small table.
    """
    size = F.col("length").cast("bigint") * 8 + 64
    n, total, of_anchors = rows.agg(F.count(F.lit(1)), F.sum(size), F.sum(F.when(F.col("anchor"), size))).first()
    across = max(-(-(total or 0) // BLOCK_BYTES), min(16, -(-n // 512)), 1)
    down = max(-(-(of_anchors or 0) // BLOCK_BYTES), 1)
    block = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = anchors.withColumn("i", block(down, "a")).withColumn("j", every(across))
    right = rows.withColumn("j", block(across, "r")).withColumn("i", every(down))
    own = [F.col(c).alias(f"own_{c}") for c in ("row", "label", "x")]
    left = left.select(F.col("length").alias("own_length"), "i", "j", *own, "lows", "highs")
    right = right.select("length", "i", "j", "row", "vec_id", "label", "x")
    met = left.groupBy("own_length", "i", "j").cogroup(right.groupBy("length", "i", "j"))
    return met.applyInArrow(join, "anchor bigint, low bigint, high bigint, vec_id bigint, score bigint")


FOUND = pa.schema([(n, pa.int64()) for n in ("anchor", "low", "high", "vec_id", "score")])


def _joined(same: bool, k: int):
    """The join of one tile: rows of the anchor's label (``same``) or of others, ``k`` per window."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        length = left.column("own_length")[0].as_py()
        x = _matrix(right.column("x"), length)
        label, number = (right.column(c).to_numpy() for c in ("label", "row"))
        names = right.column("vec_id").combine_chunks()
        ids = names.fill_null(LAST).to_numpy()
        made = []
        for at in range(0, left.num_rows, ANCHORS):
            part = left.slice(at, ANCHORS)
            own, wanted = part.column("own_row").to_numpy(), part.column("own_label").to_numpy()
            anchors = _matrix(part.column("own_x"), length)
            low, high = (_padded(part.column(c).to_pylist(), f) for c, f in (("lows", LAST), ("highs", -LAST)))
            # Labels apart, or all rows at once.
            for chosen in [np.flatnonzero(wanted == v) for v in np.unique(wanted)] if same else [np.arange(len(own))]:
                places = np.flatnonzero(label == wanted[chosen[0]]) if same else np.arange(len(label))
                if not len(places):
                    continue

                def meets(a, b):
                    apart = own[chosen[a]][:, None] != number[places[b]][None, :]
                    return apart if same else apart & (wanted[chosen[a]][:, None] != label[places[b]][None, :])

                found = threshold_join(anchors[chosen], x[places], low[chosen], high[chosen], k, meets, ids[places])
                a, w = np.divmod(found.slot, found.width)
                columns = [own[chosen[a]], low[chosen[a], w], high[chosen[a], w]]
                columns = [*map(pa.array, columns), names.take(pa.array(places[found.place])), pa.array(found.score)]
                made.append(pa.Table.from_arrays(columns, schema=FOUND))
        return pa.concat_tables(made) if made else FOUND.empty_table()

    return join


def _padded(lists: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and
    ``negative_score``: for each anchor and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels whose score lies between ``low`` and ``high`` per cent of
    the positive's."""
    rows = scaled(vectors, label, is_anchor)
    anchors = rows.where("anchor")
    ends = {"lows": F.array(F.lit(-LAST)), "highs": F.array(F.lit(LAST))}
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    near = _tiles(rows, anchors.withColumns(ends), _joined(True, positives))
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # Whole numbers between the two shares of a score that is not negative, without leaving a long.
    near = near.select(
        "anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100").alias("low"),
        F.expr(f"score div 100 * {high} + score % 100 * {high} div 100").alias("high"),
    )
    near = written(near, "positives")
    spans = near.where("positive_score >= 0 AND low <= high").groupBy("anchor").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = spans.select(F.col("anchor").alias("row"), F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    best = Window.partitionBy("anchor", "low", "high").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    far = _tiles(rows, anchors.join(spans, "row"), _joined(False, negatives))
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    far = far.select("anchor", "low", "high", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = near.where("positive_score >= 0").join(far, ["anchor", "low", "high"]).join(names, "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
