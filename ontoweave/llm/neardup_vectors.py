"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors at a cosine of at least ``least`` lie within ``d = sqrt(2 - 2 * least)``, so on
a random direction their projections differ by a normal draw of spread d. All projections
are taken at once:

1. Groups of projections, cut into cells, bring possible pairs together: a pair must share
   the cells of a whole group. How many projections a group has follows from the number of
   vectors, and how many groups there are from the recall wanted at the threshold itself.
2. Within a cell every two vectors are compared on ``WINDOWS`` further projections: a
   window centred on one vector catches the other if they differ by at most ``WINDOW * d``.
   A pair whose collisions reach a count calibrated to the same recall is verified by its
   cosine in double precision. A pair that shares several cells counts in the first.
3. No pair leaves its task. What leaves are a number of links per vector and the links of a
   spanning forest of the cell, from which components follow.

Vectors with equal components are one class from the start, weighted by its size. A cell of
more than ``TILE`` vectors is dealt into blocks that meet in tiles, so that memory stays
bounded and a hot cell spreads over many tasks.

``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest
vec_id reachable, ``kept`` whether that is the row's own. Vectors that are null, zero, or hold
null or non-finite components link with nothing; those of different lengths never meet. Vectors
are scaled by powers of two, so huge and tiny ones have a cosine like any other. Rows that repeat a
vec_id are rows of their own; a null vec_id is larger than any other, and a component
without any has component_id null and is kept. Labels and other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Forest, sorted_groups
from .common import components, written
from .vectors import matrix, usable

LEAST = 0.95
#: Chance of losing a pair exactly at the threshold: by its cells, and by its count.
LOSS = 1e-4
#: Width of a cell and half-width of a window, as spreads of the difference at the threshold.
CELL, WINDOW, WINDOWS = 6.0, 2.0, 32
TILE = 2048
_normal = NormalDist()


@dataclass(frozen=True)
class Projections:
    """Directions, cell offsets and counts that follow from a number of vectors."""

    dimension: int
    spread: float
    per_group: int
    groups: int
    least_count: int
    seed: int = 20240311

    @staticmethod
    @cache
    def for_size(n: int, dimension: int, least: float) -> Projections:
        spread = math.sqrt(2 - 2 * least)
        # Two vectors whose projections differ by s times the cell's width in spread share it
        # with this probability; unrelated unit vectors differ by sqrt(2).
        near, far = same_cell(CELL), same_cell(CELL * spread / math.sqrt(2))
        per_group = max(1, math.ceil(math.log(max(n, 32) / 32) / -math.log(far)))
        groups = max(1, math.ceil(math.log(LOSS) / math.log(1 - near**per_group)))
        caught = 2 * _normal.cdf(WINDOW) - 1
        lost, count = 0.0, 0
        while True:
            lost += math.comb(WINDOWS, count) * caught**count * (1 - caught) ** (WINDOWS - count)
            if lost > LOSS:
                return Projections(dimension, spread, per_group, groups, count)
            count += 1

    @cache
    def directions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        cells = draw.standard_normal((self.dimension, self.groups * self.per_group))
        offsets = draw.random(self.groups * self.per_group)
        return cells, offsets, draw.standard_normal((self.dimension, WINDOWS))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit number of each vector's cell in each group."""
        directions, offsets, _ = self.directions()
        place = np.floor(unit @ directions / (CELL * self.spread) + offsets).astype(np.int64)
        place = place.reshape(len(unit), self.groups, self.per_group).astype(np.uint64)
        out = np.broadcast_to(np.arange(1, self.groups + 1, dtype=np.uint64), place.shape[:2]).copy()
        for i in range(self.per_group):
            out = (out ^ place[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Projections for the windows, in half-widths of a window."""
        return (unit @ self.directions()[2] / (WINDOW * self.spread)).astype(np.float32)


def same_cell(width: float) -> float:
    """Chance that a normal difference of spread 1 stays in one randomly placed cell."""
    tail = 2 * _normal.cdf(-width)
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1; cosines stay the same."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])


def links(vectors: np.ndarray, number: np.ndarray, left: np.ndarray, right: np.ndarray, group: int, within: bool, setup: Projections, least: float):
    """Places of linked pairs between ``left`` and ``right`` that first meet in ``group``."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / norms[:, None]
    places = setup.places(unit)
    crowded = group and len(left) * len(right) > 20_000
    cells = setup.cells(unit)[:, :group] if crowded else None
    step = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        if within:
            meet = number[part][:, None] < number[right][None, :]
        else:
            meet = np.ones((len(part), len(right)), bool)
        if crowded:
            # Of a crowd most pairs have met before; of a few rows it costs less to ask later.
            for earlier in range(group):
                meet &= cells[part, earlier][:, None] != cells[right, earlier][None, :]
                if not meet.any():
                    break
        a, b = np.nonzero(meet)
        for i in range(0, len(a), 200_000):
            x, y = part[a[i : i + 200_000]], right[b[i : i + 200_000]]
            collisions = (np.abs(places[x] - places[y]) <= 1).sum(1)
            passed = collisions >= setup.least_count
            x, y = x[passed], y[passed]
            close = (vectors[x] * vectors[y]).sum(1) >= least * (norms[x] * norms[y])
            x, y = x[close], y[close]
            if group and len(x) and not crowded:
                cells = setup.cells(unit)[:, :group] if cells is None else cells
                first = (cells[x] != cells[y]).all(1)
                x, y = x[first], y[first]
            if len(x):
                yield x, y


def link_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` per vector."""
    plain = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    found = usable(plain).groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    classes = written(found.withColumn("class", F.monotonically_increasing_id()), "vectors")
    n = classes.count()

    def celled(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column("embedding")).to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                setup = Projections.for_size(n, int(length), least)
                rows = scaled(matrix(pa.chunked_array([part.column("embedding")])))
                cells = setup.cells(rows / np.linalg.norm(rows, axis=1)[:, None])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * setup.groups), pa.array(cells.ravel()))
                same = pa.array(np.full(len(rows), length, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("class"), same, flat], names=["class", "length", "cells"])

    narrow = classes.select("class", "embedding").mapInArrow(celled, "class bigint, length int, cells array<bigint>")
    narrow = written(narrow.select("class", "length", F.posexplode("cells").alias("group", "cell")), "cells")
    counts = narrow.groupBy("length", "group", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = narrow.join(counts, ["length", "group", "cell"])
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    block = F.pmod(F.xxhash64("class", F.lit("block")), blocks).cast("int")
    dealt = shared.withColumns({"__blocks": blocks, "block": block})
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    places = F.struct(
        "length", "group", "cell", F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"), "block"
    )
    # Bounded by the number of groups times the blocks of a vector's cells.
    tiles = dealt.groupBy("class").agg(F.collect_list(places).alias("tiles")).join(classes, "class")
    tiles = tiles.select("class", "weight", "embedding", F.explode("tiles").alias("t")).select("class", "weight", "embedding", "t.*")
    keys = ["length", "group", "cell", "i", "j"]
    tiles = tiles.repartition(*keys).sortWithinPartitions(*keys)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for rows in sorted_groups(batches, keys):
            length, group, i, j = (rows.column(c)[0].as_py() for c in ("length", "group", "i", "j"))
            setup = Projections.for_size(n, length, least)
            own, weight, side = (rows.column(c).to_numpy() for c in ("class", "weight", "block"))
            values = scaled(matrix(rows.column("embedding")))
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            linked, forest = np.zeros(len(own), np.int64), Forest(len(own))
            for x, y in links(values, own, left, right, group, i == j, setup, least):
                np.add.at(linked, x, weight[y])
                np.add.at(linked, y, weight[x])
                forest.join(x, y)
            at = np.flatnonzero(linked)
            if len(at):
                u, v = np.array(forest.edges, np.int64).T
                first = pa.concat_arrays([pa.array(own[at]), pa.array(own[u])])
                second = pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(own[v])])
                third = pa.concat_arrays([pa.array(linked[at]), pa.nulls(len(u), pa.int64())])
                yield pa.RecordBatch.from_arrays([first, second, third], schema=schema)

    # Numbers of links have no v, links of a forest have no n.
    out = written(tiles.mapInArrow(run, "u bigint, v bigint, n bigint"), "links")
    numbers = out.where("v IS NULL").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("others"))
    labels = components(out.where("v IS NOT NULL").select("u", "v"))
    labels = labels.select(F.col("node").alias("class"), F.col("root").alias("label"))
    named = classes.join(labels, "class", "left").join(numbers, "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    first = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    total = F.col("weight") - 1 + F.coalesce("others", F.lit(0))
    named = named.join(first, "label").select(F.col("embedding").alias("__vector"), total.alias("n_links"), "component_id")
    joined = plain.join(named, F.col("embedding") == F.col("__vector"), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
