"""Near-duplicate documents by SetSketch registers.

1. Every text becomes its set of five-word shingles and 128 registers. Equal sets are one
   class from here on, so a group of exact copies costs one class however large it is.
2. Bands of four registers put classes into buckets. A class is compared with the leader of
   each of its buckets (another one in each), which is linear in the size of the bucket.
   The joint likelihood of two sketches drops pairs that cannot reach the threshold; the
   rest is confirmed on full sets, and confirmed links make first components.
3. Within a bucket only classes of different components are left to compare. They meet in
   tiles of bounded size, all of them, and pass the same likelihood; the full sets of those
   that have a likely partner meet in the same tile, where all intersections are counted at
   once. What leaves a tile is a spanning forest of confirmed links. So no link between two
   components is lost to the shortcut, a large group of near copies, which step 2 has
   joined, costs nothing more, and no pair leaves its task.

Results: ``n_shingles`` is the size of the set, ``component_id`` the smallest doc_id
reachable by confirmed links, ``kept`` whether that is the row's own. A null or blank text
has no shingles and is linked with nothing, a text of under five words is one shingle.
Rows that repeat a doc_id are rows of their own; a null doc_id is larger than any other, and
a component without any doc_id has component_id null and is kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .arrow import Forest, fixed_rows, sorted_groups
from .common import components, releasing, small_batches, written
from .shingles import WordHashes, shingles

LEAST = 75  # per cent
TILE = 512


def _fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``fingerprint`` of the set and ``registers``; the last two
    are null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fingerprint", pa.binary()), ("registers", pa.binary())])

    def rows(ids: list, sets: list) -> pa.RecordBatch:
        filled = [s for s in sets if len(s)]
        sketches = iter(setsketch.sketch(filled))
        prints = [_fingerprint(s) if len(s) else None for s in sets]
        values = [next(sketches).tobytes() if len(s) else None for s in sets]
        columns = [ids, [len(s) for s in sets], prints, values]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids, sets, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text.as_py(), known))
                size += len(sets[-1])
                if size > 1 << 20:
                    yield rows(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield rows(ids, sets)

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return plain.mapInArrow(releasing(run), "doc_id bigint, n_shingles bigint, fingerprint binary, registers binary")


def buckets(classes: DataFrame) -> DataFrame:
    """``key``, ``band``, ``class``, ``leader`` and ``n`` for every bucket of at least two classes.

    The leader is the class whose number, crossed with the bucket's key, is smallest: another
    class in each bucket, found by a minimum that combines before the shuffle.
    """
    width = 2 * setsketch.ROWS
    bands = [F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(setsketch.BANDS)]
    banded = classes.select("class", F.posexplode(F.array(*bands)).alias("band", "key"))
    crossed = F.col("class").bitwiseXOR(F.col("key"))
    found = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(crossed).alias("__least")).where("n > 1")
    leader = F.col("__least").bitwiseXOR(F.col("key"))
    return banded.join(found, "key").select("key", "band", "class", leader.alias("leader"), "n")


def _likely(pairs: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """The pairs that the joint likelihood of their sketches does not rule out."""
    for side in ("x", "y"):
        named = [F.col("class").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")]
        pairs = pairs.join(facts.select(*named), side)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (fixed_rows(batch.column(f"r_{s}"), np.uint16, setsketch.REGISTERS) for s in "xy")
                n_left, n_right = (batch.column(f"n_{s}").to_numpy() for s in "xy")
                keep = pa.array(setsketch.likely(left, right, n_left, n_right, least))
                yield pa.RecordBatch.from_arrays([batch.column(s).filter(keep) for s in "xy"], names=["x", "y"])

    return pairs.select("x", "y", "n_x", "n_y", "r_x", "r_y").mapInArrow(releasing(run), "x bigint, y bigint")


def _across(members: DataFrame, least: float) -> DataFrame:
    """``key``, ``i``, ``j`` and ``class`` for the classes that have a likely partner of another
    component in that tile.

    ``members``: key, band, n, class, label, n_shingles, registers. A bucket is dealt out in
    blocks of about ``TILE`` classes at most, and every two blocks meet in a tile of their
    own. Two classes are compared in the first band they share only.
    """
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    block = F.pmod(F.xxhash64("class"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    dealt = members.withColumns({"__blocks": blocks, "block": block}).withColumn("__other", other)
    tiles = dealt.select(
        "key", F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"),
        "block", "band", "class", "label", "n_shingles", "registers",
    ).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for group in sorted_groups(batches, ["key", "i", "j"]):
            i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
            block, label, number, size = (group.column(c).to_numpy() for c in ("block", "label", "class", "n_shingles"))
            if (label == label[0]).all():
                continue
            matrix = fixed_rows(group.column("registers"), np.uint16, setsketch.REGISTERS)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            marked = np.zeros(len(number), bool)
            step = max(1, 40_000 // max(1, len(right)))
            for at in range(0, len(left), step):
                part = left[at : at + step]
                meet = label[part][:, None] != label[right][None, :]
                if i == j:
                    meet &= number[part][:, None] < number[right][None, :]
                a, b = np.nonzero(meet)
                a, b = part[a], right[b]
                if band and len(a):
                    same = matrix[a, : band * setsketch.ROWS] == matrix[b, : band * setsketch.ROWS]
                    first = ~same.reshape(len(a), band, setsketch.ROWS).all(2).any(1)
                    a, b = a[first], b[first]
                keep = setsketch.likely(matrix[a], matrix[b], size[a], size[b], least)
                marked[a[keep]] = marked[b[keep]] = True
            if marked.any():
                columns = [group.column(c).filter(pa.array(marked)).combine_chunks() for c in ("key", "i", "j", "class", "block")]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "i", "j", "class", "block"])

    return tiles.mapInArrow(releasing(run), "key bigint, i int, j int, class bigint, block int")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class`` and ``shingles`` of the classes in ``wanted``, whose text is read again: one text
    per class, that with the doc_id the class bears."""
    wanted = classes.join(wanted.distinct(), "class").select("class", "fingerprint", F.col("doc_id").alias("__id"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    schema = pa.schema([("fingerprint", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        known = WordHashes()
        for batch in batches:
            prints, sets, size = [], [], 0
            for text in batch.column("text"):
                found = shingles(text.as_py(), known)
                if len(found):
                    prints.append(_fingerprint(found))
                    sets.append(found.view(np.int64))
                    size += len(found)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(sets, schema.field(1).type)], schema=schema)
                    prints, sets, size = [], [], 0
            if prints:
                yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(sets, schema.field(1).type)], schema=schema)

    built = texts.select("text").mapInArrow(releasing(run), "fingerprint binary, shingles array<bigint>")
    built = built.groupBy("fingerprint").agg(F.first("shingles").alias("shingles"))
    return built.join(wanted, "fingerprint").select("class", "shingles")


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, per_cent: int) -> DataFrame:
    """The pairs of classes whose full sets are similar enough, as ``u`` and ``v``."""
    ends = pairs.select(F.col("x").alias("class")).union(pairs.select(F.col("y").alias("class")))
    sets = written(_sets(docs, classes, ends), "sets")
    both = pairs.join(sets.select(F.col("class").alias("x"), F.col("shingles").alias("s_x")), "x")
    both = both.join(sets.select(F.col("class").alias("y"), F.col("shingles").alias("s_y")), "y")
    shared = F.size(F.array_intersect("s_x", "s_y")).cast("bigint")
    sized = both.select("x", "y", shared.alias("__shared"), (F.size("s_x") + F.size("s_y")).cast("bigint").alias("__both"))
    enough = sized.where(F.col("__shared") * 100 >= (F.col("__both") - F.col("__shared")) * per_cent)
    return enough.select(F.col("x").alias("u"), F.col("y").alias("v"))


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` sets, by matrix products over
    the elements that more than one set holds."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[element] > 1
    rows, element = rows[often], (np.cumsum(count > 1) - 1)[element[often]]
    order = np.argsort(element, kind="stable")
    rows, element = rows[order], element[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(element[-1]) + 1 if len(element) else 0, step):
        low, high = np.searchsorted(element, [at, at + step])
        held = np.zeros((len(sets), step), np.float32)
        held[rows[low:high], element[low:high] - at] = 1
        out += held[left] @ held[right].T
    return out.astype(np.int64)


def _linked(marks: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """A spanning forest, as ``u`` and ``v``, of the confirmed links in each tile."""
    tiles = marks.join(sets, "class").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for group in sorted_groups(batches, ["key", "i", "j"]):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            block, number = group.column("block").to_numpy(), group.column("class").to_numpy()
            found = [np.asarray(v.values) for v in group.column("shingles")]
            size = np.array([len(s) for s in found])
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            shared = intersections(found, left, right)
            enough = shared * 100 >= (size[left][:, None] + size[right][None, :] - shared) * per_cent
            a, b = np.nonzero(enough & (number[left][:, None] != number[right][None, :]))
            forest = Forest(len(number))
            forest.join(left[a], right[b])
            if forest.edges:
                u, v = np.array(forest.edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(number[u]), pa.array(number[v])], names=["u", "v"])

    return tiles.select("key", "i", "j", "block", "class", "shingles").mapInArrow(releasing(run), "u bigint, v bigint")


def link_documents(docs: DataFrame, per_cent: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``fingerprint`` per document."""
    least = per_cent / 100
    small_batches(docs)
    marks = written(sketched(docs), "sketches")
    facts = [F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")]
    classes = marks.where("n_shingles > 0").groupBy("fingerprint").agg(*facts)
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = written(buckets(classes), "buckets")
    stars = members.where("class <> leader").select(F.least("class", "leader").alias("x"), F.greatest("class", "leader").alias("y"))
    likely = written(_likely(stars.distinct(), classes, least), "stars")
    links = written(_confirmed(docs, classes, likely, per_cent), "links")
    labels = components(links).select(F.col("node").alias("class"), F.col("root").alias("label"))

    rest = members.where("n > 2 AND class <> leader").join(labels, "class", "left")
    rest = rest.withColumn("label", F.coalesce("label", "class"))
    mixed = rest.groupBy("key").agg(F.min("label").alias("__low"), F.max("label").alias("__high")).where("__low < __high")
    rest = rest.join(mixed.select("key"), "key").join(classes.select("class", "n_shingles", "registers"), "class")
    marks_across = written(_across(rest, least), "across")
    more = written(_linked(marks_across, _sets(docs, classes, marks_across.select("class")), per_cent), "links")
    if not more.isEmpty():
        labels = components(links.union(more)).select(F.col("node").alias("class"), F.col("root").alias("label"))

    named = classes.select("class", "fingerprint", "doc_id").join(labels, "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    first = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(first, "label").select("fingerprint", "component_id")
    joined = marks.drop("registers").join(named, "fingerprint", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "fingerprint"
    )
