import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from ontoweave.llm import mixing, sharding

DOCS = "doc_id bigint, text string, source string"


def score(doc_id, shard, weight=1.0):
    seed = 42
    for value in (doc_id, shard):
        if value is not None:
            seed = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)
    return -math.log(((seed >> 11) + 0.5) / 2**53) / weight


def placed(doc_id, shards):
    return min(range(shards), key=lambda s: (score(doc_id, s), s))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, f"text {i} é" * (i % 7), f"s{i % 3}") for i in range(300)]
    rows += [(5, "text 5 é" * 5, "s2")] * 3 + [(None, None, None), (None, "", None), (-1, "x" * 200_000, "s0")]
    return spark.createDataFrame(rows, DOCS)


def test_shards_by_brute_force(odd_docs):
    got = sharding.shard_documents(odd_docs.withColumn("shard", F.lit("clash")).withColumn("size", F.lit(0)), 24).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        shard = placed(r["doc_id"], 24)
        won = score(r["doc_id"], 24) < score(r["doc_id"], shard)
        assert (r["shard"], r["grown_shard"], r["law"]) == (shard, 24 if won else shard, "key")
    by_row = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)
    wanted = [
        (r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
        for r in odd_docs.collect()
    ]
    assert by_row == sorted(wanted)
    for shard in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, sharding.shard_documents(odd_docs, 24).collect()), key=repr)


def test_weights_and_growth(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "key")
    three = sharding.place(keys, ["key"], [1, 2, 1])
    four = sharding.place(three.withColumnRenamed("shard", "old"), ["key"], [1, 2, 1, 4])
    sizes = {r["shard"]: r["count"] for r in three.groupBy("shard").count().collect()}
    assert abs(sizes[1] / 20_000 - 0.5) < 0.02 and abs(sizes[0] / 20_000 - 0.25) < 0.02
    moved = four.where("old <> shard")
    assert moved.where("shard <> 3").isEmpty() and abs(moved.count() / 20_000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.place(keys, ["key"], [1, 0])


def test_placing_needs_no_shuffle(spark):
    plan = sharding.place(spark.range(10).withColumnRenamed("id", "k"), ["k"], [1, 1])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.shard_documents(none).collect() == []
    assert mixing.plan(none).collect() == [] and mixing.emit(mixing.plan(none)).columns == none.columns


def water_level(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    total, targets = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in targets]
        left = total - sum(targets.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > most * sizes[s]]
        if not over:
            return targets | shares
        targets |= {s: most * sizes[s] for s in over}


def test_targets_by_brute_force(spark):
    sizes = {"Z": 1000, "a": 10, "é": 400, "b": 7000, "": 50, "\U0001f600": 3, "￿": 90, None: 700, "e": 0}
    rows = [(s, n) for s, n in sizes.items()]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    wanted = water_level(sizes, weights, 1.5, 2.0)
    got = mixing.targets(spark.createDataFrame(rows, "source string, size bigint"), (3, 1, 2), 1.5, 2.0)
    for r in got.collect():
        assert r["target"] == pytest.approx(wanted[r["source"]], abs=1e-9) and r["source_size"] == sizes[r["source"]]


def test_mixing_takes_what_targets_ask(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(8000)] + [(None, None, "s0"), (1, "", None), (7, "w w", "s1")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit(1)).withColumn("size", F.lit("x"))
    planned = mixing.plan(docs)
    by_source = planned.groupBy("source").agg(
        F.sum(F.col("__size") * F.col("__copies")).alias("taken"), F.first("__target").alias("goal"), F.max("__copies").alias("most")
    )
    for r in by_source.collect():
        assert r["taken"] == pytest.approx(r["goal"], rel=0.05, abs=1) and r["most"] <= 2
    emitted = mixing.emit(planned)
    assert emitted.columns == docs.columns
    assert emitted.count() == planned.agg(F.sum("__copies")).first()[0]
    again = mixing.plan(docs.repartition(7)).select("doc_id", "text", "__copies")
    assert sorted(again.collect(), key=repr) == sorted(planned.select("doc_id", "text", "__copies").collect(), key=repr)
    assert "Python" not in planned._jdf.queryExecution().toString()


def test_words_are_split_at_ascii_white_space_only(spark):
    texts = [(None, 0), ("", 0), (" \t\n\x0b\x0c\r", 0), ("a b c d", 2), ("x" * 300_000, 1)]
    got = spark.createDataFrame(texts, "text string, n bigint").withColumn("got", mixing.words()).collect()
    assert [r["got"] for r in got] == [r["n"] for r in got]
