"""Toxicity by non-negative positive-unlabelled learning.

What is confirmed is toxic; everything else is unlabelled, not clean. With the class prior
``p``, the risk of a classifier is ``p * R+(positives) + max(0, R-(unlabelled) - p *
R-(positives))``: the positives hidden among the unlabelled are subtracted from the negative
risk, which may not fall below zero (Kiryo et al., 2017). Linear classifiers over words and
parts of words are trained with numpy, one per bag: each bag holds every confirmed example
of the sample and its own slice of the unlabelled ones, and their weights are averaged.

The training sample is bounded: about ``positives`` confirmed examples and ``unlabelled``
texts, drawn by the hash of the doc_id. Feature counts, bags and weights follow from it.
Scoring reads every document whole. Only rows outside the held-out fold train.

A null or empty text has no features and gets the score of the bias alone. Without any
confirmed example every score is 0. Labels that repeat a doc_id count once, as toxic if any
of them says so; rows that repeat a doc_id score by their own text; a null doc_id is in the
fold of the empty text and has no label.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, releasing, small_batches, written

FOLDS = 5
SPACE = 1 << 22
EDGES = b".,;:!?*&%#@()[]{}\"'`|<>-_=+~^/\\"
# Words remembered by a task: with all their features while training, with those that weigh while scoring.
FEW, MANY = 30_000, 150_000
# Texts handled at a time.
SLICE = 64


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def word_features(word: bytes) -> list[int]:
    """A word, its beginnings and its runs of four letters, as numbers below ``SPACE``."""
    bare = word.strip(EDGES).decode("utf-8", "replace")
    if not bare:
        return []
    parts = {"w" + bare}
    parts.update("p" + bare[:n] for n in (3, 4, 5, 6) if len(bare) > n)
    parts.update("g" + bare[i : i + 4] for i in range(1, len(bare) - 3))
    return [zlib.crc32(p.encode()) % SPACE for p in parts]


class Known(dict):
    """What a function gives for a word, computed once; forgotten when too many are known."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


def distinct_words(text: str | None) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").lower().split()) if text else set()


@dataclass
class Model:
    """Weights of features and the bias; without any, every score is 0."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -math.inf


class Sparse:
    """Rows that hold a 1 at their places and at a last one, the bias, for two products."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.rows, self.width = len(rows), width + 1
        sizes = np.array([len(r) + 1 for r in rows], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.places = np.concatenate([np.append(r, width) for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.places], self.starts) if self.rows else np.empty(0)

    def mean(self, factors: np.ndarray) -> np.ndarray:
        """The rows' mean, each times its factor."""
        return np.bincount(self.places, factors[self.owner], self.width) / max(1, self.rows)


def train_bag(rows: list[tuple[bool, np.ndarray]], width: int, prior: float, steps: int = 300) -> np.ndarray:
    """Weights and bias (last) of one bag by the non-negative risk, full batches and Adam."""
    plus, rest = (Sparse([found for p, found in rows if p is side], width) for side in (True, False))
    weights = np.zeros(width + 1, np.float64)
    weights[width] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    decay = np.full(width + 1, 1e-4)
    decay[width] = 0.0
    for step in range(1, steps + 1):
        at_plus, at_rest = (1 / (1 + np.exp(-np.clip(side.times(weights), -30, 30))) for side in (plus, rest))
        # Logistic loss: its slope is s - 1 as a positive and s as a negative.
        slope_minus = rest.mean(at_rest) - prior * plus.mean(at_plus)
        risk_minus = -np.log1p(-at_rest + 1e-12).mean() + prior * np.log1p(-at_plus + 1e-12).mean()
        slope_plus = prior * plus.mean(at_plus - 1)
        slope = -slope_minus if risk_minus < 0 else slope_plus + slope_minus
        slope = slope + decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, features: int = 2048, bags: int = 4) -> Model:
    """A model from the labelled rows outside the held-out fold and unlabelled text there."""
    small_batches(docs)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.sum("__toxic")).first()
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where(fold() != 0)
    n_texts = texts.select("doc_id").count()
    if not n_toxic or not n_texts:
        return Model()
    prior = min(max(n_toxic / n_known, 0.001), 0.9)
    chance = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11).cast("double")) / float(1 << 53)
    toxic = known.where(F.col("__toxic") == 1).where(chance < positives / n_toxic).select("doc_id", F.lit(True).alias("__positive"))
    # Bounded: about ``positives`` ids.
    sample = texts.join(F.broadcast(toxic), "doc_id", "left").withColumn("__unlabelled", chance < unlabelled / n_texts)
    sample = sample.where("__positive OR __unlabelled").select(
        F.coalesce("__positive", F.lit(False)).alias("positive"), F.col("__unlabelled").alias("unlabelled"),
        F.pmod(F.xxhash64("doc_id", F.lit("bag")), F.lit(bags)).cast("int").alias("bag"), "text",
    )
    schema = pa.schema([("positive", pa.bool_()), ("unlabelled", pa.bool_()), ("bag", pa.int32()), ("features", pa.list_(pa.int32()))])

    def featurise(batches):
        memo = Known(word_features, FEW)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [
                    np.fromiter({f for w in distinct_words(t.as_py()) for f in memo[w]}, np.int32) for t in part.column("text")
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, schema.field(3).type)], schema=schema)

    spec = "positive boolean, unlabelled boolean, bag int, features array<int>"
    rows = written(sample.repartition(F.xxhash64("text")).mapInArrow(releasing(featurise), spec), "toxicity")
    got = rows.agg(F.sum(F.col("positive").cast("int")), F.sum(F.col("unlabelled").cast("int"))).first()
    n_p, n_u = (got[0] or 0), (got[1] or 0)
    if not n_p or not n_u:
        return Model()
    counted = rows.select("positive", "unlabelled", F.explode("features").alias("feature")).groupBy("feature")
    counted = counted.agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum(F.col("unlabelled").cast("int")).alias("u"))
    share_p, share_u = F.col("p") / n_p, F.col("u") / n_u
    # Unlabelled text holds positives in proportion to the prior; take them out.
    clean = F.greatest((share_u - prior * share_p) / (1 - prior), F.lit(0.0))
    spread = F.sqrt((clean * (1 - clean) + 1.0 / n_u) * (1.0 / n_p + 1.0 / n_u))
    gap = (share_p - clean) / spread
    chosen = counted.where("p >= 3").withColumn("gap", gap).where("gap > 4")
    chosen = [r["feature"] for r in chosen.orderBy(F.desc("gap"), "feature").limit(features).collect()]
    if not chosen:
        return Model({}, math.log(prior / (1 - prior)))
    places = {f: i for i, f in enumerate(chosen)}

    def narrow(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                kept = [[places[f] for f in found if f in places] for found in part.column("features").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(kept, schema.field(3).type)], schema=schema)

    few = rows.select("positive", "unlabelled", "bag", "features").mapInArrow(narrow, spec)
    bag_of = F.explode(F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(bags - 1))).otherwise(F.array("bag")))
    # A confirmed example that was also drawn as unlabelled counts as both, in its own bag.
    dealt = few.select("positive", "features", bag_of.alias("bag")).unionByName(
        few.where("positive AND unlabelled").select(F.lit(False).alias("positive"), "features", "bag")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        held = [(bool(p), np.asarray(found, np.int64)) for p, found in zip(group["positive"], group["features"], strict=True)]
        if all(p for p, _ in held):
            return pd.DataFrame({"weights": []})
        return pd.DataFrame({"weights": [train_bag(held, len(chosen), prior).tolist()]})

    fitted = dealt.groupBy("bag").applyInPandas(fit, "weights array<double>").collect()
    if not fitted:
        return Model({}, math.log(prior / (1 - prior)))
    mean = np.mean([r["weights"] for r in fitted], axis=0)
    return Model({f: float(mean[i]) for f, i in places.items()}, float(mean[-1]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 by their whole text alone."""
    weights, bias = model.weights, model.bias
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = shared.value
        # A word is looked at once in all batches of a partition.
        memo = Known(lambda word: [f for f in word_features(word) if f in weight] or None, MANY)
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                found: set[int] = set()
                for word in distinct_words(text.as_py()):
                    hit = memo[word]
                    if hit:
                        found.update(hit)
                total = bias + sum(weight[f] for f in sorted(found))
                out[i] = 0.0 if total == -math.inf else 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))
            yield pa.array(out)
        memo.clear()
        give_back()

    return docs.withColumn(name, scored(F.col("text").cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per document."""
    model = train(docs, labels, **bounds)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
