import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import toxicity

LABELS = "doc_id bigint, toxic int"


def corpus(n=1500, seed=1):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("aeiouklmnrst") for _ in range(draw.randrange(2, 8))) for _ in range(400)]
    stems = ["grumpf", "zwackel", "vexxo"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randrange(5, 120))]
        toxic = draw.random() < 0.15
        if toxic:
            for _ in range(draw.randrange(1, 5)):
                words.insert(draw.randrange(len(words)), draw.choice(stems) + draw.choice(["", "en", "ista,", "o!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    extra = [(None, rows[0][1]), (5000, None), (5001, ""), (5002, "wörd " * 60_000), (5003, " \n"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string").repartition(4)
    noisy = labels + [(None, 1), (9, None), (labels[3][0], labels[3][1]), (99_999, 1)]
    return docs.withColumns({"score": F.lit("clash"), "toxic": F.lit(1), "bag": F.lit(3)}), spark.createDataFrame(noisy, LABELS), dict(labels)


def test_held_out_documents(tables):
    docs, labels, truth = tables
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count()
    hits, false, n_clean, n_toxic = 0, 0, 0, 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            n_toxic += truth[r["doc_id"]]
            n_clean += 1 - truth[r["doc_id"]]
            hits += truth[r["doc_id"]] * r["predicted"]
            false += (1 - truth[r["doc_id"]]) * r["predicted"]
    assert hits >= 0.95 * n_toxic > 20 and false <= 0.03 * n_clean
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got if r["doc_id"] not in (None, 7))


def test_labels_of_the_held_out_fold_change_nothing(tables):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert one.weights.keys() == other.weights.keys()
    assert np.allclose([one.weights[k] for k in one.weights], [other.weights[k] for k in one.weights], atol=1e-6)


def test_without_confirmed_examples(spark, tables):
    docs, labels, _ = tables
    none = labels.where("toxic = 0")
    for missing in (none, labels.limit(0)):
        got = toxicity.score_documents(docs, missing).agg(F.max("score"), F.max("predicted")).first()
        assert tuple(got) == (0.0, 0)
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_the_risk_stays_above_zero():
    draw = np.random.default_rng(1)
    # A third of the unlabelled rows are positives in disguise.
    plus = [(True, np.array([0, draw.integers(1, 5)])) for _ in range(60)]
    rest = [(False, np.array([0, 1]) if i % 3 == 0 else draw.integers(5, 9, 2)) for i in range(300)]
    weights = toxicity.train_bag(plus + rest, 9, 1 / 3)
    score = lambda found: weights[-1] + weights[list(found)].sum()
    assert np.isfinite(weights).all() and score({0, 1}) > 0 > score({6, 7})


def test_features_of_odd_words():
    assert toxicity.word_features(b"...") == [] and toxicity.word_features(b"") == []
    assert set(toxicity.word_features(b"'Word'")) == set(toxicity.word_features(b"Word"))
    assert len(toxicity.word_features("é".encode() * 5000)) > 0
