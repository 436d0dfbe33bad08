import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoweave.llm import neardup_text, setsketch
from ontoweave.llm.shingles import WordHashes, shingles

DOCS = "doc_id bigint, text string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(5))))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for found in holders.values() for a in found for b in found if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min((d for d in groups[find(i)] if d is not None), default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def planted(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(60):
        base = [word() for _ in range(draw.randrange(5, 250))]
        if draw.random() < 0.5:
            base[:0] = passage  # shared, but not enough to be a copy
        rows.append(base)
        for _ in range(draw.randrange(0, 6)):
            copy = list(base)
            for _ in range(draw.randrange(0, max(1, len(base) // 25))):
                copy[draw.randrange(len(copy))] = word()
            rows.append(copy)
    # A crowd of near copies of one text, which are less alike among themselves.
    base = [word() for _ in range(200)]
    for _ in range(150):
        copy = list(base)
        for _ in range(draw.randrange(1, 7)):
            copy[draw.randrange(200)] = word()
        rows.append(copy)
    rows += [base] * 40
    draw.shuffle(rows)
    texts = [(i * 3, " ".join(r)) for i, r in enumerate(rows)]
    texts += [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one\x0btwo"), (9006, "one  TWO\r\n"), (9007, "one two three")]
    texts += [(9008, "É a b c d"), (9009, "é a b c d"), (None, texts[4][1]), (None, "alone without id"), texts[7], (texts[9][0], "another text under the same id")]
    return texts


def test_by_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS).repartition(6).withColumns({"class": F.lit("clash"), "label": F.lit(1), "n": F.lit(2)})
    got = neardup_text.link_documents(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == [(*w[:3], w[3] if w[0] is not None or w[2] is not None else True) for w in brute(rows)]


def test_no_documents(spark):
    assert neardup_text.link_documents(spark.createDataFrame([], DOCS)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert sorted(tuple(r)[:4] for r in neardup_text.link_documents(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_shingles_are_sets_of_words():
    known = WordHashes()
    assert len(shingles("a b c d e f", known)) == 2 and len(shingles("a b c d e " * 10, known)) == 5
    assert shingles("A  B\tC", known).tolist() == shingles("a b c", known).tolist()
    assert shingles("a b", known).tolist() != shingles("b a", known).tolist()
    assert len(shingles("x" * 100_000, known)) == 1 and len(shingles(None, known)) == 0


def test_registers_are_mergeable_and_estimate():
    draw = np.random.default_rng(1)
    for size, share in [(400, 0.9), (3000, 0.75), (60, 0.5), (100_000, 0.3)]:
        whole = draw.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64)
        common = int(size * 2 * share / (1 + share))
        a, b = whole, np.concatenate([whole[:common], draw.integers(0, 1 << 63, size - common, dtype=np.int64).astype(np.uint64)])
        left, right, both = setsketch.sketch([a, b, np.concatenate([a, b])])
        assert (np.maximum(left, right) == both).all(), "the sketch of a union"
        assert abs((left == right).mean() - share) < 0.15
    sizes = np.array([size, size])
    assert not setsketch.likely(left[None], right[None], sizes[:1], sizes[:1], 0.75)[0]


def test_likelihood_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(7)
    size, lost, kept_low = 140, 0, 0
    for share, wanted in [(0.75, True), (0.35, False)]:
        sets = []
        common = round(size * 2 * share / (1 + share))
        for _ in range(150):
            made = draw.integers(0, 1 << 63, 2 * size - common, dtype=np.int64).astype(np.uint64)
            sets += [made[:size], np.concatenate([made[:common], made[size:]])]
        rows = setsketch.sketch(sets)
        n = np.full(150, size)
        found = setsketch.likely(rows[::2], rows[1::2], n, n, 0.75)
        if wanted:
            lost = int((~found).sum())
            bands = (rows[::2] == rows[1::2]).reshape(150, -1, setsketch.ROWS).all(2)
            assert bands.any(1).all()
        else:
            kept_low = int(found.sum())
    assert lost == 0 and kept_low < 5


def test_sizes_rule_pairs_out():
    rows = setsketch.sketch([np.arange(100, dtype=np.uint64) << np.uint64(32), np.arange(60, dtype=np.uint64) << np.uint64(32)])
    assert not setsketch.likely(rows[:1], rows[1:], np.array([100]), np.array([60]), 0.75)[0]


@pytest.mark.parametrize("text", ["a b c d e", "x"])
def test_one_crowd_of_equal_texts_is_one_class(spark, text):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    got = neardup_text.link_documents(docs).agg(F.min("component_id"), F.max("component_id"), F.count_if("kept")).first()
    assert tuple(got) == (0, 0, 1)


def test_one_row_of_each_group_stays(spark):
    text = lambda name, last="end": " ".join([f"{name}{i}" for i in range(60)] + [last])
    rows = [(None, text("a")), (None, text("a", "other")), (None, text("a"))]  # a group without any id
    rows += [(5, text("b")), (5, text("c")), (3, text("c", "other")), (None, text("c"))]  # an id with two texts
    rows += [(8, text("d")), (8, text("d", "other")), (8, text("d"))]  # near copies under one id
    rows += [(None, ""), (None, ""), (9, None), (9, None)]  # linked with nothing
    for made in (rows, planted(3) + rows):
        docs = spark.createDataFrame(made, DOCS).withColumn("n_chars", F.lit(1)).repartition(3)
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert out.columns == docs.columns
        groups = {}
        for n, _, group, _ in brute([(n, t) for n, (_, t) in enumerate(made)]):
            groups.setdefault(group, []).append((made[n][0] is None, made[n][0] or 0, n))
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert set(got) <= set(made)
        assert sorted(repr(i) for i, _ in got) == sorted(repr(made[min(g)[2]][0]) for g in groups.values())
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sum((r["text"] or "").startswith("a0 ") for r in got) == 1 and (3, text("c", "other")) in [tuple(r) for r in got]
