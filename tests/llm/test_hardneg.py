import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import hardneg

VECTORS = "vec_id bigint, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3, step=50):
    kept = []
    for vec_id, vector, label in rows:
        if vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        x = [math.floor(256 * c) for c in vector]
        if sum(c * c for c in x) < 2**62:
            kept.append((vec_id, x, label))
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % step:
            continue
        scored = [
            (-sum(p * q for p, q in zip(x, y)), i is None, i or 0, i, other)
            for b, (i, y, other) in enumerate(kept) if b != a and len(y) == len(x)
        ]
        scored.sort(key=lambda s: s[:3])
        for s in [s for s in scored if s[4] == label][:positives]:
            windowed = [t for t in scored if t[4] != label and 50 * -s[0] <= 100 * -t[0] <= 95 * -s[0]][:negatives]
            out += [(anchor, s[3], n + 1, t[3], -s[0], -t[0]) for n, t in enumerate(windowed)]
    return sorted(out, key=repr)


def mined(spark, rows, **how):
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "0 AS row", "'clash' AS x", "1 AS anchor", "2 AS score", "3 AS length")
    got = hardneg.mine(frame.repartition(4), F.col("label"), F.col("vec_id") % 50 == 0, **how)
    return sorted(map(tuple, got.collect()), key=repr)


def planted(n=900, dim=20, seed=2):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, dim))
    for i in range(0, n, 6):
        base[i + 1 : i + 5] = base[i] * draw.uniform(0.5, 1.1, (4, 1)) + draw.standard_normal((4, dim)) * 0.3
    base[100:140] = base[50]  # a crowd of equal vectors
    label = draw.integers(0, 4, n)
    label[: n // 3] = 7
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(base, label))]
    rows += [(1000, None, 1), (1050, [float("nan")] * dim, 1), (1100, [float("inf")] + [0.0] * (dim - 1), 1), (1150, [None] * dim, 1)]
    rows += [(1200, rows[3][1], None), (1250, [0.0] * dim, 2), (1300, [], 2), (1350, [], 3), (1301, [], 2), (1400, [1.0, 2.0], 1)]
    rows += [(1401, [1.0, 1.9], 1), (1402, [1.0, 1.0], 2), (50, rows[50][1], 7), (None, rows[50][1], 7), (None, rows[12][1], 1)]
    return rows + [(1500, [1e30] * dim, 1)]


@pytest.fixture(scope="module")
def rows():
    return planted()


def test_by_brute_force(spark, rows):
    wanted = brute(rows)
    assert len(wanted) > 100
    assert mined(spark, rows) == wanted


def test_other_windows(spark, rows):
    assert mined(spark, rows, positives=2, negatives=40) == brute(rows, 2, 40)


def test_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 9_000)
    few = rows[:200] + rows[-20:]
    assert mined(spark, few) == brute(few)


@pytest.mark.parametrize("part", [1, 7, 64])
def test_small_parts_fill_the_same_windows(monkeypatch, part):
    monkeypatch.setattr(hardneg, "PART", part)
    draw = np.random.default_rng(part)
    rows = draw.integers(-9, 9, (150, 12))
    rows[40:60] = rows[0]
    ids, own = draw.permutation(150), np.arange(20)
    low = draw.integers(-200, 300, (20, 3))
    high = low + draw.integers(-50, 400, (20, 3))
    low[::4], high[::4] = -hardneg.LAST, hardneg.LAST
    found = hardneg.threshold_join(rows[:20], rows, low, high, 4, lambda a, b: own[a][:, None] != b[None, :], ids)
    scores = rows[:20] @ rows.T
    for a in range(20):
        for w in range(3):
            fits = [x for x in range(150) if x != a and low[a, w] <= scores[a, x] <= high[a, w]]
            wanted = sorted(fits, key=lambda x: (-scores[a, x], ids[x]))[:4]
            at = np.flatnonzero(found.slot == a * 3 + w)
            assert found.place[at].tolist() == wanted and found.score[at].tolist() == scores[a, wanted].tolist()


def test_large_components_stay_exact(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.integers(-(2**20), 2**20, 6) * 1.5 + i / 7).tolist(), int(i % 2)) for i in range(120)]
    wanted = brute(rows)
    assert wanted and max(abs(r[4]) for r in wanted) > 2**53
    assert mined(spark, rows) == wanted


def test_one_label_few_rows_and_none(spark):
    same = [(i, [1.0, float(i)], 1) for i in range(120)]
    assert mined(spark, same) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]) == brute([(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]) != []
    assert mined(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_keeps_all_that_reach_the_threshold(seed):
    draw = np.random.default_rng(seed)
    rows = draw.integers(-50, 50, (300, 33)) * (draw.random((300, 33)) < 0.4)
    anchors = rows[:40]
    order = np.argsort(-(rows.astype(float) ** 2).sum(0))
    index = hardneg.Index(rows, order)
    turned = anchors[:, order]
    tails = hardneg.suffix_norms(turned, index.cuts)
    exact = anchors @ rows.T
    pruned = 0
    for share in (0.05, 0.3, 0.8):
        least = np.ceil(np.linalg.norm(anchors, axis=1) * np.linalg.norm(rows, axis=1).max() * share)
        kept = index.reaching(turned, tails, least)
        assert set(np.flatnonzero((exact >= least[:, None]).any(0))) <= set(kept.tolist())
        pruned += len(rows) - len(kept)
    assert pruned > 100
