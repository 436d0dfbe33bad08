import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import nearest, neardup_vectors
from ontoweave.llm.common import components
from ontoweave.llm.vectors import usable

VECTORS = "vec_id bigint, embedding array<float>"


def planted(n=600, dim=16, seed=1):
    """Unit vectors with groups of near copies, exact copies and every kind of unusable row."""
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, dim))
    for i in range(0, n, 10):
        base[i + 1 : i + 4] = base[i] + draw.standard_normal((3, dim)) * 0.05 * (1 + i % 4)
    base[n // 2 : n // 2 + 40] = base[0]  # one crowd of exact copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] + [1.0] * (dim - 1)), (1003, [float("inf")] * dim)]
    rows += [(1004, [None] + [1.0] * (dim - 1)), (1005, []), (1006, [1.0, 2.0]), (20, rows[20][1]), (20, rows[33][1]), (None, rows[40][1])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    made = spark.createDataFrame(planted(), VECTORS).repartition(4)
    return made.withColumns({"label": F.lit(1), "class": F.lit("clash"), "row": F.lit(0), "weight": F.lit(0)})


def valid(rows):
    return [
        (i, np.array(v, np.float64)) for i, v in rows
        if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)
    ]


def test_usable_rows(vectors):
    assert usable(vectors).count() == len(valid(planted())) + 1, "a vector of another length takes part as well"


def test_nearest_by_brute_force(vectors):
    kept = valid(planted())
    got = nearest.search(vectors, F.col("vec_id") % 20 == 0, k=7).collect()
    queries = [n for n, (i, _) in enumerate(kept) if i is not None and i % 20 == 0]
    wanted = []
    for q in queries:
        others = [((kept[q][1] * v).sum(), i) for n, (i, v) in enumerate(kept) if n != q]
        best = sorted(others, key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:7]
        wanted += [(kept[q][0], r + 1, i, s) for r, (s, i) in enumerate(best)]
    # Rows that repeat a vec_id are queries of their own, told apart by their results only.
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


def test_fewer_candidates_than_wanted(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [2.0, 1.0])]
    got = nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.5)]


@pytest.mark.parametrize("step", [3, 64, 4096])
def test_tiles_keep_every_neighbour(monkeypatch, step):
    monkeypatch.setattr(nearest, "STEP", step)
    draw = np.random.default_rng(step)
    rows = np.round(draw.standard_normal((200, 8)) * draw.choice([0.01, 1, 100], (200, 1)), 1)
    rows[(rows == 0).all(1)] = 1.0
    number = np.arange(200)
    ids = draw.permutation(200)
    a, b, scores = nearest.tile(rows[:30], number[:30], rows, number, ids, 9)
    for q in range(30):
        wanted = sorted(((-(rows[q] * rows[x]).sum(), ids[x]) for x in range(200) if x != q))[:9]
        order = np.lexsort((ids[b[a == q]], -scores[a == q]))
        assert [(-s, i) for s, i in zip(scores[a == q][order], ids[b[a == q]][order])] == wanted


def brute_links(kept):
    matrix = np.array([v for _, v in kept])
    norms = np.linalg.norm(matrix, axis=1)
    close = matrix @ matrix.T >= 0.95 * np.outer(norms, norms) - 1e-12
    np.fill_diagonal(close, False)
    return close


def reached(close):
    root = list(range(len(close)))
    for _ in range(len(close)):
        following = [min([root[i], *(root[j] for j in np.flatnonzero(close[i]))]) for i in range(len(close))]
        if following == root:
            return root
        root = following


def test_linked_vectors_by_brute_force(vectors):
    rows = planted()
    kept = valid(rows)
    close = brute_links(kept)
    root = reached(close)
    ids = {}
    for n, (i, _) in enumerate(kept):
        ids.setdefault(root[n], []).append(i)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    wanted = [(i, int(close[n].sum()), least[root[n]], i == least[root[n]]) for n, (i, _) in enumerate(kept)]
    unusable = len(rows) - len(kept)
    got = sorted(map(tuple, neardup_vectors.link_vectors(vectors).collect()), key=repr)
    assert [g for g in got if g[0] is None or g[0] < 1000] == sorted(wanted, key=repr)
    assert sum(g[0] is not None and g[0] >= 1000 and g[1] == 0 and g[2] == g[0] and g[3] for g in got) == unusable


def mixed_lengths():
    draw = np.random.default_rng(4)
    rows = []
    for dim, n in ((3, 60), (8, 90), (17, 50)):
        base = draw.standard_normal((n, dim))
        base[1::3] = base[0::3][: len(base[1::3])] * 3 + draw.standard_normal((len(base[1::3]), dim)) * 0.02
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(base)]
    return rows + [(500, [1e300] * 8), (501, [1e300] * 7 + [1.1e300]), (502, [1e-300] * 8), (503, [0.0] * 8)]


def test_vectors_of_several_lengths_meet_their_own_kind(spark):
    rows = mixed_lengths()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r for r in neardup_vectors.link_vectors(frame).collect()}
    assert len(got) == len(rows)
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows if any(v)}
    for i, v in unit.items():
        near = [j for j, w in unit.items() if j != i and len(w) == len(v) and v @ w >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i]["n_links"] == len(near), i
    searched = nearest.search(frame.where("vec_id < 500"), F.col("vec_id") % 20 == 0, k=4).collect()
    vectors = {i: np.array(v) for i, v in rows if i < 500}
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted((-(vectors[q] * w).sum(), j) for j, w in vectors.items() if j != q and len(w) == len(vectors[q]))[:4]
        assert [(r["score"], r["vec_id"]) for r in sorted((r for r in searched if r["query_id"] == q), key=lambda r: r["rank"])] == [(-s, j) for s, j in best]


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert nearest.search(none, F.lit(True)).collect() == [] and neardup_vectors.link_vectors(none).collect() == []


def test_setup_follows_the_size():
    small, large = (neardup_vectors.Projections.for_size(n, 64, 0.95) for n in (1000, 10**9))
    assert small.per_group < large.per_group and small.groups < large.groups
    near = neardup_vectors.same_cell(neardup_vectors.CELL)
    for setup in (small, large):
        assert (1 - near**setup.per_group) ** setup.groups <= neardup_vectors.LOSS * 1.001


@pytest.mark.parametrize("within", [True, False])
def test_a_crowd_counts_like_a_few(within):
    draw = np.random.default_rng(5)
    base = draw.standard_normal(64)
    rows = base + draw.standard_normal((300, 64)) * 0.12
    setup = neardup_vectors.Projections.for_size(300, 64, 0.95)
    left, right = (np.arange(300),) * 2 if within else (np.arange(100), np.arange(100, 300))
    found = set()
    for group in range(setup.groups):
        cells = setup.cells(rows / np.linalg.norm(rows, axis=1)[:, None])[:, group]
        for cell in np.unique(cells):
            at = np.flatnonzero(cells == cell)
            for x, y in neardup_vectors.links(rows, np.arange(300), at[np.isin(at, left)], at[np.isin(at, right)], group, within, setup, 0.95):
                pairs = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
                assert not pairs & found, "a pair counts once"
                found |= pairs
    close = brute_links(list(enumerate(rows)))
    wanted = {(i, j) for i, j in zip(*np.nonzero(np.triu(close, 1))) if within or (i < 100 <= j)}
    assert len(wanted) > 100 and len(wanted - found) <= 0.01 * len(wanted) and not found - wanted


def test_components_by_brute_force(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(500), draw.randrange(500)) for _ in range(300)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 300)] + [(5, 5), (1, 2), (2, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
