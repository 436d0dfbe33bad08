"""Operators on data where one key holds most rows, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoweave.operators import entities as E
from ontoweave.operators import feeds as D
from ontoweave.operators import graph as G
from ontoweave.operators import objects as O
from ontoweave.operators import overlap as V
from ontoweave.operators import profile as P
from ontoweave.operators import validate as R
from ontoweave.operators.entities import RelationshipDef, TypeDef
from ontoweave.plans import nodes


@pytest.fixture
def skewed():
    """``(id, key, n)`` rows of which most share one key and some have none."""
    rng = random.Random(3)
    pick = lambda: "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "B ", "", None, "c"])
    return [(i, pick(), rng.randrange(5)) for i in range(600)]


SCHEMA = "id int, key string, n int"


def test_profile(frame, skewed):
    got = P.facts_by_name(P.profile_columns(frame(skewed, SCHEMA).repartition(6)))
    for c, name in enumerate(["id", "key", "n"]):
        values = [r[c] for r in skewed]
        assert got[name]["nulls"] == values.count(None)
        assert got[name]["distinct"] == len(set(values) - {None})
    pairs = [r[1:] for r in skewed]
    doubled = P.duplicate_rows(frame(pairs, "key string, n int")).first()
    assert doubled["duplicate_rows"] == len(pairs) - len(set(pairs))


def test_deduplication(frame, skewed):
    least = {}
    for r in sorted(skewed, key=lambda r: r[0]):
        least.setdefault(r[1], r)
    got = nodes.deduplicate(frame(skewed, SCHEMA).repartition(6), {"keys": ["key"]})
    assert rows(got) == sorted(least.values(), key=repr)


def test_overlap(frame, skewed):
    other = [(i, v) for i, v in enumerate(["hot", "HOT", " b", "zzz", "a", "a", None])]
    tables = {"x": frame(skewed, SCHEMA), "y": frame(other, "id int, key string")}
    meta = [
        {"i": 0, "d": 0, "dataset": "x", "column": "key", "field": None, "integer": False, "stem": "k"},
        {"i": 1, "d": 1, "dataset": "y", "column": "key", "field": None, "integer": False, "stem": "q"},
        {"i": 2, "d": 0, "dataset": "x", "column": "n", "field": None, "integer": True, "stem": "num"},
        {"i": 3, "d": 1, "dataset": "y", "column": "id", "field": None, "integer": True, "stem": "number"},
    ]
    got = {(r["a"], r["b"]): r for r in V.key_overlap(tables, meta, {(2, 1)}).collect()}
    held = {
        0: Counter(r[1] for r in skewed if r[1]), 1: Counter(r[1] for r in other if r[1]),
        2: Counter(str(r[2]) for r in skewed), 3: Counter(str(r[0]) for r in other),
    }

    def folded(counts):
        out = Counter()
        for v, n in counts.items():
            out[v.strip().lower()] += n
        return out

    for a, b in [(0, 1), (1, 0), (2, 3), (3, 2)]:
        ea, eb, fa, fb = held[a], held[b], folded(held[a]), folded(held[b])
        row = got[a, b]
        assert row["m_exact"] == len(ea.keys() & eb.keys()) and row["m_ci"] == len(fa.keys() & fb.keys())
        assert row["a_rows_exact"] == sum(ea[v] for v in ea.keys() & eb.keys())
        assert row["a_rows_ci"] == sum(fa[v] for v in fa.keys() & fb.keys())
        assert (row["a_distinct"], row["a_distinct_ci"], row["a_rows"]) == (len(ea), len(fa), sum(ea.values()))
    # A text pairs with an integer only under one noun, or where it is declared.
    assert set(got) <= {(0, 1), (1, 0), (2, 3), (3, 2)}


def test_overlap_counts_a_value_once_however_a_column_spells_it(frame):
    left = [("Ab",), ("aB",), (" ab",), ("AB",), ("c",)]
    right = [("ab",), ("AB",), ("AB ",), ("C",), ("c",), ("c",)]
    tables = {"x": frame(left, "k string"), "y": frame(right, "k string")}
    meta = [
        {"i": 7, "d": 0, "dataset": "x", "column": "k", "field": None, "integer": False, "stem": "k"},
        {"i": 3, "d": 1, "dataset": "y", "column": "k", "field": None, "integer": False, "stem": "k"},
    ]
    got = {(r["a"], r["b"]): r.asDict() for r in V.key_overlap(tables, meta).collect()}
    names = ("m_exact", "m_ci", "a_rows_exact", "a_rows_ci", "a_distinct", "a_distinct_ci", "a_rows")
    assert [got[7, 3][n] for n in names] == [2, 2, 2, 5, 5, 2, 5]
    assert [got[3, 7][n] for n in names] == [2, 2, 3, 6, 5, 2, 6]


def test_coverage_and_uniqueness(frame, skewed):
    targets = [(i, k) for i, k in enumerate(["hot"] * 50 + ["a", None, "zzz"])]
    got = R.relationship_coverage(
        frame(skewed, SCHEMA), frame(targets, "id int, key string"), "id", "id", "key", "key"
    ).first()
    held = Counter(k for _, k in targets if k)
    assert got.asDict() == {
        "total": len(skewed),
        "matched": sum(held[r[1]] > 0 for r in skewed if r[1]),
        "pairs": sum(held[r[1]] for r in skewed if r[1]),
    }
    assert not E.one_row_per_entity(frame(skewed, SCHEMA), "key").first()["ok"]


def test_two_hops(frame, skewed):
    via = [("hot", "1"), ("hot", "2"), ("a", "3"), (None, "4"), ("b", None)]
    path = {
        "k": 0, "from": "x", "direct": "n", "first": "key", "via_dataset": "y", "via_key": "key",
        "via_column": "v", "fold_hop": False, "fold_end": False,
    }
    got = V.two_hop_agreement({"x": frame(skewed, SCHEMA), "y": frame(via, "key string, v string")}, [path]).first()
    n = agree = 0
    for _, key, direct in skewed:
        found = [v for k, v in via if k is not None and k == key] or [None]
        n += len(found)
        agree += sum(v == str(direct) for v in found)
    assert (got["n"], got["agree"]) == (n, agree)


def test_relations_and_links(frame, skewed):
    targets = [("hot", 1), ("a", 2), ("c", 3)]
    a, b = TypeDef("Item", "x", "id", ("id",)), TypeDef("Kind", "y", "key", ("key",))
    made = O.relations(
        frame(skewed, SCHEMA), frame(targets, "key string, w int"), a, b, RelationshipDef("is", "Item", "Kind", "key", "key"), "g"
    )
    links = Counter(r["links"] for r in O.link_counts(made).collect())
    held = Counter(r[1] for r in skewed if r[1] in {"hot", "a", "c"})
    assert made.count() == sum(held.values())
    assert links == Counter(held.values()) + Counter({1: sum(held.values())})


def test_a_hub_with_most_relations(frame):
    edges = [("hub", f"n{i:04}") for i in range(2000)] + [("n0000", "far"), ("far", "farther")]
    relations = frame([("g", "to", a, b) for a, b in edges], O.RELATION).repartition(5)
    ids = {x for e in edges for x in e}
    top, between = G.top_graph(frame([(i,) for i in ids], "id string"), relations, 2)
    assert rows(top, "id", "degree") == [("far", 2), ("hub", 2000)] and between.isEmpty()
    reached = G.k_hop(relations, "hub", 3, 3000)
    assert Counter(r["hops"] for r in reached.collect()) == {0: 1, 1: 2000, 2: 1, 3: 1}
    assert G.k_hop(relations, "far", 2, 10).count() == 4


def test_latest_of_a_hot_key(frame, skewed):
    made = [(str(i), key, n) for i, key, n in skewed]
    got = {r["key"]: r["id"] for r in D.latest(frame(made, "id string, key string, updated_at int"), "key").collect()}
    newest = defaultdict(tuple)
    for i, key, n in made:
        if key is not None:
            newest[key] = max(newest[key], (n, i))
    assert got == {k: i for k, (_, i) in newest.items()}


PAGES = [(0, 5), (37, 11), (299, 7), (590, 50), (700, 5)]


@pytest.mark.parametrize("offset, limit, few", [(*PAGES[0], 0), (*PAGES[1], 0), (*PAGES[2], 20), (*PAGES[3], 10_000), (*PAGES[4], 0)])
def test_deep_pages(frame, skewed, monkeypatch, offset, limit, few):
    from ontoweave.plans import ordered

    df = frame(skewed, SCHEMA).repartition(5)
    shallow = [tuple(r) for r in P.page(df, ["key", "n"], offset, limit).collect()]
    monkeypatch.setattr(ordered, "SHALLOW", 0)
    monkeypatch.setattr(ordered, "FEW", few)
    assert [tuple(r) for r in P.page(df, ["key", "n"], offset, limit).collect()] == shallow
    newest = [ordered.Key(F.col("n"), True), ordered.Key(F.col("id"), True)]
    deep = [r["id"] for r in ordered.page_of(df, newest, offset, limit).collect()]
    assert deep == [r[0] for r in sorted(skewed, key=lambda r: (-r[2], -r[0]))][offset : offset + limit]


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_of_every_kind_of_key(spark, frame, monkeypatch, descending):
    from ontoweave.plans import ordered

    texts = [None, "", "a", "ab", "abc", "abcd", "abd", "b\x00", "b", "é", "\ud7ff", "\uffff", "\U0010ffff", "\U0010ffffz", "same" * 4]
    made = [
        (t, None if i % 7 == 0 else float("nan") if i % 11 == 0 else (i * 37 % 50) / 4, i % 3 == 0 if i % 5 else None, [i % 4], i)
        for i, t in enumerate(t for t in texts for _ in range(9))
    ]
    df = frame(made, "t string, x double, b boolean, a array<int>, i int").repartition(4)
    orders = (["t", "x", "i"], ["x", "t", "i"], ["b", "x", "t", "i"], ["a", "t", "i"], ["b", "t"])
    for names in orders:
        keys = [ordered.Key(F.col(n), descending) for n in names]
        monkeypatch.setattr(ordered, "SHALLOW", 100_000)
        whole = [tuple(str(r[n]) for n in names) for r in ordered.page_of(df, keys, 0, 1000).collect()]
        monkeypatch.setattr(ordered, "SHALLOW", 3)
        monkeypatch.setattr(ordered, "FEW", 6)
        for offset, limit in ((10, 20), (40, 3), (100, 60)):
            got = [tuple(str(r[n]) for n in names) for r in ordered.page_of(df, keys, offset, limit).collect()]
            assert got == whole[offset : offset + limit], (names, offset)


def test_a_deep_page_writes_nothing_and_filters_the_scan(spark, tmp_path, monkeypatch):
    from ontoweave.plans import ordered

    path = str(tmp_path / "rows")
    spark.range(200_000).selectExpr("id", "concat('k', lpad(id, 7, '0')) AS t").write.parquet(path)
    monkeypatch.setattr(ordered, "cut", None)
    for key in ("id", "t"):
        page = ordered.page_of(spark.read.parquet(path), [key], 150_000, 5)
        assert [r["id"] for r in page.collect()] == list(range(150_000, 150_005))
        plan = page._jdf.queryExecution().toString()
        bounds = plan.split("PushedFilters")[1]
        assert f"GreaterThanOrEqual({key}," in bounds or f"EqualTo({key}," in bounds


values = st.one_of(st.none(), st.sampled_from(["a", "A", " a", "", "b"]))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), values), min_size=1, max_size=12))
def test_any_small_table_profiles_as_sets_say(spark, made):
    from ontoweave.functions.local import local_frame

    df = local_frame(spark, made, "n int, s string")
    got = P.facts_by_name(P.profile_columns(df))
    texts = [s for _, s in made]
    assert (got["s"]["nulls"], got["s"]["distinct"]) == (texts.count(None), len(set(texts) - {None}))
    assert got["n"]["primary_key"] == (len({n for n, _ in made}) == len(made))
    whole = P.profile(df)
    assert whole["duplicate_rows"] == len(made) - len(set(made))
    assert whole["fingerprint"] == P.fingerprint(local_frame(spark, made[::-1], "n int, s string")).first()["fingerprint"]
