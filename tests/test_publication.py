import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ontoweave.functions.hashing import digest
from ontoweave.operators import edits as X
from ontoweave.operators import graph as G
from ontoweave.operators import objects as O
from ontoweave.operators import validate as V
from ontoweave.operators.entities import ActionDef, Bundle, RelationshipDef, TypeDef

CUSTOMER = TypeDef("Customer", "customers", "id", ("id", "region", "email"))
ORDER = TypeDef("Order", "orders", "id", ("id", "customer", "amount", "status"))
PLACED = RelationshipDef("placed by", "Order", "Customer", "customer", "id")
BUNDLE = Bundle("Shop", types=(CUSTOMER, ORDER), relationships=(PLACED,))


def logical(type_name, key):
    return digest(digest(type_name)[:20] + ":" + str(key))[:32]


@pytest.fixture
def tables(frame):
    return {
        "customers": frame([("A", "EU", "a@example.com"), ("B", "NA", "b@example.com")], "id string, region string, email string"),
        "orders": frame(
            [(1, "A", 10, "delayed"), (2, "A", 20, "delivered"), (3, "B", 5, "delivered")],
            "id int, customer string, amount int, status string",
        ),
    }


@pytest.fixture
def store(spark, tmp_path):
    return O.Graph(spark, str(tmp_path / "graph"))


def test_bundle_checks(tables):
    report = {c.name: c for c in V.validate_bundle(tables, {}, BUNDLE)}
    assert report["placed by"].detail == "3/3 source objects matched; many-to-one; 3 relationship pairs"
    assert report["Order"].detail == "3 objects; unique non-null key"
    bad = Bundle(
        "", types=(TypeDef("Order", "orders", "nope", ()), TypeDef("Buyer", "orders", "customer", ()), CUSTOMER, CUSTOMER),
        relationships=(RelationshipDef("x", "Order", "Gone", "a", "b"), RelationshipDef("y", "Buyer", "Customer", "zip", "id")),
        actions=(ActionDef("key", "Customer", ("id",)), ActionDef("gone", "Gone", ("x",))),
    )
    failed = {c.name: c.detail for c in V.validate_bundle(tables, {}, bad) if not c.passed}
    assert failed["Order"] == "Unknown property nope"
    assert failed["Buyer"] == "Primary key must be unique and non-null"
    assert failed["x"].startswith("Unknown object type in Order → Gone")
    assert failed["y"] == "Unknown relationship column"
    assert set(failed) == {"Definition identities", "Order", "Buyer", "x", "y", "key", "gone"}


def test_publication(store, tables):
    generation = store.publish(BUNDLE, tables, versions={"orders": "v1"}, actor="ada")
    assert store.active() == generation
    objects, relations = store.objects(), store.relations()
    assert (objects.count(), relations.count()) == (5, 3)
    order = objects.where("type = 'Order' AND key = '1'").first()
    assert order["logical_id"] == logical("Order", 1) and order["id"] == f"{generation}_{logical('Order', 1)}"
    assert order["base"] == {"id": "1", "customer": "A", "amount": "10", "status": "delayed"}
    assert order["source_version"] == "v1"
    ends = objects.select("id")
    for end in ("from_id", "to_id"):
        assert relations.join(ends, F.col(end) == F.col("id"), "left_anti").count() == 0


def test_a_generation_appears_at_once(store, tables):
    store.publish(BUNDLE, tables, generation="g1")
    # Rows without a pointer are not seen.
    O.objects(tables["orders"], ORDER, "g2").drop("generation").write.parquet(f"{store.root}/objects/generation=g2")
    assert store.active() == "g1" and store.objects().count() == 5
    assert O.visible(store._table("objects", O.OBJECT), "g1").count() == 5


def test_guards(store, tables):
    first = store.publish(BUNDLE, tables, generation="g1")
    with pytest.raises(O.PublicationRefused, match="Published definitions changed"):
        store.publish(BUNDLE, tables)
    with pytest.raises(O.PublicationRefused, match="Input data changed"):
        store.publish(BUNDLE, tables, base=first, recorded={"orders": "v1"}, versions={"orders": "v2"})
    with pytest.raises(O.PublicationRefused, match="Definitions changed"):
        store.publish(BUNDLE, tables, base=first, expected_hash="other")
    assert store.active() == "g1"


def test_rollback(store, tables):
    check = lambda b: V.validate_bundle(tables, {}, b)
    with pytest.raises(O.PublicationRefused, match="No previous"):
        store.rollback({}, tables, check)
    fewer = Bundle("", types=(CUSTOMER,))
    store.publish(BUNDLE, tables, generation="g1")
    store.publish(fewer, tables, base="g1", generation="g2")
    assert store.objects().count() == 2
    bundles = {O.bundle_hash(b): b for b in (BUNDLE, fewer)}
    with pytest.raises(O.PublicationRefused, match="unavailable"):
        store.rollback({}, tables, check)
    store.rollback(bundles, tables, check, generation="g3")
    assert (store.active(), store.objects().count(), store.relations().count()) == ("g3", 5, 3)
    broken = {**tables, "orders": tables["orders"].withColumnRenamed("customer", "buyer")}
    store.publish(fewer, tables, base="g3", generation="g4")
    with pytest.raises(O.PublicationRefused, match="no longer validate"):
        store.rollback(bundles, broken, lambda b: V.validate_bundle(broken, {}, b))


def test_edits_survive_publication(store, tables, frame):
    manual = X.manual_from(frame([("C", "EU"), ("A", "XX")], "id string, region string"), CUSTOMER)
    relation_edits = frame(
        [
            (logical("Order", 1), logical("Customer", "C"), "Escalated to", True),
            (logical("Order", 2), logical("Customer", "A"), "placed by", False),
            (logical("Order", 3), logical("Customer", "gone"), "Escalated to", True),
        ],
        X.RELATION_EDIT,
    )
    for generation, base in (("g1", None), ("g2", "g1")):
        store.publish(BUNDLE, tables, base=base, generation=generation, manual=manual, relation_edits=relation_edits)
        people = store.objects().where("type = 'Customer'")
        assert rows(people, "key", "manual") == [("A", False), ("B", False), ("C", True)]
        assert people.where("key = 'A'").first()["base"]["region"] == "EU", "the source has this key now"
        assert rows(store.relations(), "name", "from_id", "to_id") == sorted(
            [
                ("Escalated to", f"{generation}_{logical('Order', 1)}", f"{generation}_{logical('Customer', 'C')}"),
                ("placed by", f"{generation}_{logical('Order', 1)}", f"{generation}_{logical('Customer', 'A')}"),
                ("placed by", f"{generation}_{logical('Order', 3)}", f"{generation}_{logical('Customer', 'B')}"),
            ],
            key=repr,
        )
    with pytest.raises(ValueError, match="Unknown object property"):
        X.manual_from(frame([("C", 1)], "id string, nope int"), CUSTOMER)


@pytest.fixture
def objects(tables):
    return O.objects(tables["customers"], CUSTOMER, "g1").unionByName(O.objects(tables["orders"], ORDER, "g1"))


def test_effective_values(objects, frame):
    overlays = frame([(logical("Customer", "A"), {"region": "UK", "email": None, "note": "x"}, 3)], X.OVERLAY)
    got = {r["key"]: r for r in X.effective_records(objects, overlays).where("type = 'Customer'").collect()}
    assert got["A"]["effective"] == {"id": "A", "region": "UK", "email": None, "note": "x"}
    assert (got["A"]["revision"], got["B"]["revision"]) == (3, 0)
    assert got["B"]["effective"] == got["B"]["base"]
    wanted = frame([(logical("Customer", "A"), {"region": "FR"})], "logical_id string, values map<string,string>")
    shown = X.preview_edits(objects, overlays, wanted).first()
    assert (shown["before"]["region"], shown["after"]["region"], shown["after"]["note"]) == ("UK", "FR", "x")


def edit(n, key, values, revision=0, idempotency=None, revert=False, at=1, type_name="Customer"):
    return (
        f"e{n}", logical(type_name, key), values, revision, idempotency or f"request-{n}", revert, "ada",
        dt.datetime(2024, 1, at, tzinfo=dt.timezone.utc),
    )


DONE = "idempotency_key string, request_hash string"


def test_edit_batches(objects, tables, frame):
    overlays = frame([(logical("Customer", "B"), {"region": "UK"}, 2)], X.OVERLAY)
    batch = frame(
        [
            edit(1, "A", {"region": "FR"}, at=2),
            edit(2, "A", {"region": "DE"}, at=1),  # earlier, so it wins
            edit(3, "B", {"email": "x"}, revision=2),
            edit(4, "1", {"amount": "a lot"}, type_name="Order"),
            edit(5, "2", {"id": "9"}, type_name="Order"),
            edit(6, "3", {"amount": "7"}, revision=4, type_name="Order"),
            edit(7, "zzz", {"region": "x"}),
            edit(8, "B", {"email": "x"}, revision=2, idempotency="request-3"),  # the same request again
            edit(9, "B", {"email": "y"}, revision=2, idempotency="request-3"),
        ],
        X.EDIT,
    )
    kinds = {"Customer": X.value_kinds(tables["customers"]), "Order": X.value_kinds(tables["orders"])}
    types = [CUSTOMER, ORDER]
    written, refused, audit = X.apply_edits(objects, overlays, batch, types, frame([], DONE), kinds)
    got = {r["logical_id"]: (r["values"], r["revision"]) for r in written.collect()}
    assert got == {
        logical("Customer", "A"): ({"region": "DE"}, 1),
        logical("Customer", "B"): ({"region": "UK", "email": "x"}, 3),
    }
    assert rows(refused, "edit_id", "reason") == [
        ("e1", "Object was edited; refresh the preview"),
        ("e4", "Invalid type for a field"),
        ("e5", "Invalid editable field"),
        ("e6", "Object was edited; refresh the preview"),
        ("e7", "Object unavailable"),
        ("e9", "Idempotency key reused for different action"),
    ]
    entries = {r["logical_id"]: r for r in audit.collect()}
    assert entries[logical("Customer", "B")]["before"]["region"] == "UK"
    assert entries[logical("Customer", "B")]["id"] == "action_" + digest("request-3")
    # The applied requests again change nothing; another under their key is refused.
    done = audit.select("idempotency_key", "request_hash")
    again = frame([edit(3, "B", {"email": "x"}, revision=2), edit(2, "A", {"region": "ES"}, at=1)], X.EDIT)
    after, refused, audit = X.apply_edits(objects, written, again, types, done, kinds)
    assert {r["logical_id"]: (r["values"], r["revision"]) for r in after.collect()} == got
    assert rows(refused, "edit_id", "reason") == [("e2", "Idempotency key reused for different action")]
    assert audit.isEmpty()


def test_reverting_clears_edits(objects, frame):
    overlays = frame([(logical("Customer", "A"), {"region": "UK"}, 1)], X.OVERLAY)
    batch = frame([edit(1, "A", {}, revision=1, revert=True)], X.EDIT)
    written, _, _ = X.apply_edits(objects, overlays, batch, [CUSTOMER], frame([], DONE))
    assert [(r["values"], r["revision"]) for r in written.collect()] == [({}, 2)]


def test_nulls_are_edits(objects, frame):
    batch = frame([edit(1, "A", {"region": None})], X.EDIT)
    written, refused, _ = X.apply_edits(objects, frame([], X.OVERLAY), batch, [CUSTOMER], frame([], DONE))
    assert refused.isEmpty() and written.first()["values"] == {"region": None}


# Labels and the graph.


@pytest.mark.parametrize(
    "type_name, key, values, label",
    [
        ("User", "usr_1", {"workos_first_name": "Omar", "workos_last_name": "Walsh", "email": "omar@x.example"}, "Omar Walsh"),
        ("User", "usr_2", {"first_name": "Omar", "name": "Other"}, "Omar"),
        ("Account", "acct_1", {"name": "Marigold", "plan": "x"}, "Marigold"),
        ("Account", "acct_2", {"plan_name": "Gold", "company": "Firm"}, "Firm"),
        ("Account", "acct_3", {"name": " ", "plan_name": "Gold"}, "Gold"),
        ("Account", "acct_4", {"E-mail": "a@b.c"}, "a@b.c"),
        ("Support ticket", "4101", {"requester_email": "someone@x.example", "name": "None"}, "Support ticket 4101"),
        ("Invoice", "in_1aFTyPqAEQQCd1LrWgyIgIyF", {}, "Invoice in_1aFTyPqAE…"),
        ("Note", "n1", {"title": "x" * 100}, "x" * 80),
    ],
)
def test_labels(frame, type_name, key, values, label):
    df = frame([(type_name, key, values)], "type string, key string, base map<string,string>")
    got = O.record_label(F.col("type"), F.col("key"), F.col("base"), list(values))
    assert df.select(got.alias("label")).first()["label"] == label


@pytest.fixture
def star(frame):
    """A hub ``h`` with spokes, a chain behind one of them, and a record on its own."""
    edges = [("h", f"s{i}") for i in range(5)] + [("s0", "t0"), ("t0", "u0"), ("u0", "v0"), ("x", "gone")]
    ids = ["h", *[f"s{i}" for i in range(5)], "t0", "u0", "v0", "x", "lone"]
    relations = frame([("g1", "to", a, b) for a, b in edges], O.RELATION)
    objects = frame([(i, "T", i) for i in ids], "id string, type string, label string")
    return objects, relations


def test_best_connected(star):
    nodes, edges = G.top_graph(*star, limit=3)
    assert [(r["id"], r["degree"]) for r in nodes.collect()] == [("h", 5), ("s0", 2), ("t0", 2)]
    assert rows(edges, "from_id", "to_id") == [("h", "s0"), ("s0", "t0")]
    linked = star[1].where("to_id <> 'gone'")
    assert rows(G.top_graph(star[0], linked, 3, published=True)[0], "id", "degree") == rows(nodes, "id", "degree")
    every, _ = G.top_graph(*star, limit=100)
    assert every.count() == 11


def test_neighbourhoods(star):
    hops = lambda *a: rows(G.k_hop(star[1], *a), "id", "hops")
    assert hops("h", 1) == [("h", 0), *[(f"s{i}", 1) for i in range(5)]]
    assert ("t0", 2) in hops("h", 2) and ("u0", 3) in hops("h", 3) and ("v0", 4) in hops("h", 9)
    assert hops("h", 3, 3) == [("h", 0), ("s0", 1), ("s1", 1)], "the cap keeps the nearest, in order of id"
    assert hops("u0", 1) == [("t0", 1), ("u0", 0), ("v0", 1)]
    nodes, edges = G.neighborhood(*star, "x", 1)
    assert rows(nodes, "id") == [("x",)] and edges.isEmpty(), "a link to a record that is gone is no link"


def test_neighbors(star, frame):
    got = G.neighbors(star[1], frame([("s0",), ("lone",)], "id string"))
    assert rows(got) == [("s0", "h"), ("s0", "t0")]


def records(frame, values):
    made = [(f"g1_{i:02}", f"T {v}", "T", {"v": v}, f"L{i}") for i, v in enumerate(values)]
    return frame(made, "id string, name string, type string, effective map<string,string>, label string")


def test_sorting(frame):
    values = ["10", "9", "", "item 10", "item 9", None, "1.5", "None", "Item 2"]
    order = lambda **how: [r["effective"]["v"] for r in G.list_records(records(frame, values), sort="v", **how)[0].collect()]
    up = order()
    assert up[:6] == ["1.5", "9", "10", "Item 2", "item 9", "item 10"] and set(up[6:]) == {"", None, "None"}
    down = order(descending=True)
    assert down[:6] == up[:6][::-1] and set(down[6:]) == {"", None, "None"}, "blanks stay last"


def test_lists(frame):
    found = records(frame, [f"v{i}" for i in range(12)])
    page, total = G.list_records(found, offset=10, limit=5)
    assert total == 12 and [r["label"] for r in page.collect()] == ["L10", "L11"], "labels sort by their number"
    page, total = G.list_records(found, text="V1")
    assert total == 3
    assert G.list_records(found, field="v", value="v3")[1] == 1 and G.list_records(found, field="w", value="v3")[1] == 0
    assert G.list_records(found, type_name="U")[1] == 0
    links = frame([("g1_03", 9), ("g1_01", 10)], "id string, links bigint")
    page, _ = G.list_records(found, links, sort="links", descending=True, limit=3)
    assert [r["id"] for r in page.collect()] == ["g1_01", "g1_03", "g1_00"]


def test_details(star, frame):
    objects, relations = star
    audit = frame(
        [
            ("a1", "old", "g0_h", None, 1), ("a2", "new", None, "h", 2), ("a3", "other", "g1_s1", "s1", 3),
        ],
        "id string, name string, object_id string, logical_id string, created_at int",
    )
    named = relations.withColumns({c: F.concat(F.lit("g1_"), c) for c in ("from_id", "to_id")})
    parts = G.record_detail(objects.withColumn("id", F.concat(F.lit("g1_"), "id")), named, audit, "g1_h")
    assert rows(parts["record"], "id") == [("g1_h",)]
    assert rows(parts["related"], "id") == [(f"g1_s{i}",) for i in range(5)]
    assert [r["id"] for r in parts["history"].collect()] == ["a2", "a1"]


def test_progress(frame):
    objects = frame([("a", "g1"), ("b", "g1"), ("c", "g0")], "id string, generation string")
    relations = frame([("g1", "x", "a", "b")], O.RELATION)
    got = O.publication_counts(objects, relations, BUNDLE, {"orders": 30, "customers": 2}, "g1").first()
    assert got.asDict() == {"records": 2, "relations": 1, "total_records": 32, "estimated_relations": 30}


def test_from_snapshots_to_a_generation(spark, store, tables, tmp_path):
    from ontoweave.operators import publish as W
    from ontoweave.operators.snapshots import Snapshots
    from ontoweave.operators.suggest import Entity, Member, Via
    from ontoweave.operators.entities import TableDef, derived_id

    snapshots = Snapshots(spark, str(tmp_path / "snapshots"))
    crm = tables["customers"].select("id", F.upper("region").alias("area"))
    for name, df in {**tables, "crm": crm}.items():
        snapshots.commit(name, name, df, "v1")
    person = Entity(
        "customer", "Customer", "", "record", "customers", "id", 2,
        (Member("customers", "customers", "postgres", "id", 2, 2),
         Member("crm", "crm", "stripe", "id", 2, 2, Via("id", "customers", "id"))),
    )
    merged = TableDef(derived_id("Customers"), "Customers", person, ("email",), ("customers", "crm"), "id")
    kinds = (TypeDef("Customer", merged.id, "id", ("id", "stripe_area", "email_key")), ORDER, TypeDef("Bad", "orders", "nope", ()))
    proposal = W.propose(snapshots, store, Bundle("", tables=(merged,), types=kinds, relationships=(PLACED,)))
    assert proposal.valid and [t.name for t in proposal.bundle.types] == ["Customer", "Order"]
    first = W.publish(snapshots, store, proposal, actor="ada")
    assert store.active() == first and (store.objects().count(), store.relations().count()) == (5, 3)
    base = store.objects().where("key = 'A'").first()["base"]
    assert (base["stripe_area"], base["email_key"]) == ("EU", "a@example.com")
    assert rows(snapshots.lineage(), "from_id", "to_id", "input_version") == [
        ("crm", merged.id, "v1"), ("customers", merged.id, "v1"),
    ]
    assert snapshots.active(merged.id, first).count() == 2
    with pytest.raises(O.PublicationRefused, match="Published definitions changed"):
        W.publish(snapshots, store, proposal)
    proposal = W.propose(snapshots, store, proposal.bundle)
    snapshots.commit("orders", "orders", tables["orders"].where("id < 3"), "v2")
    with pytest.raises(O.PublicationRefused, match="Input data changed"):
        W.publish(snapshots, store, proposal)
    second = W.publish(snapshots, store, W.propose(snapshots, store, proposal.bundle))
    assert (store.objects().count(), store.relations().count()) == (4, 2)
    assert snapshots.active(merged.id, first).count() == snapshots.active(merged.id, second).count() == 2


def test_one_record_touches_few_files(spark, tmp_path):
    """Objects and both copies of the relations lie in the order they are looked up in."""
    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = O.Graph(spark, str(tmp_path / "graph"))
        people = spark.range(4000).selectExpr("CAST(id AS STRING) AS id", "'EU' AS region", "'x' AS email")
        orders = spark.range(9000).selectExpr("id", "CAST(id % 4000 AS STRING) AS customer", "1 AS amount", "'s' AS status")
        store.publish(BUNDLE, {"customers": people, "orders": orders}, generation="g1")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    focus = f"g1_{logical('Customer', 7)}"
    for name, column, most in (("objects", "id", 3), ("relations", "from_id", 1), ("relations_to", "to_id", 1)):
        files = list((tmp_path / "graph" / name).rglob("*.parquet"))
        holding = 0
        for f in files:
            part = pq.ParquetFile(f)
            at = part.schema_arrow.names.index(column)
            groups = [part.metadata.row_group(i).column(at).statistics for i in range(part.metadata.num_row_groups)]
            holding += any(s.min <= focus <= s.max for s in groups)
        assert len(files) >= 4 and holding <= most, (name, len(files), holding)
    audit = store._table("none", "id string, name string, object_id string, created_at timestamp")
    parts = G.record_detail(store.objects(), store.relations(), audit, focus, incoming=store.relations_to(), related_limit=10)
    assert parts["record"].count() == 1 and rows(parts["related"], "key") == [("4007",), ("7",), ("8007",)]
    text = parts["related"]._jdf.queryExecution().toString()
    assert "In(id, [" in text.split("PushedFilters")[1]
    shown = G.neighbors(store.relations(), parts["record"], store.relations_to())
    assert shown.count() == 3 and rows(shown) == rows(G.neighbors(store.relations(), parts["record"]))


def test_bundles_build_pipelines_and_dashboards(spark, store, tables, tmp_path):
    import dataclasses

    from ontoweave.operators import publish as W
    from ontoweave.operators.dashboards import Dashboard, Widget
    from ontoweave.operators.snapshots import Snapshots
    from ontoweave.plans.nodes import Node
    from ontoweave.plans.runs import Check, PipelineDef

    snapshots = Snapshots(spark, str(tmp_path / "snapshots"))
    for name, df in tables.items():
        snapshots.commit(name, name, df, "v1")
    spent = PipelineDef(
        "pipeline_spent", "Spent",
        (Node("in", "source", dataset="orders"), Node("sum", "aggregate", ("in",), {"groupBy": ["customer"], "metrics": {"spent": "sum(amount)"}})),
        (Check("has rows", "SELECT count(*) > 0 FROM output"), Check("all orders", "SELECT (SELECT sum(spent) FROM output) = (SELECT sum(amount) FROM orders)")),
    )
    # Listed before the pipeline it reads.
    regions = PipelineDef(
        "pipeline_regions", "Regions",
        (
            Node("s", "source", dataset="pipeline_spent"), Node("c", "source", dataset="customers"),
            Node("j", "join", ("s", "c"), {"on": "a.customer = b.id", "select": "b.region AS region, a.spent AS spent"}),
        ),
    )
    bad = PipelineDef("pipeline_bad", "Bad", spent.nodes, (Check("never", "SELECT false"),))
    broken = PipelineDef("pipeline_broken", "Broken", (Node("in", "source", dataset="orders"), Node("x", "select", ("in",), {"columns": ["nope"]})))
    after_bad = PipelineDef("pipeline_after", "After", (Node("in", "source", dataset="pipeline_bad"),))
    board = Dashboard(
        "Board",
        (
            Widget("Spent by region", "metric", "SELECT r.region, sum(r.spent) AS spent FROM Regions r GROUP BY 1", ("pipeline_regions",), x="r.region"),
            Widget("Nothing", "table", "SELECT nope FROM Regions", ("pipeline_regions",)),
            Widget("Bad rows", "table", "SELECT * FROM Bad", ("pipeline_bad",)),
        ),
    )
    bundle = Bundle("", types=(CUSTOMER, ORDER), relationships=(PLACED,), pipelines=(regions, spent, bad, broken, after_bad), dashboards=(board,))
    report = {c.name: c for c in V.validate_bundle(tables, {}, bundle)}
    assert [n for n, c in report.items() if c.kind == "pipeline" and not c.passed] == ["Bad", "Broken"]
    assert report["Bad"].detail == "Quality check failed: never" and report["Broken"].detail == "Unknown column nope"
    assert report["Board / Spent by region"].detail == "2 result rows; query executed" and not report["Board / Nothing"].passed
    proposal = W.propose(snapshots, store, bundle)
    assert proposal.valid and [p.name for p in proposal.bundle.pipelines] == ["Regions", "Spent"]
    (shown,) = proposal.bundle.dashboards[0].widgets
    assert (shown.title, shown.type, shown.x, shown.y) == ("Spent by region", "bar", "region", "spent")
    generation = W.publish(snapshots, store, proposal)
    rows_of, widget = W.show(snapshots, store, "Board", "Spent by region")
    assert widget == shown and rows(rows_of) == [("EU", 30), ("NA", 5)]
    assert ("pipeline_spent", "pipeline_regions", generation) in rows(snapshots.lineage(), "from_id", "to_id", "generation")
    # Readers see the next rows of a widget only after the next publication.
    snapshots.commit("orders", "orders", tables["orders"].where("id = 1"), "v2")
    assert rows(W.show(snapshots, store, "Board", "Spent by region")[0]) == [("EU", 30), ("NA", 5)]
    W.publish(snapshots, store, W.propose(snapshots, store, bundle))
    assert rows(W.show(snapshots, store, "Board", "Spent by region")[0]) == [("EU", 10)]
    with pytest.raises(ValueError, match="Unknown widget"):
        W.show(snapshots, store, "Board", "Nothing")
    # A check that fails on the rows as written stops the publication.
    active = store.active()
    forced = dataclasses.replace(W.propose(snapshots, store, proposal.bundle), bundle=dataclasses.replace(proposal.bundle, pipelines=(spent, bad), dashboards=()))
    with pytest.raises(O.PublicationRefused, match="never"):
        W.publish(snapshots, store, forced)
    assert store.active() == active
    with pytest.raises(ValueError, match="circle"):
        loop = PipelineDef("pipeline_spent", "Loop", (Node("in", "source", dataset="pipeline_regions"),))
        V.validate_bundle(tables, {}, Bundle("", pipelines=(regions, loop)))


def test_datasets_are_stored_side_by_side_and_stated_one_after_another(spark, tmp_path, monkeypatch):
    from threading import Barrier

    from ontoweave.operators import profile
    from ontoweave.operators.keys import Dataset
    from ontoweave.operators.publish import store_all
    from ontoweave.operators.snapshots import Snapshots

    met, plain = Barrier(3, timeout=60), profile.profile

    def waiting(df):
        met.wait()
        return plain(df)

    monkeypatch.setattr(profile, "profile", waiting)
    store = Snapshots(spark, str(tmp_path / "store"))
    store_all(store, [Dataset(f"d{i}", f"d{i}", spark.range(i + 1)) for i in range(3)])
    assert {f"d{i}": store.active(f"d{i}").count() for i in range(3)} == {"d0": 1, "d1": 2, "d2": 3}
    assert store.log.version() == 3 and store.versions().count() == 3


def test_calls_run_together_keep_their_order_and_their_error():
    from ontoweave.functions.jobs import together

    assert together([lambda i=i: i for i in range(9)]) == list(range(9)) and together([]) == []
    done = []
    with pytest.raises(ZeroDivisionError):
        together([lambda: 1 // 0, lambda: done.append(1)])
    assert done == [1]
