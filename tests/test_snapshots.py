import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ontoweave.operators import snapshots as S
from ontoweave.operators.query import Filter
from ontoweave.sources import billing, database, files, identity, pages, product

ORDERS = [(1, "A", 10, "delayed"), (2, "A", 20, "delivered"), (3, "B", 5, "delivered")]


@pytest.fixture
def store(spark, tmp_path):
    return S.Snapshots(spark, str(tmp_path / "store"))


@pytest.fixture
def orders(frame):
    return frame(ORDERS, "id int, customer string, amount int, status string")


def test_drift_waits_and_the_old_version_still_serves(store, orders):
    store.commit("orders", "Orders", orders, "v1")
    drifted = orders.select("id", "customer", F.col("amount").alias("total"))
    state = store.commit("orders", "Orders", drifted, "v2")
    assert (state["active_version"], state["pending_version"]) == ("v1", "v2")
    assert store.history("orders") == ["v2", "v1"]
    assert store.query(["orders"], "SELECT sum(amount) AS revenue FROM Orders")[0].first()["revenue"] == 35
    state = store.accept("orders")
    assert (state["active_version"], state["pending_version"]) == ("v2", None)
    assert store.active("orders").columns == ["id", "customer", "total"]
    with pytest.raises(ValueError, match="No pending"):
        store.accept("orders")


def test_a_version_is_committed_once(store, orders):
    first = store.commit("orders", "Orders", orders, "v1")
    again = store.commit("orders", "Renamed", orders.where("id = 1"), "v1")
    assert again["seq"] == first["seq"] and again["name"] == "Orders"
    assert store.active("orders").count() == 3


def test_findings_tell_what_got_worse(store, orders):
    store.commit("orders", "Orders", orders, "v1")
    store.commit("orders", "Orders", orders.repartition(3), "same")
    assert store.findings().count() == 0, "the same rows in another order are no news"
    worse = orders.unionByName(orders.where("id = 1")).withColumn("status", F.when(F.col("id") > 1, F.col("status")))
    store.commit("orders", "Orders", worse, "v2")
    found = store.findings().first()
    assert (found["kind"], found["title"], found["rows_before"], found["rows_after"]) == ("refresh", "Data refreshed: Orders", 3, 4)
    assert sorted(found["issues"]) == [
        "amount lost uniqueness or contains nulls",
        "id lost uniqueness or contains nulls",
        "status null rate increased",
    ]
    assert found["duplicate_rows"] == 1


def test_query_filters_citations_and_persisting(store, orders):
    store.commit("o-1", "Orders", orders, "v1")
    result, cited = store.query(["o-1"], "SELECT sum(amount) AS revenue FROM Orders", [Filter("o-1", "status", "delayed")])
    assert result.first()["revenue"] == 10
    assert rows(cited) == [("o-1", "v1", "dataset_snapshot")]
    kept, _ = store.query(["o-1"], "SELECT customer, count(*) AS n FROM Orders GROUP BY 1", persist=("by", "By customer"))
    assert rows(kept) == [("A", 2), ("B", 1)]
    assert {r["name"]: r["primary_key"] for r in store.columns("by").collect()} == {"customer": True, "n": True}


def test_derived_datasets_belong_to_their_generation(store, orders):
    store.commit("d", "Derived", orders, generation="g1")
    store.commit("d", "Derived", orders.select("id").where("id = 1"), generation="g2")
    assert store.active("d", "g1").count() == 3, "an earlier generation still reads its own rows"
    assert store.active("d", "g2").columns == ["id"] and store.state("d")["pending_version"] is None
    for generation in (None, "g3"):
        with pytest.raises(ValueError, match="unavailable"):
            store.active("d", generation)
    with pytest.raises(ValueError, match="unavailable"):
        store.active("nope")


def test_stale_inputs(store, orders, frame):
    store.commit("a", "A", orders, "v1")
    recorded = frame([("a", "v1"), ("gone", "v9")], "dataset_id string, version string")
    assert rows(S.stale_inputs(recorded, store.registry()), "dataset_id") == [("gone",)]
    store.commit("a", "A", orders, "v2")
    assert rows(S.stale_inputs(recorded, store.registry()), "dataset_id") == [("a",), ("gone",)]


def test_schema_signature_sees_schemas_only():
    one = {"a": [("x", "BIGINT")], "b": [("y", "VARCHAR")]}
    assert S.schema_signature(one) == S.schema_signature(dict(reversed(one.items())))
    assert S.schema_signature(one) != S.schema_signature({**one, "a": [("x", "DOUBLE")]})


SETUP = {
    "datasets": "id string, name string, source_id string, active_version string, pending_version string, rows bigint",
    "sources": "id string, name string",
    "imports": "id string, name string, source_id string, dataset_id string, status string, background boolean, created_at int",
}


def test_readiness(frame):
    datasets = frame(
        [("d1", "Orders", "s1", "v1", None, 5), ("d2", "Users", "s2", "v1", "v2", 0), ("d3", "Files", None, None, None, None)],
        SETUP["datasets"],
    )
    sources = frame([("s1", "Shop"), ("s2", "Auth"), ("s9", "Idle")], SETUP["sources"])
    imports = frame(
        [
            ("j1", "Sync Shop", "s1", None, "failed", False, 1),
            ("j2", "Sync Shop", "s1", None, "succeeded", False, 2),
            ("j3", "Sync Auth", "s2", None, "running", True, 1),
            ("j4", "file.csv", None, "d3", "failed", False, 1),
            ("j5", "other.csv", None, None, "queued", False, 1),
        ],
        SETUP["imports"],
    )
    got = {r["blocker"] for r in S.readiness(datasets, sources, imports).collect()}
    assert got == {
        "file.csv: retry or remove this import.",
        "other.csv: import is still in progress.",
        "Idle: start the import or remove this source.",
        "Users: review the schema change before continuing.",
        "Users: no records to analyze. Add records or remove this dataset from setup.",
        "Files: no records to analyze. Add records or remove this dataset from setup.",
    }
    nothing = S.readiness(datasets.where("false"), sources.where("false"), imports.where("false"))
    assert rows(nothing, "blocker") == [("Import at least one dataset to continue.",)]
    mark = lambda *x: S.readiness_signature(*x).first()["signature"]
    assert mark(datasets, sources, imports) == mark(datasets.repartition(3), sources, imports)
    assert mark(datasets, sources, imports) != mark(datasets, sources.where("id <> 's9'"), imports)


# Files.


def test_files_are_inferred(spark, tmp_path):
    csv = tmp_path / "people.csv"
    csv.write_text('id,joined,note,score\n1,2024-01-02,"two\nlines, ""quoted""",1.5\n2,2024-01-03,,\n')
    df = files.scan(spark, str(csv))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "date", "string", "double"]
    assert df.first()["note"] == 'two\nlines, "quoted"'
    js = tmp_path / "people.json"
    js.write_text(json.dumps([{"id": 1, "tags": ["a"]}, {"id": 2}], indent=1))
    assert rows(files.scan(spark, str(js)), "id") == [(1,), (2,)]
    lines = tmp_path / "people.jsonl"
    lines.write_text('{"id": 1}\n{"id": 2, "x": {"y": 1.5}}\n')
    assert files.scan(spark, str(lines)).where("x.y = 1.5").count() == 1
    with pytest.raises(ValueError, match="Unknown file kind"):
        files.scan(spark, str(tmp_path / "a.xyz"))


def test_json_texts_that_are_all_times(spark, tmp_path):
    made = [
        {"d": "2024-01-02", "t": "2024-01-02T03:04:05Z", "u": "2024-01-02 03:04:05.5", "year": "2024", "mixed": "2024-01-02", "none": None},
        {"d": None, "t": "2024-01-02T03:04:05+02:00", "u": "2024-01-02T00:00:00", "year": "2025", "mixed": "soon", "none": None},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, made)))
    df = files.scan(spark, str(tmp_path / "t.jsonl"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {"d": "date", "t": "timestamp", "u": "timestamp_ntz", "year": "string", "mixed": "string", "none": "string"}
    assert df.where("d IS NULL").first()["u"] == dt.datetime(2024, 1, 2)
    given = files.scan(spark, str(tmp_path / "t.jsonl"), schema=[{"name": "d", "type": "varchar"}])
    assert [f.dataType.simpleString() for f in given.schema.fields] == ["string"]


def test_csv_times(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t,z,n\n2024-01-02 03:04:05,2024-01-02T03:04:05Z,1\n")
    df = files.scan(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["timestamp_ntz", "timestamp", "bigint"]


def test_an_empty_import_keeps_its_declared_columns(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    columns = [{"name": n, "type": t} for n, t in [("a", "int"), ("b", "bigint"), ("c", "DATE"), ("d", "geometry"), ("e", "tinyint")]]
    df = files.scan_or_empty(spark, str(tmp_path / "empty.jsonl"), "jsonl", columns)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "date", "string", "int"]


def test_landed_rows(spark, tmp_path):
    assert rows(files.land_rows(spark, [{"id": 1, "n": "é"}, {"id": 2}], str(tmp_path / "in")), "id") == [(1,), (2,)]
    with pytest.raises(ValueError, match="at least one row"):
        files.land_rows(spark, [], str(tmp_path / "none"))


def test_listing(spark, tmp_path):
    for name in ["a.csv", "deep/b.JSONL", "c.parquet", "d.txt", "e.json.bak"]:
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * 3)
    listed = files.list_files(spark, str(tmp_path / "files"))
    assert {(r["name"].rsplit("/", 1)[1], r["size"]) for r in listed.collect()} == {("a.csv", 3), ("b.JSONL", 3), ("c.parquet", 3)}


def test_verified_export(spark, tmp_path, orders):
    manifest = files.verified_export({"orders": orders}, {"orders": 3}, str(tmp_path / "out"))
    row = manifest.first()
    assert row["rows"] == 3 and row["bytes"] > 0 and len(row["sha256"]) == 64
    with pytest.raises(files.ExportFailed, match="Rows of the source differ for"):
        files.verified_export({"orders": orders}, {"orders": 4}, str(tmp_path / "out2"))
    with pytest.raises(files.ExportFailed, match="Not a table name"):
        files.verified_export({"../x": orders}, {"../x": 3}, str(tmp_path / "out3"))


# Sources.


def test_pages(spark):
    paged = spark.read.json(spark.sparkContext.parallelize(['{"data": {"items": [{"id": 1}, {"id": 2}]}}', '{"data": {"items": []}}']))
    assert rows(pages.explode_items(paged, "data.items")) == [(1,), (2,)]
    for bad in ("data", "data.nope", "nope"):
        with pytest.raises(ValueError, match="must be an array"):
            pages.explode_items(paged, bad)


def test_days_and_keysets(frame):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    df = frame([(1, at(1, 0)), (2, at(2, 0)), (3, at(3, 23)), (4, at(4, 0))], "id int, ts timestamp_ntz")
    assert rows(pages.last_days(df, "ts", 2, dt.date(2024, 1, 3)), "id") == [(2,), (3,)]
    pairs = frame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert [tuple(r) for r in pages.keyset_page(pairs, ["a", "b"], [1, 1], 3).collect()] == [(1, 2), (2, 0), (2, 1)]
    assert pages.keyset_page(pairs, ["a", "b"], None, 100).count() == 9


def test_billing(spark):
    raw = [
        {"id": "in_1", "object": "invoice", "customer": "cus_1", "subscription": "sub_1", "created": 1_700_000_000,
         "lines": {"data": [{"id": "il_1", "object": "line_item", "price": {"id": "price_1"}, "amount": 100}]}},
        {"id": "in_2", "object": "invoice", "customer": {"id": "cus_2", "object": "customer"}, "subscription": None,
         "created": 1_700_000_100, "lines": {"data": [{"id": "il_2", "pricing": {"price_details": {"price": "price_9"}}, "amount": 5}]}},
    ]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in raw]))
    got = billing.normalize(df.drop("lines"), "invoices")
    assert rows(got, "invoice_id", "customer_id", "subscription_id", "created") == [
        ("in_1", "cus_1", "sub_1", "2023-11-14T22:13:20.000Z"),
        ("in_2", "cus_2", None, "2023-11-14T22:15:00.000Z"),
    ]
    assert "object" not in got.columns
    items = billing.normalize(billing.children(df, "invoice_line_items"), "invoice_line_items")
    assert rows(items, "invoice_id", "line_item_id", "price_id") == [("in_1", "il_1", "price_1"), ("in_2", "il_2", "price_9")]
    with pytest.raises(ValueError, match="not embedded"):
        billing.children(df, "invoices")


def test_a_balance_transaction_keeps_its_source(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"id": "txn_1", "source": "ch_1", "created": 0, "available_on": 60}']))
    assert billing.normalize(df, "balance_transactions").first().asDict() == {
        "balance_transaction_id": "txn_1", "source_id": "ch_1",
        "created": "1970-01-01T00:00:00.000Z", "available_on": "1970-01-01T00:01:00.000Z",
    }


def test_identity(spark):
    df = spark.read.json(spark.sparkContext.parallelize(
        ['{"object": "directory_user", "id": "du_1", "parent_id": "dir_1", "groups": [], "email": "x"}']))
    assert identity.normalize(df, "directory_users").first().asDict() == {
        "directory_id": "dir_1", "directory_user_id": "du_1", "email": "x",
    }
    assert identity.normalize(df, "directory_group_members").first().asDict() == {
        "directory_group_id": "dir_1", "directory_user_id": "du_1",
    }


def test_product(frame):
    df = frame([("e1", '{"$session_id": "s1", "n": 1}'), ("e2", "not json"), ("e3", None)], "event_id string, properties string")
    got = product.normalize(df, "events")
    assert rows(got, "event_id", "session_id", "current_url") == [("e1", "s1", None), ("e2", None, None), ("e3", None, None)]
    assert {r["event_id"]: r["properties"] for r in got.collect()}["e2"] == {}
    groups = frame([(0, "org_1"), (7, "x")], "index int, key string")
    assert rows(product.with_group_types(groups, {0: "organization"}), "group_type", "group_key") == [("group_7", "x"), ("organization", "org_1")]


def test_declared_links_point_at_known_keys():
    for source in (billing, identity):
        for table, column, owner, key in source.relationships():
            assert table in source.OBJECTS and owner in source.OBJECTS and source.OBJECTS[owner].key == key == column
    assert len(billing.OBJECTS) == 15 and len(billing.EPOCHS) == 19 and len(billing.REFERENCES) == 18


def test_database_reads_are_planned():
    columns = [("id", "BIGINT UNSIGNED"), ("amount", "DECIMAL(30,8)"), ("happened", "DATETIME"), ("title", "VARCHAR(10)")]
    assert database.custom_schema("mysql", columns) == "`id` STRING, `amount` STRING, `happened` STRING"
    plan = database.read_options("orders", partition_column="id", bounds=(1, 100), partitions=8)
    assert (plan["numPartitions"], plan["lowerBound"], plan["upperBound"]) == ("8", "1", "100")
    assert "numPartitions" not in database.read_options("orders", partition_column="id", bounds=(1, 9), partitions=8, consistent=True)
    with pytest.raises(ValueError, match="bounds"):
        database.read_options("orders", partition_column="id", partitions=8)
    assert set(database.CATALOG["mysql"]) == set(database.CATALOG["postgres"]) == {"tables", "columns", "foreign_keys"}


CLEAN = [
    {"id": i, "amount": i / 4 + (0.125 if i % 7 == 0 else 0), "ok": i % 2 == 0, "day": f"2024-01-{1 + i % 28:02}", "at": f"2024-01-01T00:00:{i % 60:02}",
     "zoned": f"2024-01-01T00:00:{i % 60:02}Z", "note": f"n {i}" if i % 3 else None, "nested": {"a": i, "b": ["x", "y"][: i % 3]}, "odd name": "x", "never": None}
    for i in range(300)
]
CHANGES = {
    "clean": lambda rows: rows,
    "fraction later": lambda rows: [{**r, "id": r["id"] + 0.5} if i == 250 else r for i, r in enumerate(rows)],
    "text later": lambda rows: [{**r, "ok": "maybe"} if i == 250 else r for i, r in enumerate(rows)],
    "no day later": lambda rows: [{**r, "day": "soon"} if i == 250 else r for i, r in enumerate(rows)],
    "new column later": lambda rows: [{**r, "extra": 1} if i == 250 else r for i, r in enumerate(rows)],
    "value later": lambda rows: [{**r, "never": "2024-01-01"} if i == 250 else r for i, r in enumerate(rows)],
    "missing later": lambda rows: [{k: v for k, v in r.items() if k != "amount"} if i > 200 else r for i, r in enumerate(rows)],
    "huge number": lambda rows: [{**r, "id": 10**20} if i == 250 else r for i, r in enumerate(rows)],
    "mixed from the start": lambda rows: [{**r, "id": "a" if i % 2 else 1} for i, r in enumerate(rows)],
    "quoted name": lambda rows: [{**r, "it's": 1} for r in rows],
}


@pytest.mark.parametrize("change", CHANGES)
def test_lines_parsed_as_they_are_written_are_what_a_scan_reads(spark, store, tmp_path, change):
    made = CHANGES[change](CLEAN)
    path = str(tmp_path / "in.jsonl")
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in made) + "\n\n")
    wanted = files.scan(spark, path)
    store.ingest("d", "D", path, version="v1")
    got = store.active("d")
    assert [(f.name, f.dataType) for f in got.schema.fields] == [(f.name, f.dataType) for f in wanted.schema.fields]
    assert rows(got.select(F.to_json(F.struct("*")))) == rows(wanted.select(F.to_json(F.struct("*"))))
    assert store.version_profile("d", "v1")["rows"] == 300


def test_lines_that_are_no_json(spark, store, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    store.ingest("d", "D", str(tmp_path / "in.jsonl"), version="v1")
    assert sorted(store.active("d").columns) == sorted(files.scan(spark, str(tmp_path / "in.jsonl")).columns)
    store.ingest("p", "P", f"{store.root}/data/d/v1", "parquet", version="v1")
    assert store.active("p").count() == store.active("d").count()
