import pytest
from conftest import rows

from ontoweave.operators import query as Q
from ontoweave.plans import nodes, runs
from ontoweave.plans.nodes import Node


@pytest.fixture
def sources(frame):
    return {
        "orders": frame(
            [(1, "A", 10), (1, "A", 10), (2, "A", 20), (3, "B", -10)],
            "id int, customer string, amount int",
        ),
        "customers": frame([("A", "EU"), ("B", "NA")], "customer string, region string"),
    }


CHAIN = [
    Node("o", "source", dataset="orders"),
    Node("c", "source", dataset="customers"),
    Node("s", "select", ("o",), {"columns": ["id", "customer", "amount"]}),
    Node("r", "rename", ("s",), {"mapping": {"amount": "gross"}}),
    Node("t", "cast", ("r",), {"columns": {"gross": "DOUBLE"}}),
    Node("f", "filter", ("t",), {"condition": '"gross" > 0'}),
    Node("d", "derive", ("f",), {"columns": {"net": "gross * 0.9"}}),
    Node("u", "deduplicate", ("d",), {"keys": ["id"]}),
    Node("j", "join", ("u", "c"), {"on": "a.customer = b.customer", "select": "a.*, b.region"}),
    Node("out", "aggregate", ("j",), {"groupBy": ["region"], "metrics": {"total": "sum(net)"}}),
]


def test_chain(sources):
    assert rows(nodes.build(CHAIN, sources)) == [("EU", 27.0)]


def test_order_of_nodes_does_not_matter(sources):
    assert rows(nodes.build(CHAIN[::-1], sources)) == [("EU", 27.0)]


@pytest.mark.parametrize(
    "graph, said",
    [
        ([], "at least one"),
        ([Node("a", "filter", ("a",), {"condition": "true"})], "cycle"),
        ([CHAIN[0], CHAIN[1]], "one output"),
        ([Node("a", "select", ("nope",), {"columns": ["id"]})], "Unknown node"),
        ([CHAIN[0], CHAIN[0]], "unique"),
        ([Node("a", "select", (), {"columns": ["id"]})], "Connect an input"),
        ([Node("a", "source")], "source dataset"),
        ([CHAIN[0], Node("b", "select", ("o",), {"columns": []})], "Set columns"),
        ([CHAIN[0], Node("b", "rename", ("o",), {"mapping": {"nope": "x"}})], "Unknown column"),
        ([CHAIN[0], Node("b", "join", ("o",), {"on": "true"})], "two inputs"),
    ],
)
def test_bad_graphs(sources, graph, said):
    with pytest.raises(ValueError, match=said):
        nodes.build(graph, sources)


def test_derive_keeps_a_taken_name_apart_and_sees_earlier_ones(sources):
    out = nodes.derive(sources["orders"], {"columns": {"double": "amount * 2", "more": "double + 1", "Amount": "0"}})
    assert out.columns == ["id", "customer", "amount", "double", "more", "Amount_1"]
    assert out.where("id = 2").first()["more"] == 41


def test_join_renames_repeated_columns(sources):
    out = nodes.join(sources["orders"], sources["customers"], {"on": "a.customer = b.customer", "joinType": "left"})
    assert out.columns == ["id", "customer", "amount", "customer_1", "region"]


def test_a_failing_cast_is_an_error(sources):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        nodes.cast(sources["orders"], {"columns": {"customer": "BIGINT"}}).collect()


def test_deduplicate_keeps_nulls_as_one_group_and_is_repeatable(frame):
    df = frame([(None, "b"), (None, "a"), (1, "z"), (1, "y")], "k int, v string")
    for shaped in (df, df.repartition(3)):
        assert rows(nodes.deduplicate(shaped, {"keys": ["k"]})) == [(1, "y"), (None, "a")]


def test_deduplicate_with_a_map_column(spark):
    df = spark.sql("SELECT 1 AS k, map('a', 1) AS m UNION ALL SELECT 1, map('a', 0)")
    assert nodes.deduplicate(df, {"keys": ["k"]}).first()["m"] == {"a": 0}


def test_aggregate_without_groups_is_one_row(sources):
    out = nodes.aggregate(sources["orders"].where("false"), {"metrics": {"n": "count(*)", "s": "sum(amount)"}})
    assert rows(out) == [(0, None)]


def test_checks_and_rejected_rows(sources):
    output = sources["orders"].where("amount > 0")
    report = runs.run_checks(
        output,
        sources,
        [
            runs.Check("ok", "SELECT true AS a, 1 AS b, '1' AS c"),
            runs.Check("over both", "SELECT (SELECT count(*) FROM output) < (SELECT count(*) FROM orders) AS ok FROM output"),
            runs.Check("no row", "SELECT true AS ok FROM output WHERE false"),
            runs.Check("false", "SELECT true AS a, false AS b FROM output"),
        ],
    )
    assert rows(report) == [("false", False), ("no row", False), ("ok", True), ("over both", True)]
    assert rows(runs.rejected_rows(sources["orders"], output, "id")) == [(3, "B", -10)]
    assert runs.preview(sources, output, 2).count() == 6


def test_rerun_reads_the_active_versions(spark, sources, tmp_path):
    from ontoweave.operators.snapshots import Snapshots

    store = Snapshots(spark, str(tmp_path))
    for name, df in sources.items():
        store.commit(name, name, df, "v1")
    first = runs.rerun(store, CHAIN, "revenue", "Revenue", "r1")
    store.commit("orders", "orders", sources["orders"].where("id < 2"), "v2")
    second = runs.rerun(store, CHAIN, "revenue", "Revenue", "r2")
    assert first["active_version"] == "r1" and store.history("revenue") == ["r2", "r1"]
    assert rows(store.active("revenue")) == [("EU", 9.0)]
    assert rows(store.lineage(), "from_id", "input_version") == [
        ("customers", "v1"), ("customers", "v1"), ("orders", "v1"), ("orders", "v2"),
    ]


# SQL text.


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE orders",
        "SELECT 1; SELECT 2",
        "SELECT * FROM customers",
        "SELECT * FROM parquet.`/etc`",
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT reflect('java.lang.System', 'getenv') FROM orders",
        "SELECT system.builtin.java_method('java.lang.System', 'getenv') FROM orders",
        "SELECT id FROM orders WHERE id IN (SELECT id FROM secret)",
        "WITH x AS (SELECT * FROM secret) SELECT * FROM x",
        "SELECT (SELECT max(id) FROM secret) AS m FROM orders",
        "SELECT x.*, s.hidden FROM (WITH secret AS (SELECT 1 AS one) SELECT * FROM secret) x CROSS JOIN secret s",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS id) SELECT * FROM a",
        "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM orders",
        "SELECT * FROM orders WHERE EXISTS (SELECT TRANSFORM (id) USING 'cat' AS (x) FROM orders)",
    ],
)
def test_sql_stays_inside_its_inputs(sources, sql):
    with pytest.raises(Exception):
        Q.sql_over({"orders": sources["orders"]}, sql).collect()


def test_refused_sql_never_runs(sources):
    with pytest.raises(Q.QueryRefused, match="java_method"):
        Q.sql_over({"orders": sources["orders"]}, "SELECT java_method('java.lang.System', 'exit', 1) FROM orders")
    with pytest.raises(Q.QueryRefused, match="ScriptTransformation"):
        Q.sql_over({"orders": sources["orders"]}, "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM orders")


def test_ctes_and_quoted_names(sources):
    out = Q.sql_over(
        {"orders": sources["orders"]},
        'WITH big AS (SELECT "id" FROM orders WHERE amount > 15) SELECT count(*) AS n FROM big;',
    )
    assert rows(out) == [(1,)]


def test_a_with_clause_is_seen_in_its_scope_only(spark, sources):
    spark.createDataFrame([(7,)], "hidden int").write.mode("overwrite").saveAsTable("secret")
    try:
        inner = "(WITH secret AS (SELECT 1 AS one) SELECT * FROM secret) x"
        with pytest.raises(Q.QueryRefused, match="secret"):
            Q.sql_over({"orders": sources["orders"]}, f"SELECT x.*, s.hidden FROM {inner} CROSS JOIN secret s")
        assert rows(Q.sql_over({"orders": sources["orders"]}, f"SELECT * FROM {inner}")) == [(1,)]
        nested = "WITH a AS (SELECT id FROM orders), b AS (SELECT id FROM a) SELECT (SELECT count(*) FROM b) AS n"
        assert Q.sql_over({"orders": sources["orders"]}, nested).first()["n"] == sources["orders"].count()
    finally:
        spark.sql("DROP TABLE secret")


def test_views_do_not_leak_between_sessions(spark, sources):
    Q.sql_over({"orders": sources["orders"]}, "SELECT * FROM orders").count()
    assert not spark.catalog.tableExists("orders")


def test_filters_apply_before_the_query(frame):
    orders = frame(
        [(1, "A", 10, "delayed"), (2, "A", 20, "delivered"), (3, "B", 5, None)],
        "id int, customer string, amount int, status string",
    )
    inputs = {"o-1": ("My orders", orders)}
    total = "SELECT sum(amount) AS revenue FROM My_orders"
    run = lambda *f: Q.query_frames(inputs, total, [Q.Filter("o-1", *x) for x in f]).first()["revenue"]
    assert run() == 35
    assert run(("status", "delayed")) == 10
    assert run(("status", None)) == 5
    with pytest.raises(ValueError, match="Unknown filter column"):
        run(("nope", 1))
    with pytest.raises(ValueError, match="not declared"):
        Q.query_frames(inputs, total, [Q.Filter("other", "status", 1)])


def test_aliases_bind_only_when_unique(sources):
    views = Q.bind({"a-1": ("Sales", sources["orders"]), "b-2": ("sales", sources["orders"]), "c3": ("Result", sources["orders"])})
    assert set(views) == {"d_a1", "d_b2", "d_c3"}
    assert Q.infer_inputs("SELECT * FROM d_a1 JOIN x", ["Sales", "c3", "nope"], {"a-1": "Sales", "b-2": "Other", "c3": "C"}) == ["a-1", "c3"]
