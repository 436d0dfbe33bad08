"""Data-preparation nodes, graphs of them, and SQL over declared inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.operators import profile, query
from ontoweave.plans import nodes, runs
from ontoweave.operators.snapshots import Snapshots
from ontoweave.plans.nodes import Node

from .data import scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def one(node_type: str, source: str, **config):
    """A graph of a source and one node over it."""

    def run(spark, sf_dir):
        graph = [
            Node("in", "source", dataset=source),
            Node("out", node_type, ("in",), config),
        ]
        return nodes.build(graph, {source: table(spark, sf_dir, source)})

    return run


QUERIES["node_source"] = lambda spark, d: nodes.build(
    [Node("in", "source", dataset="supplier")], {"supplier": table(spark, d, "supplier")}
)
ORACLES["node_source"] = "SELECT * FROM supplier"

QUERIES["node_select"] = one("select", "lineitem", columns=["l_orderkey", "l_quantity", "l_shipdate"])
ORACLES["node_select"] = "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem"

QUERIES["node_rename"] = one(
    "rename", "customer", mapping={"c_custkey": "customer_id", "c_acctbal": "balance"}
)
ORACLES["node_rename"] = (
    "SELECT c_custkey AS customer_id, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer"
)

QUERIES["node_cast"] = one(
    "cast", "orders", columns={"o_orderkey": "VARCHAR", "o_custkey": "DOUBLE", "o_orderdate": "DATE"}
)
ORACLES["node_cast"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus,
  o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"""

QUERIES["node_filter"] = one(
    "filter", "lineitem", condition="\"l_discount\" > 0.05 AND l_returnflag = 'R'"
)
ORACLES["node_filter"] = "SELECT * FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'"

QUERIES["node_derive"] = one(
    "derive",
    "part",
    columns={"gross": "p_size * 2", "net": "gross + 1", "p_size": "p_size + 100"},
)
ORACLES["node_derive"] = """
SELECT *, p_size * 2 AS gross, p_size * 2 + 1 AS net, p_size + 100 AS p_size_1 FROM part"""

QUERIES["node_dedup"] = one("deduplicate", "lineitem", keys=["l_orderkey", "l_linenumber"])
ORACLES["node_dedup"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_orderkey NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_linenumber NULLS FIRST,
  l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
  l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS rn FROM lineitem) WHERE rn = 1"""

QUERIES["node_distinct"] = lambda spark, d: nodes.build(
    [
        Node("in", "source", dataset="lineitem"),
        Node("cols", "select", ("in",), {"columns": ["l_partkey", "l_suppkey", "l_returnflag"]}),
        Node("out", "deduplicate", ("cols",)),
    ],
    {"lineitem": table(spark, d, "lineitem")},
)
ORACLES["node_distinct"] = "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem"


def joined(how: str, select: str | None = None):
    def run(spark, sf_dir):
        config = {"on": "a.c_custkey = b.o_custkey", "joinType": how}
        graph = [
            Node("c", "source", dataset="customer"),
            Node("o", "source", dataset="orders"),
            Node("out", "join", ("c", "o"), config | ({"select": select} if select else {})),
        ]
        return nodes.build(graph, {t: table(spark, sf_dir, t) for t in ("customer", "orders")})

    return run


QUERIES["node_join_inner"] = joined("inner")
ORACLES["node_join_inner"] = "SELECT * FROM customer a JOIN orders b ON a.c_custkey = b.o_custkey"
QUERIES["node_join_left"] = joined("left", "a.c_custkey, a.c_mktsegment, b.o_orderkey, b.o_totalprice")
ORACLES["node_join_left"] = """
SELECT a.c_custkey, a.c_mktsegment, b.o_orderkey, b.o_totalprice
FROM customer a LEFT JOIN orders b ON a.c_custkey = b.o_custkey"""

QUERIES["node_aggregate"] = one(
    "aggregate",
    "lineitem",
    groupBy=["l_returnflag", "l_linestatus"],
    metrics={
        "lines": "count(*)",
        "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)",
        "parts": "count(DISTINCT l_partkey)",
        "large": "count(*) FILTER (WHERE l_quantity > 25)",
    },
)
ORACLES["node_aggregate"] = """
SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_quantity > 25) AS large
FROM lineitem GROUP BY ALL"""

QUERIES["node_sql"] = lambda spark, d: nodes.build(
    [
        Node("o", "source", dataset="orders"),
        Node("big", "filter", ("o",), {"condition": "o_totalprice > 100000"}),
        Node(
            "out",
            "sql",
            ("big",),
            sql="SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS top FROM node_big GROUP BY 1",
        ),
    ],
    {"orders": table(spark, d, "orders")},
)
ORACLES["node_sql"] = """
SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS top FROM orders
WHERE o_totalprice > 100000 GROUP BY 1"""

GRAPH = [
    Node("orders", "source", dataset="orders"),
    Node("customers", "source", dataset="customer"),
    Node("cols", "select", ("orders",), {"columns": ["o_orderkey", "o_custkey", "o_totalprice"]}),
    Node("named", "rename", ("cols",), {"mapping": {"o_totalprice": "gross"}}),
    Node("typed", "cast", ("named",), {"columns": {"gross": "DOUBLE"}}),
    Node("kept", "filter", ("typed",), {"condition": "gross > 0"}),
    Node("net", "derive", ("kept",), {"columns": {"net": "gross * 0.9"}}),
    Node("once", "deduplicate", ("net",), {"keys": ["o_orderkey"]}),
    Node(
        "joined",
        "join",
        ("once", "customers"),
        {"on": "a.o_custkey = b.c_custkey", "select": "a.*, b.c_mktsegment AS segment"},
    ),
    Node(
        "out",
        "aggregate",
        ("joined",),
        {"groupBy": ["segment"], "metrics": {"revenue": "round(sum(net), 2)", "orders": "count(*)"}},
    ),
]


@register(
    "node_graph",
    """
SELECT c_mktsegment AS segment, round(sum(o_totalprice * 0.9), 2) AS revenue, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 GROUP BY 1""",
)
def node_graph(spark, sf_dir):
    return nodes.build(GRAPH, {t: table(spark, sf_dir, t) for t in ("orders", "customer")})


SEGMENTS = """WITH s AS (SELECT c_mktsegment AS segment, round(sum(o_totalprice * 0.9), 2) AS revenue, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 GROUP BY 1)
"""


@register(
    "node_checks",
    SEGMENTS
    + """SELECT 'Has rows' AS name, count(*) > 0 AS passed FROM s UNION ALL SELECT 'One row per segment', count(*) = count(DISTINCT segment) FROM s
UNION ALL SELECT 'No negative revenue', min(revenue) >= 0 FROM s UNION ALL SELECT 'Rejects', count(*) = 0 FROM s""",
)
def node_checks(spark, sf_dir):
    sources = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    checks = [
        runs.Check("Has rows", "SELECT count(*) > 0 AS ok FROM output"),
        runs.Check("One row per segment", "SELECT count(*) = count(DISTINCT segment) AS ok FROM output"),
        runs.Check("No negative revenue", "SELECT min(revenue) >= 0 AS ok FROM output"),
        runs.Check("Rejects", "SELECT count(*) = 0 AS ok FROM output"),
    ]
    return runs.run_checks(nodes.build(GRAPH, sources), sources, checks)


@register(
    "rejected_rows",
    """
SELECT * FROM orders a WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey FROM orders
  WHERE o_orderstatus <> 'P' AND o_totalprice > 50000) b WHERE a.o_orderkey = b.o_orderkey)""",
)
def rejected_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    output = nodes.build(
        [
            Node("in", "source", dataset="orders"),
            Node("out", "filter", ("in",), {"condition": "o_orderstatus <> 'P' AND o_totalprice > 50000"}),
        ],
        {"orders": orders},
    )
    return runs.rejected_rows(orders, output, "o_orderkey")


@register(
    "node_preview",
    """
SELECT * FROM (SELECT 'orders' AS dataset, CAST(o_orderkey AS VARCHAR) AS first_value FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer ORDER BY c_custkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'output', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0
  GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 5)""",
)
def node_preview(spark, sf_dir):
    """The preview's rows by the value of their first column."""
    sources = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    shown = runs.preview(sources, nodes.build(GRAPH, sources))
    return shown.select("dataset", F.regexp_extract("row", r'^\{"[^"]+":"?([^",}]*)', 1).alias("first_value"))


@register(
    "node_rerun",
    """
SELECT c_mktsegment AS segment, round(sum(o_totalprice * 0.9), 2) AS revenue, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 AND o_orderstatus = 'F' GROUP BY 1""",
)
def node_rerun(spark, sf_dir):
    """The output's second version, after its input was refreshed."""
    store = Snapshots(spark, scratch(spark))
    orders = table(spark, sf_dir, "orders")
    store.commit("orders", "Orders", orders, "v1")
    store.commit("customer", "Customers", table(spark, sf_dir, "customer"), "v1")
    runs.rerun(store, GRAPH, "revenue", "Revenue")
    store.commit("orders", "Orders", orders.where("o_orderstatus = 'F'"), "v2")
    runs.rerun(store, GRAPH, "revenue", "Revenue")
    return store.active("revenue")


# SQL over declared inputs.


def text(sql: str, *tables: str):
    return lambda spark, d: query.sql_over({t: table(spark, d, t) for t in tables}, sql)


SQL = {
    "sql_semi": (
        "SELECT c_custkey, c_name FROM customer c WHERE EXISTS "
        "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
        ["customer", "orders"],
    ),
    "sql_anti": (
        "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS "
        "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
        ["customer", "orders"],
    ),
    "sql_full": (
        "SELECT c.k, c.customers, s.suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers "
        "FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, "
        "count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k",
        ["customer", "supplier"],
    ),
    "sql_range": (
        "WITH spans AS (SELECT o_custkey AS k, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders "
        "GROUP BY 1) SELECT s.k, count(*) AS inside FROM spans s JOIN orders o ON o.o_custkey = s.k "
        "AND o.o_orderdate > s.lo AND o.o_orderdate < s.hi GROUP BY 1",
        ["orders"],
    ),
    "sql_window_frame": (
        "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS place, lag(o_totalprice) OVER w AS before, "
        "max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders "
        "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
        ["orders"],
    ),
    "sql_rollup": (
        "SELECT l_returnflag, l_linestatus, count(*) AS lines, max(l_quantity) AS most FROM lineitem "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        ["lineitem"],
    ),
    "sql_set_ops": (
        "(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT "
        "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT "
        "SELECT p_partkey FROM part WHERE p_size < 10",
        ["lineitem", "part"],
    ),
    "sql_subquery": (
        "SELECT p_brand, count(*) AS parts FROM part WHERE p_retailprice > "
        "(SELECT avg(p_retailprice) FROM part) AND p_partkey IN (SELECT l_partkey FROM lineitem "
        "WHERE l_quantity > 45) GROUP BY 1",
        ["part", "lineitem"],
    ),
}
SQL["sql_set_ops"] = ("SELECT * FROM (" + SQL["sql_set_ops"][0] + ") t", SQL["sql_set_ops"][1])
for _name, (_sql, _tables) in SQL.items():
    QUERIES[_name] = text(_sql, *_tables)
    ORACLES[_name] = _sql


@register(
    "bind_inputs",
    """
SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def bind_inputs(spark, sf_dir):
    inputs = {
        "7f-01": ("Customers", table(spark, sf_dir, "customer")),
        "7f-02": ("Sales orders", table(spark, sf_dir, "orders")),
    }
    return query.query_frames(
        inputs,
        "SELECT c.c_mktsegment AS segment, count(*) AS orders FROM Sales_orders o "
        f"JOIN {query.dataset_table('7f-01')} c ON o.o_custkey = c.c_custkey GROUP BY 1;",
    )


@register(
    "prefilter_aggregate",
    """
SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F' GROUP BY 1""",
)
def prefilter_aggregate(spark, sf_dir):
    return query.query_frames(
        {"orders": ("Orders", table(spark, sf_dir, "orders"))},
        "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue "
        "FROM Orders GROUP BY 1",
        [query.Filter("orders", "o_orderstatus", "F")],
    )


@register(
    "preview_page",
    "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100",
)
def preview_page(spark, sf_dir):
    return profile.page(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 100, 50)
