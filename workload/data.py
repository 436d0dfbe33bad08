"""The given tables, and the business datasets Spark derives from them.

The derived datasets rename the star schema the way business systems name things, so that
key and link discovery reads real key words; a second system repeats the customers under
text keys with its own gaps and letter case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoweave.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Dataset name -> (system, SELECT that both engines read).
BUSINESS = {
    "regions": ("app", "SELECT r_regionkey AS region_id, r_name AS name FROM region"),
    "countries": (
        "app",
        "SELECT n_nationkey AS country_id, n_name AS name, n_regionkey AS region_id FROM nation",
    ),
    "customers": (
        "app",
        "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS country_id, "
        "c_acctbal AS balance, c_mktsegment AS segment, lower(c_name) AS account_code FROM customer",
    ),
    "contacts": (
        "crm",
        "SELECT concat('K-', CAST(c_custkey AS VARCHAR)) AS contact_id, "
        "CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE lower(c_name) END AS account_code, "
        "c_mktsegment AS tier FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0",
    ),
    "orders": (
        "app",
        "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, "
        "o_totalprice AS total, o_orderdate AS created_at, o_orderpriority AS priority FROM orders",
    ),
    "parts": (
        "app",
        "SELECT p_partkey AS part_id, p_name AS name, p_brand AS brand, p_type AS category, "
        "p_retailprice AS price FROM part",
    ),
    "suppliers": (
        "app",
        "SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey AS country_id FROM supplier",
    ),
    "order_lines": (
        "app",
        "SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, "
        "l_linenumber AS line_number, l_quantity AS quantity, l_extendedprice AS amount, "
        "l_shipdate AS shipped_at FROM lineitem",
    ),
}


# Operational tables: jobs, runs, audits, sources and datasets, derived from the given ones.
OPERATIONS = {
    "jobs": """SELECT concat('job_', CAST(event_id AS VARCHAR)) AS id,
  CASE event_type WHEN 'purchase' THEN concat('Run pipe ', CAST(user_id AS VARCHAR))
    WHEN 'signup' THEN concat('file ', CAST(user_id AS VARCHAR)) ELSE concat('Sync source ', CAST(user_id AS VARCHAR)) END AS name,
  CASE event_type WHEN 'purchase' THEN 'pipeline' WHEN 'signup' THEN 'upload' ELSE 'sync' END AS type,
  CASE WHEN event_type NOT IN ('purchase', 'signup') THEN concat('source_', CAST(user_id AS VARCHAR)) END AS source_id,
  CASE WHEN event_type = 'signup' THEN concat('dataset_', CAST(user_id AS VARCHAR)) END AS dataset_id,
  CASE WHEN event_type = 'purchase' THEN concat('pipe_', CAST(user_id AS VARCHAR)) END AS pipeline_id,
  CASE WHEN value > 90 THEN 'failed' WHEN value > 70 THEN 'running' WHEN value > 65 THEN 'queued' ELSE 'succeeded' END AS status,
  event_type = 'click' AS background,
  CASE WHEN value > 90 THEN concat('exit ', CAST(user_id AS VARCHAR)) END AS error, ts AS created_at, ts AS updated_at FROM events""",
    "sources": """SELECT concat('source_', CAST(c_custkey AS VARCHAR)) AS id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'postgres' WHEN 'MACHINERY' THEN 'mysql' WHEN 'HOUSEHOLD' THEN 'stripe'
    WHEN 'FURNITURE' THEN 'posthog' ELSE 's3' END AS kind,
  concat('conn_', CAST(c_nationkey AS VARCHAR)) AS connection_id, concat('Connection ', CAST(c_nationkey AS VARCHAR)) AS connection_name,
  c_acctbal < -900 AS paused, CASE WHEN c_acctbal > 9500 THEN 'retrying' ELSE 'ready' END AS sync_status FROM customer""",
    "datasets": """SELECT concat('dataset_', CAST(p_partkey AS VARCHAR)) AS id, p_name AS name,
  CASE WHEN p_type <> 'ECONOMY' THEN concat('source_', CAST(p_partkey AS VARCHAR)) END AS source_id,
  CASE WHEN p_size <> 1 THEN concat('v', CAST(p_size AS VARCHAR)) END AS active_version,
  CASE WHEN p_size = 50 THEN 'v51' END AS pending_version, CAST(p_size AS BIGINT) - 2 AS rows FROM part""",
    "pipelines": """SELECT concat('pipe_', CAST(s_suppkey AS VARCHAR)) AS id, s_name AS name,
  CASE WHEN s_acctbal < 0 THEN 'old' ELSE 'live' END AS generation FROM supplier""",
    "audits": """SELECT concat('audit_', CAST(o_orderkey AS VARCHAR)) AS id, concat('Updated Order ', CAST(o_orderkey AS VARCHAR)) AS name,
  CASE WHEN o_orderstatus = 'P' THEN concat('proposal_', CAST(o_custkey AS VARCHAR)) END AS proposal_id,
  CASE WHEN o_orderstatus <> 'P' THEN concat('g1_', CAST(o_custkey AS VARCHAR)) END AS object_id,
  o_orderdate AS created_at, o_orderdate AS updated_at FROM orders""",
    "runs": """SELECT concat('run_', CAST(conv_id AS VARCHAR), '_', CAST(turn AS VARCHAR)) AS id, text AS goal, CAST(NULL AS VARCHAR) AS task,
  CAST(NULL AS VARCHAR) AS thread_id,
  CASE WHEN turn > 0 THEN concat('run_', CAST(conv_id AS VARCHAR), '_', CAST(turn - 1 AS VARCHAR)) END AS previous_id,
  CASE WHEN role = 'user' THEN 'running' WHEN role = 'system' THEN 'queued' ELSE 'succeeded' END AS status,
  turn AS created_at, turn + 1 AS updated_at FROM conversations""",
}
OPERATIONS_SOURCE = {
    "jobs": "events",
    "sources": "customer",
    "datasets": "part",
    "pipelines": "supplier",
    "audits": "orders",
    "runs": "conversations",
}


def operations(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    configure(spark)
    return [derived(spark, sf_dir, OPERATIONS_SOURCE[name], OPERATIONS[name]) for name in names]


def derived(spark: SparkSession, sf_dir: str, source: str, text: str) -> DataFrame:
    """A SELECT over one given table, in the text both engines read."""
    spoken = text.replace("VARCHAR", "STRING").replace(f" FROM {source}", " FROM {source}")
    return spark.sql(spoken, source=table(spark, sf_dir, source))


def with_operations(sql: str, *names: str) -> str:
    """Oracle text over the operational tables as CTEs named ``o_<name>``."""
    return "WITH " + ",\n".join(f"o_{n} AS ({OPERATIONS[n]})" for n in names) + "\n" + sql


def scratch(spark: SparkSession) -> str:
    """A fresh folder for one query's files, where every executor can reach it."""
    import uuid

    from ontoweave.session import shared_dir

    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def business(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The business datasets by name, from the same text the oracle reads."""
    configure(spark)
    texts = {name: BUSINESS[name][1] for name in names or BUSINESS}
    return {n: derived(spark, sf_dir, text.split(" FROM ")[1].split()[0], text) for n, text in texts.items()}


def with_business(sql: str, names: list[str] | None = None) -> str:
    """Oracle text over the business datasets as CTEs named ``b_<name>``."""
    ctes = [f"b_{n} AS ({BUSINESS[n][1]})" for n in names or list(BUSINESS)]
    return "WITH " + ",\n".join(ctes) + "\n" + sql
