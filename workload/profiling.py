"""Profiles, key flags, duplicates, fingerprints, samples, masking, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import SENSITIVE, redact
from ontoweave.operators import profile
from ontoweave.operators.snapshots import COLUMN

from .data import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def columns_sql(source: str, columns: list[tuple[str, str]], extra: str = "") -> str:
    parts = [
        f"SELECT {i} AS position, '{name}' AS name, '{kind}' AS type, count(*) AS rows, "
        f"count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS \"distinct\", "
        f"regexp_matches('{name}', '(?i){SENSITIVE}') AS sensitive, "
        f"count(*) > 0 AND count({name}) = count(*) AND count(DISTINCT {name}) = count(*) AS primary_key "
        f"FROM {source}"
        for i, (name, kind) in enumerate(columns)
    ]
    return " UNION ALL ".join(parts)


LINEITEM = [
    ("l_orderkey", "BIGINT"),
    ("l_partkey", "BIGINT"),
    ("l_suppkey", "BIGINT"),
    ("l_linenumber", "INTEGER"),
    ("l_quantity", "DOUBLE"),
    ("l_extendedprice", "DOUBLE"),
    ("l_discount", "DOUBLE"),
    ("l_tax", "DOUBLE"),
    ("l_returnflag", "VARCHAR"),
    ("l_linestatus", "VARCHAR"),
    ("l_shipdate", "TIMESTAMP"),
]
EMBEDDINGS = [("vec_id", "BIGINT"), ("embedding", "FLOAT[]"), ("label", "INTEGER")]
DOCUMENTS = [
    ("doc_id", "BIGINT"),
    ("text", "VARCHAR"),
    ("lang", "VARCHAR"),
    ("source", "VARCHAR"),
    ("n_chars", "BIGINT"),
]

QUERIES["profile_columns"] = lambda spark, d: profile.profile_columns(table(spark, d, "lineitem"))
ORACLES["profile_columns"] = columns_sql("lineitem", LINEITEM)
QUERIES["profile_nested"] = lambda spark, d: profile.profile_columns(table(spark, d, "embeddings"))
ORACLES["profile_nested"] = columns_sql("embeddings", EMBEDDINGS)
QUERIES["profile_texts"] = lambda spark, d: profile.profile_columns(table(spark, d, "documents"))
ORACLES["profile_texts"] = columns_sql("documents", DOCUMENTS)

QUERIES["profile_rows"] = lambda spark, d: profile.profile_rows(table(spark, d, "nation"))
ORACLES["profile_rows"] = """
SELECT count(*) AS rows, 3 AS columns, 'n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER' AS schema
FROM nation"""

KEYED = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
    "supplier": "s_suppkey s_name s_nationkey s_acctbal".split(),
}


def key_candidates(spark, sf_dir):
    """Every column of the tables: whether it is a key."""
    parts = [
        profile.profile_columns(table(spark, sf_dir, t)).select(F.lit(t).alias("dataset"), "name", "primary_key") for t in KEYED
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES["key_candidates"] = key_candidates
ORACLES["key_candidates"] = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS name, count(*) > 0 AND count({c}) = count(*) "
    f"AND count(DISTINCT {c}) = count(*) AS primary_key FROM {t}"
    for t, columns in KEYED.items()
    for c in columns
)


def sensitive_columns(spark, sf_dir):
    named = table(spark, sf_dir, "customer").withColumnsRenamed(
        {"c_name": "Contact_Email", "c_acctbal": "credit_limit"}
    )
    return profile.profile_columns(named).select("name", "sensitive", "distinct")


QUERIES["sensitive_columns"] = sensitive_columns
ORACLES["sensitive_columns"] = f"""
SELECT name, regexp_matches(name, '(?i){SENSITIVE}') AS sensitive, n AS "distinct" FROM (
SELECT 'c_custkey' AS name, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'Contact_Email', count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'credit_limit', count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer)"""

QUERIES["profile_sample"] = lambda spark, d: profile.sample_rows(table(spark, d, "events"), 50)
ORACLES["profile_sample"] = "SELECT * FROM events ORDER BY ALL LIMIT 50"
QUERIES["profile_examples"] = lambda spark, d: profile.examples(table(spark, d, "orders")).select(
    "name", F.array_join("examples", "|").alias("examples")
)
ORACLES["profile_examples"] = "WITH t AS (SELECT * FROM orders ORDER BY ALL LIMIT 3) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, string_agg(CAST({c} AS VARCHAR), '|' ORDER BY CAST({c} AS VARCHAR)) AS examples FROM t"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
)

COPIED = ["lineitem", "events", "customer"]


def duplicate_rows(spark, sf_dir):
    """Whole rows, of the tables as they are and of one whose rows all stand twice."""
    tables = {t: table(spark, sf_dir, t) for t in COPIED}
    tables["twice"] = tables["customer"].unionByName(tables["customer"])
    parts = [profile.duplicate_rows(df).select(F.lit(t).alias("dataset"), "rows", "duplicate_rows") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


QUERIES["duplicate_rows"] = duplicate_rows
ORACLES["duplicate_rows"] = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows FROM {t}" for t in COPIED
) + " UNION ALL SELECT 'twice', 2 * count(*), 2 * count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) FROM customer"


def fingerprint(spark, sf_dir):
    """Fingerprints of a table as it is, dealt out anew, and with one value changed."""
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderkey").alias("k")).first()["k"]
    price = F.when(F.col("o_orderkey") == first, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    made = {"as it is": orders, "dealt anew": orders.repartition(5), "changed": orders.withColumn("o_totalprice", price)}
    prints = [profile.fingerprint(df).select(F.col("fingerprint").alias("digest")).withColumn("name", F.lit(name)) for name, df in made.items()]
    return (
        reduce(DataFrame.unionByName, prints)
        .groupBy("digest")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
        .select("names")
    )


QUERIES["fingerprint"] = fingerprint
ORACLES["fingerprint"] = "SELECT unnest(['as it is, dealt anew', 'changed']) AS names WHERE (SELECT count(*) > 0 FROM orders)"


CUSTOMER = [
    ("c_custkey", "BIGINT"),
    ("c_name", "VARCHAR"),
    ("c_nationkey", "INTEGER"),
    ("c_acctbal", "DOUBLE"),
    ("c_mktsegment", "VARCHAR"),
]


def dataset_profile(spark, sf_dir):
    """The stored profile of one dataset, flattened to a row per column."""
    customers = table(spark, sf_dir, "customer")
    whole = profile.profile(customers)
    columns = [(*c.values(), whole["duplicate_rows"]) for c in whole["columns"]]
    return profile.small(customers, columns, f"{COLUMN[len('struct<'):-1]}, duplicate_rows bigint")


QUERIES["dataset_profile"] = dataset_profile
ORACLES["dataset_profile"] = f"""SELECT *, (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_rows
FROM ({columns_sql("customer", CUSTOMER)})"""


def schema_card(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return profile.schema_card(orders, profile.profile_columns(orders))


QUERIES["schema_card"] = schema_card


def card_sql(position: int, name: str, kind: str, category: bool) -> str:
    values = f"(SELECT ' values: ' || string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({name} AS VARCHAR) AS v FROM orders))"
    unique = f"CASE WHEN count(DISTINCT {name}) = count(*) THEN ' unique' ELSE '' END"
    return f"SELECT {position} AS position, '{name}' AS name, '{name} {kind}' || {unique} || {values if category else chr(39) * 2} AS card FROM orders"


ORACLES["schema_card"] = " UNION ALL ".join(
    [
        card_sql(0, "o_orderkey", "BIGINT", False),
        card_sql(1, "o_custkey", "BIGINT", False),
        card_sql(2, "o_orderstatus", "VARCHAR", True),
        card_sql(3, "o_totalprice", "DOUBLE", False),
        card_sql(4, "o_orderdate", "TIMESTAMP", False),
        card_sql(5, "o_orderpriority", "VARCHAR", True),
    ]
)


def mask_sample(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumnRenamed("source", "source_token")
    return profile.mask_sample(documents)


QUERIES["mask_sample"] = mask_sample
ORACLES["mask_sample"] = """
SELECT doc_id, text, lang, '[masked]' AS source_token, n_chars FROM documents"""

QUERIES["redact_text"] = lambda spark, d: table(spark, d, "documents").select(
    "doc_id", redact(F.col("text")).alias("text")
)
ORACLES["redact_text"] = r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '\b(postgres(?:ql)?|mysql)://[^\s]+', '\1://[redacted]', 'gi'),
  '(password|api[_-]?key|authorization|token)\s*[:=]\s*[^\s,;]+', '\1=[redacted]', 'gi') AS text
FROM documents"""
