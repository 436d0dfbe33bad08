"""Keys, overlap, links, the suggested ontology, merged entities, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.functions.local import local_frame
from ontoweave.operators import entities, keys, overlap, publish, suggest, validate
from ontoweave.operators.entities import RelationshipDef, TypeDef
from ontoweave.operators.keys import Dataset
from ontoweave.operators.objects import Graph
from ontoweave.operators.snapshots import Snapshots

from .data import BUSINESS, business, scratch, table, with_business

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def datasets(spark, sf_dir, names=None) -> list[Dataset]:
    sources = {"app": "postgres", "crm": "s3"}
    return [
        Dataset(n, n, df, sources[BUSINESS[n][0]], BUSINESS[n][0], f"public.{n}")
        for n, df in business(spark, sf_dir, names).items()
    ]


def unique_sql(source: str, column: str) -> str:
    return (
        f"(SELECT count(*) > 0 AND count({column}) = count(*) AND count(DISTINCT {column}) = count(*) FROM b_{source})"
    )


# Each dataset's identifier columns by the key rules, best first; each alternate key.
OWN = {
    "regions": ["region_id"],
    "countries": ["country_id", "region_id"],
    "customers": ["customer_id", "country_id"],
    "contacts": ["contact_id"],
    "orders": ["order_id", "customer_id"],
    "parts": ["part_id"],
    "suppliers": ["supplier_id", "country_id"],
    "order_lines": ["order_id", "part_id", "supplier_id", "line_number"],
}
KEY_COLUMNS = {t: list(c) for t, c in OWN.items()}
KEY_COLUMNS["customers"].append("account_code")
KEY_COLUMNS["contacts"].append("account_code")
INTEGERS = {(t, c) for t, cs in KEY_COLUMNS.items() for c in cs} - {
    ("contacts", "contact_id"),
    ("contacts", "account_code"),
    ("customers", "account_code"),
}


def own_sql() -> str:
    parts = []
    for t, columns in OWN.items():
        cases = " ".join(f"WHEN {unique_sql(t, c)} THEN '{c}'" for c in columns)
        parts.append(f"SELECT '{t}' AS dataset, CASE {cases} END AS key")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE key IS NOT NULL"


@register("own_keys", with_business(own_sql()))
def own_keys(spark, sf_dir):
    return keys.own_keys(keys.column_facts(datasets(spark, sf_dir)))


@register(
    "alt_keys",
    with_business(
        " UNION ALL ".join(
            f"SELECT '{t}' AS dataset, 'account_code' AS name WHERE {unique_sql(t, 'account_code')}"
            for t in ("customers", "contacts")
        )
    ),
)
def alt_keys(spark, sf_dir):
    facts = keys.column_facts(datasets(spark, sf_dir))
    return keys.alternate_keys(facts, keys.own_keys(facts))


@register(
    "key_columns",
    with_business(
        " UNION ALL ".join(
            f"SELECT '{t}' AS dataset, '{c}' AS name, count(DISTINCT {c}) AS \"distinct\" FROM b_{t} HAVING count(DISTINCT {c}) >= 2"
            for t, columns in KEY_COLUMNS.items()
            for c in columns
        )
    ),
)
def key_columns(spark, sf_dir):
    facts = keys.column_facts(datasets(spark, sf_dir))
    return keys.key_columns(facts).select("dataset", "name", "distinct")


def overlap_sql() -> str:
    """The columns that hold each value, as written and folded, and what every two share."""
    cells, columns = [], []
    for d, (t, names) in enumerate(KEY_COLUMNS.items()):
        for name in names:
            number, integer = len(columns), 1 if (t, name) in INTEGERS else 0
            cells.append(f"SELECT {number} AS c, CAST({name} AS VARCHAR) AS v FROM b_{t}")
            columns.append(f"({number}, '{t}', '{name}', {d}, {integer}, '{name.split('_')[0]}')")
    return with_business("").rstrip() + f""",
names(c, dataset, name, d, i, stem) AS (VALUES {", ".join(columns)}),
written AS (SELECT c, v, count(*) AS n FROM ({" UNION ALL ".join(cells)}) WHERE trim(v) <> '' GROUP BY c, v),
forms AS (SELECT true AS exact, c, v, n FROM written UNION ALL SELECT false, c, lower(trim(v)), sum(n) FROM written GROUP BY c, lower(trim(v))),
holders AS (SELECT exact, list({{'c': c, 'n': n}}) AS held FROM forms GROUP BY exact, v),
meetings AS (SELECT exact, x.c AS a, y.c AS b, x.n AS n FROM (SELECT exact, held, unnest(held) AS x FROM holders), unnest(held) AS u(y)),
counted AS (SELECT a, b, count(*) FILTER (WHERE exact) AS m_exact, count(*) FILTER (WHERE NOT exact) AS m_ci,
  CAST(coalesce(sum(n) FILTER (WHERE exact), 0) AS BIGINT) AS a_rows_exact, CAST(coalesce(sum(n) FILTER (WHERE NOT exact), 0) AS BIGINT) AS a_rows_ci
  FROM meetings GROUP BY a, b),
alone AS (SELECT a AS c, m_exact AS values_exact, m_ci AS values_ci, a_rows_exact AS filled FROM counted WHERE a = b),
shared AS (SELECT a, b, f.dataset AS from_dataset, f.name AS from_column, t.dataset AS to_dataset, t.name AS to_column, m_exact, m_ci,
  a_rows_exact, a_rows_ci, here.values_exact AS a_distinct, here.values_ci AS a_distinct_ci, here.filled AS a_rows
  FROM counted JOIN names f ON f.c = a JOIN names t ON t.c = b JOIN alone here ON here.c = a JOIN alone there ON there.c = b
  WHERE f.d <> t.d AND m_ci > 0 AND (f.i + t.i = 0 OR substr(f.stem, 1, 3) = substr(t.stem, 1, 3))
  AND (m_ci >= 20 OR 2 * m_ci >= least(here.values_ci, there.values_ci)))"""


OVERLAP = overlap_sql()
SHOWN = ["from_dataset", "from_column", "to_dataset", "to_column"]
COUNTS = ["m_exact", "m_ci", "a_rows_exact", "a_rows_ci", "a_distinct", "a_distinct_ci", "a_rows"]


def _overlap(spark, sf_dir):
    """The overlap of the business datasets, and their key columns as local rows."""
    found = datasets(spark, sf_dir)
    counted = keys.count_keys(found)
    columns = keys.settled(keys.key_columns(keys.column_facts(found, keys.profiles(found, counted))))
    rows = columns.orderBy("i").collect()
    return overlap.key_overlap({d.id: d.df for d in found}, rows, index=counted.index(rows)), columns


def _named(df, columns):
    ends = columns.select("i", "dataset", "name")
    a = ends.toDF("a", "from_dataset", "from_column")
    b = ends.toDF("b", "to_dataset", "to_column")
    return df.join(F.broadcast(a), "a").join(F.broadcast(b), "b")


@register("key_overlap", OVERLAP + f" SELECT {', '.join(SHOWN + COUNTS)} FROM shared")
def key_overlap(spark, sf_dir):
    shared, columns = _overlap(spark, sf_dir)
    return _named(shared, columns).select(*SHOWN, *COUNTS)


@register(
    "link_candidates",
    OVERLAP
    + f""", own AS ({own_sql()}), alt AS ({" UNION ALL ".join(
        f"SELECT '{t}' AS dataset, 'account_code' AS name WHERE {unique_sql(t, 'account_code')}" for t in ("customers", "contacts"))}),
facts AS (SELECT s.*, oa.key IS NOT DISTINCT FROM s.from_column AS a_own, ob.key IS NOT DISTINCT FROM s.to_column AS b_own,
  ab.name IS NOT NULL AS b_alt, na.i = 1 OR nb.i = 1 AS ints, na.stem AS sa, nb.stem AS sb, a_rows_exact < a_rows_ci AS fold
  FROM shared s JOIN names na ON na.c = s.a JOIN names nb ON nb.c = s.b LEFT JOIN own oa ON oa.dataset = s.from_dataset
  LEFT JOIN own ob ON ob.dataset = s.to_dataset LEFT JOIN alt ab ON ab.dataset = s.to_dataset AND ab.name = s.to_column)
SELECT {", ".join(SHOWN)}, CASE WHEN fold THEN m_ci ELSE m_exact END AS shared, CASE WHEN fold THEN a_rows_ci ELSE a_rows_exact END AS matched
FROM facts WHERE (b_own OR b_alt) AND NOT (b_alt AND a_own) AND (NOT ints OR sa = sb OR (least(length(sa), length(sb)) >= 3
  AND (starts_with(sa, sb) OR starts_with(sb, sa)))) AND (CASE WHEN fold THEN m_ci / a_distinct_ci ELSE m_exact / a_distinct END >= 0.8
  OR CASE WHEN fold THEN a_rows_ci ELSE a_rows_exact END / a_rows >= 0.9)""",
)
def link_candidates(spark, sf_dir):
    shared, columns = _overlap(spark, sf_dir)
    return _named(overlap.link_candidates(shared, columns), columns).select(*SHOWN, "shared", "matched")


SYSTEM = "CASE WHEN {0} = 'contacts' THEN 'crm' ELSE 'app' END"


@register(
    "edge_classes",
    ORACLES["link_candidates"].rsplit("\nSELECT ", 1)[0]
    + f"""
, kept AS (SELECT *, CASE WHEN fold THEN m_ci ELSE m_exact END AS same, CASE WHEN fold THEN a_rows_ci ELSE a_rows_exact END AS matched,
  CASE WHEN fold THEN a_distinct_ci ELSE a_distinct END AS dist, a_distinct = a_rows AS a_unique,
  {SYSTEM.format("from_dataset")} <> {SYSTEM.format("to_dataset")} AS across FROM facts
  WHERE (b_own OR b_alt) AND NOT (b_alt AND a_own) AND (NOT ints OR sa = sb)),
classed AS (SELECT *, a_unique AND across AND (m_exact / a_distinct >= 0.8 OR a_rows_exact / a_rows >= 0.9) AS identity,
  from_column = to_column AS same_name FROM kept WHERE same / dist >= 0.8 OR matched / a_rows >= 0.9)
SELECT {", ".join(SHOWN)}, identity, false AS extension, CASE WHEN same_name THEN 'name' ELSE 'values' END AS evidence,
  m_exact AS exact, matched, a_rows AS total, CASE WHEN fold THEN a_rows_ci - a_rows_exact ELSE 0 END AS case_rows
FROM classed WHERE identity OR NOT (a_own OR (from_dataset, from_column) IN (SELECT dataset, name FROM alt))""",
)
def edge_classes(spark, sf_dir):
    shared, columns = _overlap(spark, sf_dir)
    edges = overlap.classify_edges(overlap.link_candidates(overlap.settled(shared), columns))
    flat = overlap.edge_rows(overlap.serial_guard(edges))
    return flat.select(*SHOWN, "identity", "extension", "evidence", "exact", "matched", "total", "case_rows")


def declared_sql(source: str, column: str, target: str, key: str) -> str:
    return (
        f"SELECT '{source}' AS from_dataset, '{column}' AS from_column, '{target}' AS to_dataset, '{key}' AS to_column, "
        f"count(DISTINCT {column}) AS m_exact, count(*) AS a_rows_exact FROM b_{source} WHERE {column} IN (SELECT {key} FROM b_{target})"
    )


@register(
    "declared_keys",
    with_business(
        " UNION ALL ".join(
            declared_sql(*pair)
            for pair in [
                ("order_lines", "line_number", "orders", "order_id"),
                ("orders", "customer_id", "customers", "customer_id"),
                ("customers", "country_id", "countries", "country_id"),
            ]
        ),
        ["customers", "countries", "orders", "order_lines"],
    ),
)
def declared_keys(spark, sf_dir):
    """Foreign keys as a database's catalog names them, found by the overlap of their
    columns whatever the names say."""
    found = datasets(spark, sf_dir, ["customers", "countries", "orders", "order_lines"])
    edges = local_frame(
        spark,
        [
            ("app", "Order_Lines", "line_number", "orders", "order_id"),
            ("app", "orders", "customer_id", "public.customers", "customer_id"),
            ("app", "customers", "country_id", "COUNTRIES", "country_id"),
            ("app", "missing", "id", "orders", "order_id"),
        ],
        keys.EDGES,
    )
    declared = keys.declared_for(found, edges)
    columns = keys.key_columns(keys.column_facts(found), declared)
    rows = columns.orderBy("i").collect()
    number = {(r["dataset"], r["name"]): r["i"] for r in rows}
    pairs = {
        (number[r["from_dataset"], r["from_column"]], number[r["to_dataset"], r["to_column"]])
        for r in declared.collect()
    }
    shared = overlap.key_overlap({d.id: d.df for d in found}, rows, pairs).where("declared")
    return _named(shared, columns).select(*SHOWN, "m_exact", "a_rows_exact")


@register(
    "two_hop_agreement",
    """
SELECT 0 AS k, count(*) AS n, count(*) FILTER (WHERE b.c_custkey IS NOT NULL AND CAST(a.o_custkey AS VARCHAR) = CAST(b.c_custkey AS VARCHAR)) AS agree
FROM orders a LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') b ON CAST(a.o_custkey AS VARCHAR) = CAST(b.c_custkey AS VARCHAR) WHERE a.o_custkey IS NOT NULL
UNION ALL SELECT 1, count(*), count(*) FILTER (WHERE b.l_linenumber IS NOT NULL AND lower(trim(CAST(a.o_custkey AS VARCHAR))) = lower(trim(CAST(b.l_linenumber AS VARCHAR))))
FROM orders a LEFT JOIN lineitem b ON CAST(a.o_orderkey AS VARCHAR) = CAST(b.l_orderkey AS VARCHAR) WHERE a.o_custkey IS NOT NULL""",
)
def two_hop_agreement(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem")}
    tables["customer"] = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    paths = [
        {
            "k": 0, "from": "orders", "direct": "o_custkey", "first": "o_custkey", "via_dataset": "customer",
            "via_key": "c_custkey", "via_column": "c_custkey", "fold_hop": False, "fold_end": False,
        },
        {
            "k": 1, "from": "orders", "direct": "o_custkey", "first": "o_orderkey", "via_dataset": "lineitem",
            "via_key": "l_orderkey", "via_column": "l_linenumber", "fold_hop": False, "fold_end": True,
        },
    ]
    return overlap.two_hop_agreement(tables, paths)


@register(
    "through_anchor",
    with_business(
        "SELECT 0 AS k, count(*) AS n FROM (SELECT concat('K-', CAST(customer_id AS VARCHAR)) AS contact_id FROM b_orders) a "
        "WHERE contact_id IN (SELECT contact_id FROM b_contacts WHERE account_code IN (SELECT account_code FROM b_customers))",
        ["customers", "contacts", "orders"],
    ),
)
def through_anchor(spark, sf_dir):
    tables = business(spark, sf_dir, ["customers", "contacts", "orders"])
    tables["orders"] = tables["orders"].select(F.concat(F.lit("K-"), "customer_id").alias("contact_id"))
    via = {"column": "account_code", "target_dataset": "customers", "target_column": "account_code"}
    link = {
        "k": 0, "from": "orders", "column": "contact_id", "to": "contacts", "to_column": "contact_id",
        "fold": False, "members": {"customers": {"via": None}, "contacts": {"via": via}},
    }
    return overlap.through_anchor(tables, [link])


def suggestion_sql() -> str:
    """What the suggestion says, from plain counts."""
    records = [
        ("country", "countries", "countries from PostgreSQL."),
        ("customer", "customers", "customers from PostgreSQL, joined with S3 contacts."),
        ("order", "orders", "orders from PostgreSQL."),
        ("supplier", "suppliers", "suppliers from PostgreSQL."),
        ("region", "regions", "regions from PostgreSQL."),
        ("part", "parts", "parts from PostgreSQL."),
    ]
    links = [
        ("country", "countries", "region_id", "references", "region", "regions"),
        ("customer", "customers", "country_id", "references", "country", "countries"),
        ("order", "orders", "customer_id", "billed to", "customer", "customers"),
        ("supplier", "suppliers", "country_id", "references", "country", "countries"),
    ]
    parts = [
        "SELECT 'summary' AS section, '' AS id, '6 entities from 8 datasets across 2 sources. Customers combine PostgreSQL and S3.' AS text, "
        "CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS matched"
    ]
    for entity, dataset, text in records:
        n = f"(SELECT count(*) FROM b_{dataset})"
        parts.append(f"SELECT 'record', '{entity}', format('{{:,}}', {n}) || ' {text}', {n}, {n}")
        parts.append(f"SELECT 'member', '{entity}', '{dataset}', {n}, {n}")
    contacts = "(SELECT count(*) FROM b_contacts)"
    same = "(SELECT count(*) FROM b_contacts WHERE account_code IN (SELECT account_code FROM b_customers))"
    parts.append(f"SELECT 'member', 'customer', 'contacts', {contacts}, {same}")
    for entity, dataset, column, verb, target, table_name in links:
        parts.append(
            f"SELECT 'link', '{entity}-{column}-{target}', '{entity} {verb} {target} by name', count({column}), "
            f"count(*) FILTER (WHERE {column} IN (SELECT {column} FROM b_{table_name})) FROM b_{dataset}"
        )
    parts += [
        f"SELECT 'note:merged', 'customer', 'Customer combines PostgreSQL customers with S3 contacts (' || format('{{:,}}', {same}) || ' of ' || "
        f"format('{{:,}}', {contacts}) || ' match).', NULL, NULL",
        f"SELECT 'note:unmatched', 'customer', format('{{:,}}', {contacts} - {same}) || ' S3 contacts don''t match any customer.', NULL, NULL",
        "SELECT 'note:unlinked', 'part', 'Part isn''t linked to the other data.', NULL, NULL",
        "SELECT 'note:unlinked', '', 'order_lines has no unique column to identify its rows, so it isn''t shown as an entity.', NULL, NULL",
    ]
    return with_business(" UNION ALL ".join(parts))


@register("suggest_ontology", suggestion_sql())
def suggest_ontology(spark, sf_dir):
    return suggest.as_rows(spark, suggest.suggest_ontology(datasets(spark, sf_dir)))


CUSTOMER = suggest.Entity(
    "customer",
    "Customer",
    "",
    "record",
    "customers",
    "customer_id",
    0,
    (
        suggest.Member("customers", "customers", "postgres", "customer_id", 0, 0),
        suggest.Member(
            "contacts", "contacts", "s3", "contact_id", 0, 0,
            suggest.Via("account_code", "customers", "account_code"),
        ),
    ),
)


def _columns(tables):
    from ontoweave.functions.kinds import sql_name

    return {i: [(f.name, sql_name(f.dataType)) for f in df.schema.fields] for i, df in tables.items()}


@register(
    "entity_table",
    with_business(
        "SELECT a.*, m.contact_id AS s3_contact_id, m.tier AS s3_tier, lower(trim(CAST(a.account_code AS VARCHAR))) AS account_code_key "
        "FROM b_customers a LEFT JOIN b_contacts m ON m.account_code = a.account_code",
        ["customers", "contacts"],
    ),
)
def entity_table(spark, sf_dir):
    tables = business(spark, sf_dir, ["customers", "contacts"])
    return entities.entity_table(tables, CUSTOMER, _columns(tables), ["account_code"])[0]


@register(
    "normalized_keys",
    with_business(
        "SELECT contact_id, account_code, lower(trim(CAST(account_code AS VARCHAR))) AS account_code_key, "
        "lower(trim(CAST(contact_id AS VARCHAR))) AS contact_id_key FROM b_contacts",
        ["contacts"],
    ),
)
def normalized_keys(spark, sf_dir):
    contacts = business(spark, sf_dir, ["contacts"])["contacts"].drop("tier")
    return entities.with_normalized_keys(contacts, ["account_code", "contact_id"])


@register(
    "one_row_per_entity",
    """
SELECT count(*) = count(DISTINCT l_orderkey) AND count(l_orderkey) = count(*) AS ok FROM lineitem
UNION ALL SELECT count(*) = count(DISTINCT o_orderkey) AND count(o_orderkey) = count(*) FROM orders""",
)
def one_row_per_entity(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return entities.one_row_per_entity(lines, "l_orderkey").unionByName(
        entities.one_row_per_entity(orders, "o_orderkey")
    )


ORDER = TypeDef("Order", "orders", "o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
CUSTOMER_TYPE = TypeDef("Customer", "customer", "c_custkey", ("c_custkey", "c_name", "c_mktsegment"))
LINE = TypeDef("Line", "lineitem", "l_orderkey", ("l_orderkey", "l_quantity"))


@register(
    "type_key_check",
    """
SELECT 'Order' AS type, count(DISTINCT o_orderkey) = count(*) AS passed, concat(CAST(count(*) AS VARCHAR), ' objects; unique non-null key') AS detail, count(*) AS rows FROM orders
UNION ALL SELECT 'Line', count(DISTINCT l_orderkey) = count(*), 'Primary key must be unique and non-null', count(*) FROM lineitem
UNION ALL SELECT 'Bad', false, 'Unknown property nope', NULL""",
)
def type_key_check(spark, sf_dir):
    bad = TypeDef("Bad", "orders", "o_orderkey", ("o_orderkey", "nope"))
    checks = [
        validate.type_key_check(table(spark, sf_dir, t.dataset), t) for t in (ORDER, LINE, bad)
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@register(
    "relationship_coverage",
    """
WITH lines AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY v), parts AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY v)
SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity IN (SELECT v FROM parts)) AS matched,
  (SELECT CAST(sum(lines.n * parts.n) AS BIGINT) FROM lines JOIN parts USING (v)) AS pairs""",
)
def relationship_coverage(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return validate.relationship_coverage(lines, parts, "l_orderkey", "p_partkey", "l_quantity", "p_size")


@register(
    "cardinality",
    """
SELECT CASE WHEN (SELECT count(DISTINCT o_custkey) = count(*) FROM orders) THEN 'one' ELSE 'many' END || '-to-' ||
  CASE WHEN (SELECT count(DISTINCT c_custkey) = count(*) FROM customer) THEN 'one' ELSE 'many' END AS cardinality""",
)
def cardinality(spark, sf_dir):
    return validate.relationship_cardinality(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey"
    )


def report_sql() -> str:
    def keyed(name: str, dataset: str) -> str:
        return (
            f"SELECT 'type' AS kind, '{name}' AS name, true AS passed, CAST(count(*) AS VARCHAR) || ' objects; unique non-null key' AS detail FROM b_{dataset}"
        )

    def related(name: str, dataset: str, key: str, column: str, target: str) -> str:
        hit = f"count(*) FILTER (WHERE {column} IN (SELECT {column} FROM b_{target}))"
        return (
            f"SELECT 'relationship', '{name}', true, {hit} || '/' || count(DISTINCT {key}) || ' source objects matched; many-to-one; ' || "
            f"{hit} || ' relationship pairs' FROM b_{dataset}"
        )

    parts = [
        keyed("Customer", "customers"),
        keyed("Order", "orders"),
        keyed("Country", "countries"),
        "SELECT 'type', 'Broken', false, 'Primary key must be unique and non-null'",
        related("billed to", "orders", "order_id", "customer_id", "customers"),
        related("references", "customers", "customer_id", "country_id", "countries"),
        "SELECT 'relationship', 'bad', false, 'Unknown relationship column'",
        "SELECT 'names', 'Definition identities', true, 'Names must be unique within each asset type'",
        "SELECT 'table', 'Customers (PostgreSQL + S3)', true, 'One row per customer'",
        *[f"SELECT 'catalog', '{d}', true, 'Described'" for d in ("customers", "contacts", "orders", "countries")],
    ]
    return with_business(" UNION ALL ".join(parts), ["customers", "contacts", "orders", "countries"])


@register("validate_bundle", report_sql())
def validate_bundle(spark, sf_dir):
    """The bundle of the suggested ontology, with a type and a relationship that fail."""
    found = datasets(spark, sf_dir, ["customers", "contacts", "orders", "countries"])
    tables = {d.id: d.df for d in found}
    columns = _columns(tables)
    bundle = entities.ontology_bundle(suggest.suggest_ontology(found), columns)
    from dataclasses import replace

    bundle = replace(
        bundle,
        types=(*bundle.types, TypeDef("Broken", "orders", "customer_id", ("customer_id",))),
        relationships=(*bundle.relationships, RelationshipDef("bad", "Broken", "Country", "nope", "country_id")),
    )
    report = validate.validate_bundle(tables, columns, bundle)
    kept = validate.drop_failing(bundle, report)
    again = validate.validate_bundle(tables, columns, kept)
    assert all(c.passed for c in again)
    return validate.report_frame(spark, report)


@register(
    "publish_ontology",
    with_business(
        """SELECT 'object' AS kind, 'Customer' AS name, count(*) AS n FROM b_customers UNION ALL SELECT 'object', 'Order', count(*) FROM b_orders
UNION ALL SELECT 'object', 'Country', count(*) FROM b_countries UNION ALL SELECT 'object', 'Region', count(*) FROM b_regions
UNION ALL SELECT 'object', 'Supplier', count(*) FROM b_suppliers UNION ALL SELECT 'object', 'Part', count(*) FROM b_parts
UNION ALL SELECT 'relation', 'billed to', count(*) FROM b_orders JOIN b_customers USING (customer_id)
UNION ALL SELECT 'relation', 'Customer references', count(*) FROM b_customers JOIN b_countries USING (country_id)
UNION ALL SELECT 'relation', 'Supplier references', count(*) FROM b_suppliers JOIN b_countries USING (country_id)
UNION ALL SELECT 'relation', 'Country references', count(*) FROM b_countries JOIN b_regions USING (region_id)
UNION ALL SELECT 'lineage', d, count(*) FROM (VALUES ('customers'), ('contacts')) v(d) WHERE (SELECT count(*) FROM b_contacts) > 0 GROUP BY d""",
    ),
)
def publish_ontology(spark, sf_dir):
    """From all datasets to records: snapshots, suggestion, checks, merged table, publication.
    One dataset has no key: it is described in the catalog and makes no records."""
    found = datasets(spark, sf_dir)
    store, graph = Snapshots(spark, scratch(spark)), Graph(spark, scratch(spark))
    publish.store_all(store, found)
    bundle = entities.ontology_bundle(suggest.suggest_ontology(found), _columns({d.id: d.df for d in found}))
    publish.publish(store, graph, publish.propose(store, graph, bundle))
    count = F.count(F.lit(1)).alias("n")
    parts = [
        graph.objects().groupBy(F.lit("object").alias("kind"), F.col("type").alias("name")).agg(count),
        graph.relations().groupBy(F.lit("relation").alias("kind"), "name").agg(count),
        store.lineage().groupBy(F.lit("lineage").alias("kind"), F.col("from_id").alias("name")).agg(count),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
