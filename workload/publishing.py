"""Objects, relations, the record graph, labels, generations and people's edits.

The published world: customers, orders and nations as typed records, with "billed to" and
"belongs to" relations, in generation ``g1``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.hashing import digest
from ontoweave.functions.local import local_frame
from ontoweave.operators import edits, graph, objects
from ontoweave.operators.entities import Bundle, RelationshipDef, TypeDef
from ontoweave.operators.dashboards import Dashboard, Widget
from ontoweave.operators.editstore import CREATED, LINKED, EditStore
from ontoweave.operators.objects import Graph, type_id
from ontoweave.operators.publish import propose, publish, show
from ontoweave.operators.snapshots import Snapshots
from ontoweave.operators.validate import validate_bundle
from ontoweave.plans.nodes import Node
from ontoweave.plans.runs import Check, PipelineDef

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


CUSTOMER = TypeDef("Customer", "customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
ORDER = TypeDef("Order", "orders", "o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
NATION = TypeDef("Nation", "nation", "n_nationkey", ("n_nationkey", "n_name", "n_regionkey"))
BILLED = RelationshipDef("billed to", "Order", "Customer", "o_custkey", "c_custkey")
BELONGS = RelationshipDef("belongs to", "Customer", "Nation", "c_nationkey", "n_nationkey")
BUNDLE = Bundle("Sales", types=(CUSTOMER, ORDER, NATION), relationships=(BILLED, BELONGS))
TYPES = {t.name: t for t in BUNDLE.types}


def world(spark, sf_dir, generation="g1") -> tuple[DataFrame, DataFrame]:
    tables = {t.dataset: table(spark, sf_dir, t.dataset) for t in BUNDLE.types}
    made = [objects.objects(tables[t.dataset], t, generation, "v1") for t in BUNDLE.types]
    linked = [
        objects.relations(
            tables[TYPES[r.from_type].dataset], tables[TYPES[r.to_type].dataset], TYPES[r.from_type], TYPES[r.to_type], r, generation
        )
        for r in BUNDLE.relationships
    ]
    return reduce(DataFrame.unionByName, made), reduce(DataFrame.unionByName, linked)


def oid(type_name: str, key: str, prefix: str = "g1_") -> str:
    return f"'{prefix}' || substr(sha256('{type_id(type_name)}:' || CAST({key} AS VARCHAR)), 1, 32)"


WORLD = f"""WITH o AS (
SELECT {oid("Customer", "c_custkey")} AS id, 'Customer' AS type, CAST(c_custkey AS VARCHAR) AS key, c_name AS label, c_mktsegment AS extra, c_acctbal AS number FROM customer
UNION ALL SELECT {oid("Order", "o_orderkey")}, 'Order', CAST(o_orderkey AS VARCHAR), 'Order ' || CAST(o_orderkey AS VARCHAR), o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT {oid("Nation", "n_nationkey")}, 'Nation', CAST(n_nationkey AS VARCHAR), n_name, n_name, NULL FROM nation),
r AS (SELECT 'billed to' AS name, {oid("Order", "o_orderkey")} AS from_id, {oid("Customer", "c_custkey")} AS to_id FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'belongs to', {oid("Customer", "c_custkey")}, {oid("Nation", "n_nationkey")} FROM customer JOIN nation ON c_nationkey = n_nationkey),
ends AS (SELECT from_id AS id, to_id AS neighbor FROM r UNION ALL SELECT to_id, from_id FROM r),
deg AS (SELECT id, count(*) AS links FROM ends GROUP BY 1)
"""


@register("objects", WORLD + "SELECT id, type, key, extra, 'v1' AS source_version FROM o")
def published_objects(spark, sf_dir):
    made, _ = world(spark, sf_dir)
    extra = F.coalesce(*[F.try_element_at("base", F.lit(c)) for c in ("c_mktsegment", "o_orderstatus", "n_name")])
    return made.select("id", "type", "key", extra.alias("extra"), "source_version")


@register("relations", WORLD + "SELECT name, from_id, to_id FROM r")
def published_relations(spark, sf_dir):
    return world(spark, sf_dir)[1].drop("generation")


@register("object_counts", WORLD + "SELECT type, count(*) AS objects FROM o GROUP BY 1")
def object_counts(spark, sf_dir):
    return objects.object_counts(world(spark, sf_dir)[0])


@register("link_counts", WORLD + "SELECT id, links FROM deg")
def link_counts(spark, sf_dir):
    return objects.link_counts(world(spark, sf_dir)[1])


TOP = "top AS (SELECT o.id, coalesce(links, 0) AS degree FROM o LEFT JOIN deg USING (id) ORDER BY 2 DESC, 1 LIMIT 1500)"


@register("top_degree_graph", WORLD + f", {TOP} SELECT id, degree FROM top")
def top_degree_graph(spark, sf_dir):
    return graph.top_graph(*world(spark, sf_dir), limit=1500, published=True)[0].select("id", "degree")


@register(
    "top_degree_edges",
    WORLD + f", {TOP} SELECT name, from_id, to_id FROM r WHERE from_id IN (SELECT id FROM top) AND to_id IN (SELECT id FROM top)",
)
def top_degree_edges(spark, sf_dir):
    return graph.top_graph(*world(spark, sf_dir), limit=1500, published=True)[1]


FOCUS = "g1_" + digest(type_id("Customer") + ":0")[:32]


@register(
    "k_hop",
    WORLD
    + f""", h1 AS (SELECT DISTINCT neighbor AS id FROM ends WHERE id = '{FOCUS}'),
h2 AS (SELECT DISTINCT neighbor AS id FROM ends WHERE id IN (SELECT id FROM h1) AND neighbor <> '{FOCUS}' AND neighbor NOT IN (SELECT id FROM h1))
SELECT * FROM (SELECT '{FOCUS}' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)""",
)
def k_hop(spark, sf_dir):
    return graph.k_hop(world(spark, sf_dir)[1], FOCUS, 2)


@register(
    "neighborhood",
    WORLD
    + f""", h1 AS (SELECT neighbor AS id FROM ends WHERE id = '{FOCUS}' UNION SELECT '{FOCUS}')
SELECT name, from_id, to_id FROM r WHERE from_id IN (SELECT id FROM h1) AND to_id IN (SELECT id FROM h1)""",
)
def neighborhood(spark, sf_dir):
    return graph.neighborhood(*world(spark, sf_dir), FOCUS, 1)[1]


@register("neighbors", WORLD + "SELECT DISTINCT id, neighbor FROM ends JOIN o USING (id) WHERE type = 'Nation'")
def neighbors(spark, sf_dir):
    made, linked = world(spark, sf_dir)
    return graph.neighbors(linked, made.where("type = 'Nation'"))


def labelled(spark, sf_dir):
    made, linked = world(spark, sf_dir)
    return objects.with_labels(made, BUNDLE.types), linked


@register("record_label", WORLD + "SELECT id, label FROM o")
def record_label(spark, sf_dir):
    return labelled(spark, sf_dir)[0].select("id", "label")


@register(
    "record_search",
    WORLD + "SELECT id, label FROM o WHERE type = 'Customer' AND extra = 'BUILDING' AND contains(lower(label), 'customer#00000000')",
)
def record_search(spark, sf_dir):
    records, _ = labelled(spark, sf_dir)
    found = graph.search(records, "Customer#00000000", "base")
    return graph.narrow(found, "Customer", "c_mktsegment", "BUILDING", "base").select("id", "label")


@register(
    "record_sort",
    WORLD + "SELECT id, label, number FROM o WHERE type = 'Order' ORDER BY number DESC, label, id LIMIT 100 OFFSET 20",
)
def record_sort(spark, sf_dir):
    records, _ = labelled(spark, sf_dir)
    page, _ = graph.list_records(
        records, type_name="Order", sort="o_totalprice", descending=True, offset=20, limit=100, values="base"
    )
    number = F.element_at("base", "o_totalprice").cast("double")
    return page.select("id", "label", number.alias("number"))


@register(
    "record_links",
    WORLD + "SELECT id, links FROM (SELECT o.id, label, coalesce(links, 0) AS links FROM o LEFT JOIN deg USING (id) WHERE type <> 'Order') "
    "ORDER BY links DESC, label, id LIMIT 60",
)
def record_links(spark, sf_dir):
    """Records by their number of links, from the whole graph."""
    records, linked = labelled(spark, sf_dir)
    page, _ = graph.list_records(
        records.where("type <> 'Order'"), objects.link_counts(linked), sort="links", descending=True, limit=60, values="base"
    )
    return page.select("id", "links")


def audit_of(made: DataFrame) -> DataFrame:
    """An audit entry per order, naming the record it changed."""
    return made.where("type = 'Order'").select(
        F.concat(F.lit("audit_"), "key").alias("id"),
        F.concat(F.lit("Updated "), "name").alias("name"),
        F.concat(F.lit("g0_"), object_ref("Customer", "o_custkey")).alias("object_id"),
        F.lit(None).cast("string").alias("logical_id"),
        F.element_at("base", "o_orderdate").alias("created_at"),
    )


def object_ref(type_name: str, column: str):
    return objects.object_id(type_name, F.element_at("base", column))


@register(
    "record_detail",
    WORLD
    + f""", h AS (SELECT 'audit_' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 0)
SELECT 'record' AS part, id FROM o WHERE id = '{FOCUS}' UNION ALL SELECT DISTINCT 'related', neighbor FROM ends WHERE id = '{FOCUS}'
UNION ALL SELECT 'history', id FROM h""",
)
def record_detail(spark, sf_dir):
    made, linked = world(spark, sf_dir)
    records = edits.effective_records(made, local_frame(spark, [], edits.OVERLAY))
    parts = graph.record_detail(records, linked, audit_of(made), FOCUS)
    return reduce(DataFrame.unionByName, [df.select(F.lit(p).alias("part"), "id") for p, df in parts.items()])


# Generations.


def _tables(spark, sf_dir):
    return {t.dataset: table(spark, sf_dir, t.dataset) for t in BUNDLE.types}


@register(
    "publish_generation",
    WORLD
    + "SELECT 'g1' AS generation, (SELECT count(*) FROM o) AS objects, (SELECT count(*) FROM r) AS relations, CAST(NULL AS VARCHAR) AS previous",
)
def publish_generation(spark, sf_dir):
    store = Graph(spark, scratch(spark))
    versions = {t.dataset: "v1" for t in BUNDLE.types}
    generation = store.publish(
        BUNDLE, _tables(spark, sf_dir), expected_hash=objects.bundle_hash(BUNDLE), recorded=versions, versions=versions, generation="g1"
    )
    counts = objects.publication_counts(store.objects(), store.relations(), BUNDLE, {}, generation)
    previous = F.lit(store.pointer()["previous"]).cast("string").alias("previous")
    return counts.select(F.lit(generation).alias("generation"), F.col("records").alias("objects"), "relations", previous)


@register(
    "rollback",
    WORLD
    + "SELECT type, count(*) AS objects, 'g3' AS generation, 'g2' AS previous FROM o GROUP BY 1",
)
def rollback(spark, sf_dir):
    """Publish, publish fewer types, and go back to the first definitions."""
    store = Graph(spark, scratch(spark))
    tables = _tables(spark, sf_dir)
    fewer = Bundle("Customers", types=(CUSTOMER,))
    store.publish(BUNDLE, tables, generation="g1")
    store.publish(fewer, tables, base="g1", generation="g2")
    bundles = {objects.bundle_hash(b): b for b in (BUNDLE, fewer)}
    store.rollback(bundles, tables, lambda b: validate_bundle(tables, {}, b), generation="g3")
    row = store.pointer()
    return objects.object_counts(store.objects()).select(
        "type", "objects", F.lit(row["generation"]).alias("generation"), F.lit(row["previous"]).alias("previous")
    )


@register(
    "visible_generation",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'g1' END AS generation FROM nation WHERE n_regionkey IN (0, 2, 3, 4)",
)
def visible_generation(spark, sf_dir):
    region = F.col("n_regionkey")
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(region == 0, "g1").when(region == 1, "g0").alias("generation")
    )
    return objects.visible(rows, "g1")


@register(
    "publication_counts",
    WORLD
    + """SELECT (SELECT count(*) FROM o WHERE type <> 'Order') AS records, (SELECT count(*) FROM r WHERE name = 'belongs to') AS relations,
  (SELECT count(*) FROM o) AS total_records, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS estimated_relations""",
)
def publication_counts(spark, sf_dir):
    """Progress of a publication that has not written its orders yet."""
    made, linked = world(spark, sf_dir)
    rows = {i: df.count() for i, df in _tables(spark, sf_dir).items()}
    return objects.publication_counts(
        made.where("type <> 'Order'"), linked.where("name = 'belongs to'"), BUNDLE, rows, "g1"
    )


# Edits. Overlays come from the data: negative balances were corrected by hand.


def overlays_of(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return customers.select(
        objects.object_id("Customer", F.col("c_custkey")).alias("logical_id"),
        F.create_map(
            F.lit("c_acctbal"), F.lit("0.0"), F.lit("c_mktsegment"), F.lit(None).cast("string")
        ).alias("values"),
        F.lit(1).cast("bigint").alias("revision"),
    )


@register(
    "effective_records",
    f"""
SELECT {oid("Customer", "c_custkey")} AS id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance,
  CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, c_name AS name, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM customer""",
)
def effective_records(spark, sf_dir):
    made, _ = world(spark, sf_dir)
    value = lambda c: F.element_at("effective", F.lit(c))
    return edits.effective_records(made.where("type = 'Customer'"), overlays_of(spark, sf_dir)).select(
        "id",
        value("c_acctbal").cast("double").alias("balance"),
        value("c_mktsegment").alias("segment"),
        value("c_name").alias("name"),
        "revision",
    )


def edits_of(spark, sf_dir) -> DataFrame:
    """One edit per customer, of several kinds: fine, stale, of the key, of a wrong type, a
    repeat of another request, and two on one record."""
    customers = table(spark, sf_dir, "customer")
    kind = F.col("c_mktsegment")
    values = (
        F.when(kind == "BUILDING", F.create_map(F.lit("c_custkey"), F.lit("1")))
        .when(kind == "MACHINERY", F.create_map(F.lit("c_acctbal"), F.lit("a lot")))
        .otherwise(F.create_map(F.lit("c_acctbal"), F.lit("5.5")))
    )
    return customers.select(
        F.concat(F.lit("e"), "c_custkey").alias("edit_id"),
        objects.object_id("Customer", F.col("c_custkey")).alias("logical_id"),
        values.alias("values"),
        F.when(kind == "HOUSEHOLD", 7).otherwise(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).cast("bigint").alias("revision"),
        F.concat(F.lit("request-"), "c_custkey").alias("idempotency_key"),
        (kind == "FURNITURE").alias("revert"),
        F.lit("ada").alias("actor"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("submitted_at"),
    )


DONE = "idempotency_key string, request_hash string"


def _applied(spark, sf_dir):
    made, _ = world(spark, sf_dir)
    kinds = {"Customer": edits.value_kinds(table(spark, sf_dir, "customer"))}
    return edits.apply_edits(
        made, overlays_of(spark, sf_dir), edits_of(spark, sf_dir), [CUSTOMER], local_frame(spark, [], DONE), kinds
    )


@register(
    "apply_edits",
    f"""
SELECT 'refused' AS outcome, {oid("Customer", "c_custkey", "")} AS logical_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Invalid editable field'
  WHEN 'MACHINERY' THEN 'Invalid type for a field' ELSE 'Object was edited; refresh the preview' END AS detail, CAST(NULL AS BIGINT) AS revision
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT 'overlay', {oid("Customer", "c_custkey", "")}, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN '5.5' ELSE '0.0' END,
  CASE WHEN c_mktsegment IN ('FURNITURE', 'AUTOMOBILE') THEN CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END ELSE 1 END
FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE') OR c_acctbal < 0""",
)
def apply_edits(spark, sf_dir):
    overlays, refused, _ = _applied(spark, sf_dir)
    return overlays.select(
        F.lit("overlay").alias("outcome"),
        "logical_id",
        F.try_element_at("values", F.lit("c_acctbal")).alias("detail"),
        "revision",
    ).unionByName(
        refused.select(
            F.lit("refused").alias("outcome"), "logical_id", F.col("reason").alias("detail"), F.lit(None).cast("bigint").alias("revision")
        )
    )


@register(
    "audit_log",
    f"""
SELECT 'action_' || sha256('request-' || CAST(c_custkey AS VARCHAR)) AS id, 'Updated Customer ' || CAST(c_custkey AS VARCHAR) AS name, 'ada' AS actor,
  {oid("Customer", "c_custkey")} AS object_id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS before, '5.5' AS after
FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')""",
)
def audit_log(spark, sf_dir):
    number = F.element_at("before", "c_acctbal").cast("double")
    after = F.element_at("values", "c_acctbal").alias("after")
    return _applied(spark, sf_dir)[2].select("id", "name", "actor", "object_id", number.alias("before"), after)


@register(
    "edit_preview",
    f"""
SELECT {oid("Customer", "c_custkey", "")} AS logical_id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS before, CAST(9.5 AS DOUBLE) AS after,
  CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def edit_preview(spark, sf_dir):
    made, _ = world(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        objects.object_id("Customer", F.col("c_custkey")).alias("logical_id"),
        F.create_map(F.lit("c_acctbal"), F.lit("9.5")).alias("values"),
    )
    shown = edits.preview_edits(made, overlays_of(spark, sf_dir), wanted)
    number = lambda c: F.element_at(c, "c_acctbal").cast("double")
    return shown.select("logical_id", number("before").alias("before"), number("after").alias("after"), "revision")


@register(
    "manual_objects",
    WORLD
    + f"""SELECT id, type, key, false AS manual FROM o WHERE type = 'Customer'
UNION ALL SELECT {oid("Customer", "'new-' || CAST(s_suppkey AS VARCHAR)")}, 'Customer', 'new-' || CAST(s_suppkey AS VARCHAR), true FROM supplier WHERE s_acctbal < 0""",
)
def manual_objects(spark, sf_dir):
    """Customers created by hand from suppliers; those with a known key are left to it."""
    made, _ = world(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier")
    key = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("new-"), "s_suppkey")).otherwise(F.col("s_suppkey").cast("string"))
    created = edits.manual_from(suppliers.select(key.alias("c_custkey"), F.col("s_name").alias("c_name")), CUSTOMER)
    merged = edits.with_manual_objects(made.where("type = 'Customer'"), created, ["Customer"], "g1")
    return merged.select("id", "type", "key", "manual")


@register(
    "relation_overrides",
    WORLD
    + f"""SELECT name, from_id, to_id FROM r WHERE NOT (name = 'belongs to' AND from_id IN (SELECT {oid("Customer", "c_custkey")} FROM customer WHERE c_acctbal < 0))
UNION ALL SELECT 'escalated to', {oid("Customer", "c_custkey")}, {oid("Nation", "n_nationkey")} FROM customer JOIN nation ON n_nationkey = c_custkey WHERE c_acctbal > 9000""",
)
def relation_overrides(spark, sf_dir):
    """Customers with a negative balance were unlinked from their nation; the best ones were
    linked to the nation that shares their key, where there is one."""
    made, linked = world(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    logical = lambda t, c: objects.object_id(t, F.col(c))
    undone = customers.where("c_acctbal < 0").select(
        logical("Customer", "c_custkey").alias("from_logical_id"),
        logical("Nation", "c_nationkey").alias("to_logical_id"),
        F.lit("belongs to").alias("name"),
        F.lit(False).alias("enabled"),
    )
    forced = customers.where("c_acctbal > 9000").select(
        logical("Customer", "c_custkey").alias("from_logical_id"),
        logical("Nation", "c_custkey").alias("to_logical_id"),
        F.lit("escalated to").alias("name"),
        F.lit(True).alias("enabled"),
    )
    return edits.with_relation_edits(linked, undone.unionByName(forced), made, "g1").drop("generation")


def value_edits(customers: DataFrame, segment: str, balance: str, batch: str) -> DataFrame:
    """Everybody in a segment gets a balance, as an edit of the record nobody has edited."""
    return customers.where(F.col("c_mktsegment") == segment).select(
        F.concat(F.lit(batch), "c_custkey").alias("edit_id"),
        objects.object_id("Customer", F.col("c_custkey")).alias("logical_id"),
        F.create_map(F.lit("c_acctbal"), F.lit(balance)).alias("values"),
        F.lit(0).cast("bigint").alias("revision"),
        F.concat(F.lit(f"{batch}-request-"), "c_custkey").alias("idempotency_key"),
        F.lit(False).alias("revert"),
        F.lit("ada").alias("actor"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("submitted_at"),
    )


@register(
    "stored_edits",
    """
SELECT 'record' AS outcome, CAST(c_custkey AS VARCHAR) AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 5.5 WHEN 'FURNITURE' THEN 7.25 ELSE c_acctbal END AS balance,
  CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 1 ELSE 0 END AS BIGINT) AS revision, CAST(NULL AS VARCHAR) AS detail FROM customer
UNION ALL SELECT 'record', 'new-' || CAST(s_suppkey AS VARCHAR), s_acctbal, 0, NULL FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'refused', CAST(c_custkey AS VARCHAR), NULL, NULL, 'Object was edited; refresh the preview' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'audit', CAST(c_custkey AS VARCHAR), c_acctbal, NULL, 'ada' FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')
UNION ALL SELECT 'link', CAST(c_custkey AS VARCHAR), NULL, NULL, 'escalated to' FROM customer JOIN nation ON n_nationkey = c_custkey WHERE c_acctbal > 0""",
)
def stored_edits(spark, sf_dir):
    """Publish, edit in batches (one sent twice, one on an old revision), create objects and links,
    and publish again: what the new generation's records, its links and the audit then say."""
    tables, root = _tables(spark, sf_dir), scratch(spark)
    graph_store, stored = Graph(spark, f"{root}/graph"), EditStore(spark, f"{root}/edits")
    graph_store.publish(BUNDLE, tables, generation="g1")
    records = graph_store.objects()
    kinds = {"Customer": edits.value_kinds(tables["customer"])}
    batches = [("BUILDING", "5.5", "a"), ("BUILDING", "5.5", "a"), ("FURNITURE", "7.25", "b"), ("BUILDING", "9", "c")]
    refused = [stored.apply(records, value_edits(tables["customer"], *b), [CUSTOMER], kinds) for b in batches][-1]
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    key = F.concat(F.lit("new-"), "s_suppkey")
    made = suppliers.select(
        key.alias("edit_id"), F.lit("Customer").alias("type"), key.alias("key"),
        F.create_map(F.lit("c_custkey"), key, F.lit("c_acctbal"), F.col("s_acctbal").cast("string")).alias("values"),
        key.alias("idempotency_key"), F.lit("ada").alias("actor"), F.lit("2024-02-01").cast("timestamp").alias("submitted_at"),
    )
    stored.create(records, made.select(*[c.split()[0] for c in CREATED.split(", ")]), [CUSTOMER])
    joined = tables["customer"].where("c_acctbal > 0").join(tables["nation"], F.col("c_custkey") == F.col("n_nationkey"))
    links = joined.select(
        F.concat(F.lit("l"), "c_custkey").alias("edit_id"), objects.object_id("Customer", F.col("c_custkey")).alias("from_logical_id"),
        objects.object_id("Nation", F.col("n_nationkey")).alias("to_logical_id"), F.lit("escalated to").alias("name"),
        F.lit(True).alias("enabled"), F.lit(0).cast("bigint").alias("revision"), F.concat(F.lit("link-"), "c_custkey").alias("idempotency_key"),
        F.lit("ada").alias("actor"), F.lit("2024-02-01").cast("timestamp").alias("submitted_at"),
    )
    stored.link(records, links.select(*[c.split()[0] for c in LINKED.split(", ")]))
    graph_store.publish(BUNDLE, tables, base="g1", generation="g2", stored=stored)

    people = graph_store.records(stored).where("type = 'Customer'")
    number = lambda c: F.element_at(c, "c_acctbal").cast("double").alias("balance")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    named = people.select("logical_id", "key")
    audit = stored.audit().join(named, "logical_id").select(
        F.lit("audit").alias("outcome"), "key", number("before"), nothing("bigint", "revision"), F.col("actor").alias("detail")
    )
    late = refused.join(named, "logical_id").select(
        F.lit("refused").alias("outcome"), "key", nothing("double", "balance"), nothing("bigint", "revision"), F.col("reason").alias("detail")
    )
    linked = graph_store.links(stored).where("name = 'escalated to'")
    linked = linked.join(people.select(F.col("id").alias("from_id"), "key"), "from_id").select(
        F.lit("link").alias("outcome"), "key", nothing("double", "balance"), nothing("bigint", "revision"), F.col("name").alias("detail")
    )
    shown = people.select(F.lit("record").alias("outcome"), "key", number("effective"), "revision", nothing("string", "detail"))
    return reduce(DataFrame.unionByName, [shown, late, audit, linked])


PAID = PipelineDef(
    "pipeline_paid",
    "Paid",
    (
        Node("in", "source", dataset="orders"),
        Node("done", "filter", ("in",), {"condition": "o_orderstatus = 'F'"}),
        Node("out", "aggregate", ("done",), {"groupBy": ["o_custkey"], "metrics": {"paid": "sum(o_totalprice)", "orders": "count(*)"}}),
    ),
    (
        Check("a customer each", "SELECT count(*) = count(DISTINCT o_custkey) FROM output"),
        Check("no order lost", "SELECT (SELECT sum(orders) FROM output) = (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')"),
    ),
)
SEGMENTS = PipelineDef(
    "pipeline_segments",
    "Segments",
    (
        Node("paid", "source", dataset="pipeline_paid"),
        Node("who", "source", dataset="customer"),
        Node("both", "join", ("paid", "who"), {"on": "a.o_custkey = b.c_custkey", "select": "b.c_mktsegment AS segment, a.paid AS paid"}),
    ),
)
NEVER = PipelineDef("pipeline_never", "Never", PAID.nodes, (Check("impossible", "SELECT min(paid) < 0 FROM output"),))
BOARD = Dashboard(
    "Sales",
    (
        Widget("Paid by segment", "metric", "SELECT s.segment, sum(s.paid) AS paid FROM Segments s GROUP BY 1", ("pipeline_segments",), x="s.segment"),
        Widget("Never", "table", "SELECT * FROM Never", ("pipeline_never",)),
    ),
)


@register(
    "bundle_pipelines",
    """
SELECT c_mktsegment AS segment, sum(paid) AS paid, 'bar' AS shown, 'Paid, Segments' AS pipelines, 'Paid by segment' AS widgets
FROM (SELECT o_custkey, sum(o_totalprice) AS paid FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def bundle_pipelines(spark, sf_dir):
    """A bundle with node graphs that read each other, one whose check fails, and a dashboard: what
    the published widget shows, and which definitions were published."""
    root = scratch(spark)
    store, graph_store = Snapshots(spark, f"{root}/store"), Graph(spark, f"{root}/graph")
    for name, df in _tables(spark, sf_dir).items():
        store.commit(name, name, df, "v1")
    bundle = Bundle("Sales", types=(CUSTOMER, ORDER, NATION), relationships=(BILLED,), pipelines=(SEGMENTS, NEVER, PAID), dashboards=(BOARD,))
    proposal = propose(store, graph_store, bundle)
    publish(store, graph_store, proposal)
    rows, widget = show(store, graph_store, "Sales", "Paid by segment")
    names = sorted(p.name for p in proposal.bundle.pipelines)
    titles = [w.title for d in graph_store.dashboards() for w in d.widgets]
    return rows.select(
        "segment", "paid", F.lit(widget.type).alias("shown"), F.lit(", ".join(names)).alias("pipelines"), F.lit(", ".join(titles)).alias("widgets")
    )


@register(
    "published_detail",
    WORLD
    + f"""SELECT 'record' AS part, id FROM o WHERE id = '{FOCUS}' UNION ALL SELECT DISTINCT 'related', neighbor FROM ends WHERE id = '{FOCUS}'""",
)
def published_detail(spark, sf_dir):
    """One record of a published generation, read by both copies of the relations."""
    store = Graph(spark, scratch(spark))
    store.publish(BUNDLE, _tables(spark, sf_dir), generation="g1")
    parts = graph.record_detail(store.objects(), store.relations(), audit_of(store.objects()), FOCUS, incoming=store.relations_to())
    return reduce(DataFrame.unionByName, [parts[p].select(F.lit(p).alias("part"), "id") for p in ("record", "related")])
