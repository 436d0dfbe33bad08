"""What Spark plans for the operators: pruning, pushdown, no cross joins, no Python."""

import os
import re

import pytest

import workload.registry as registry
from ontoweave.operators import metrics as M
from ontoweave.operators import objects as O
from ontoweave.operators import overlap as V
from ontoweave.operators import profile as P
from ontoweave.operators import query as Q
from ontoweave.plans import nodes
from workload import preparing, publishing
from workload.data import scratch, table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def scans(df) -> list[str]:
    """Columns each file scan reads."""
    return re.findall(r"ReadSchema: struct<(.*)>", formatted(df))


# Without a broadcast threshold Spark broadcasts only what an operator asks it to.
@pytest.fixture
def large(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


LAZY = [
    "node_graph", "node_dedup", "node_join_left", "rejected_rows", "prefilter_aggregate", "profile_columns",
    "dataset_profile", "duplicate_rows", "key_overlap", "two_hop_agreement", "through_anchor", "entity_table",
    "relationship_coverage", "cardinality", "one_row_per_entity", "objects", "relations", "link_counts",
    "top_degree_graph", "neighbors", "record_label", "record_search", "effective_records", "manual_objects",
    "relation_overrides", "metric_trend_month", "metric_kpi_30d", "metric_breakdown", "activity_feed", "collapse_all",
    "collapse_adjacent", "connection_health", "unsourced_connections", "failing_builds", "connection_groups",
    "readiness", "readiness_signature", "quality_diff", "needs_refresh", "publish_generation",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_no_global_window(large, name):
    text = plan(registry.QUERIES[name](large, SF_DIR))
    for refused in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "PythonUDF"):
        assert refused not in text
    assert not re.search(r"Window \[.*\], \[\]", text), "a window over everything is one task"


@pytest.mark.parametrize("name", ["relations", "entity_table", "two_hop_agreement", "connection_health", "node_graph"])
def test_tables_that_grow_are_not_broadcast(large, name):
    assert "BroadcastExchange" not in plan(registry.QUERIES[name](large, SF_DIR))


def test_filters_and_columns_reach_the_scan(spark):
    orders = table(spark, SF_DIR, "orders")
    out = Q.query_frames(
        {"o": ("Orders", orders)}, "SELECT count(*) AS n, max(o_totalprice) AS m FROM Orders", [Q.Filter("o", "o_orderstatus", "F")]
    )
    assert "PushedFilters: [EqualNullSafe(o_orderstatus,F)]" in formatted(out)
    assert scans(out) == ["o_orderstatus:string,o_totalprice:double"]


def test_a_graph_reads_only_what_it_uses(spark):
    out = nodes.build(preparing.GRAPH, {t: table(spark, SF_DIR, t) for t in ("orders", "customer")})
    assert "c_custkey:bigint,c_mktsegment:string" in scans(out)
    assert "o_orderkey:bigint,o_custkey:bigint,o_totalprice:double" in scans(out)
    assert "GreaterThan(o_totalprice,0.0)" in formatted(out)


def test_recent_metrics_prune_by_time(spark):
    orders = table(spark, SF_DIR, "orders")
    path = scratch(spark)
    for time in ("timestamp_ntz", "timestamp", "date"):
        stored = orders.withColumn("o_orderdate", orders["o_orderdate"].cast(time))
        stored.write.parquet(f"{path}/{time}")
        for kind in ("kpi", "trend"):
            spec = M.MetricSpec(kind, "orders", time_column="o_orderdate")
            out = M.metric(spark.read.parquet(f"{path}/{time}"), {}, spec)
            assert "GreaterThan" in formatted(out).split("PushedFilters", 1)[1]


def test_profiling_is_one_scan_and_one_shuffle_of_cells(spark):
    text = plan(P.profile_cells(table(spark, SF_DIR, "lineitem")))
    assert text.count("FileScan") == 1 and text.count("Expand") == 1
    assert text.count("Exchange hashpartitioning") == 2, "cells, then a few rows per column"


def test_relations_read_keys_only(spark):
    tables = {t: table(spark, SF_DIR, t) for t in ("orders", "customer")}
    out = O.relations(tables["orders"], tables["customer"], publishing.ORDER, publishing.CUSTOMER, publishing.BILLED, "g")
    assert sorted(scans(out)) == ["c_custkey:bigint", "o_orderkey:bigint,o_custkey:bigint"]


def test_overlap_joins_no_values(large):
    from ontoweave.operators import keys
    from workload.connecting import datasets

    found = datasets(large, SF_DIR, ["customers", "orders"])
    columns = keys.key_columns(keys.column_facts(found)).orderBy("i").collect()
    text = plan(V.key_overlap({d.id: d.df for d in found}, columns))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    assert text.count("FileScan") == 2, "each dataset is read once"


def test_overlap_deals_out_each_value_once_and_builds_no_table_of_values(large):
    from ontoweave.operators import keys
    from workload.connecting import datasets

    found = datasets(large, SF_DIR, ["customers", "contacts", "orders"])
    columns = keys.key_columns(keys.column_facts(found)).orderBy("i").collect()
    text = plan(V.key_overlap({d.id: d.df for d in found}, columns))
    assert "ObjectHashAggregate" not in text, "a sort brings values together, and can spill"
    assert text.count("Exchange hashpartitioning(lower(trim(v") == 1, "as written and folded at once"


def test_row_hashes_share_no_hash_table_with_cells(spark):
    df = table(spark, SF_DIR, "lineitem")
    assert "xxhash64" not in plan(P.profile_cells(df))
    assert P.profile(df)["duplicate_rows"] == df.count() - df.distinct().count()
