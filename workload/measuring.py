"""Metrics, trends, breakdowns, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.operators import dashboards, metrics, profile
from ontoweave.operators.metrics import MetricSpec
from ontoweave.operators.snapshots import Snapshots

from .data import business, scratch, table, with_business

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def facts_of(df, *names):
    """Profile facts of the columns a metric uses."""
    return profile.facts_by_name(profile.profile_columns(df, only=[n for n in names if n]))


def run(spec: MetricSpec, rounded: bool = True):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, spec.dataset)
        used = (spec.column, spec.time_column, spec.group_by, spec.filter and spec.filter[0])
        out = metrics.metric(df, facts_of(df, *dict.fromkeys(used)) if spec.group_by or spec.column else {}, spec, metrics.SCREEN)
        values = [c for c in ("value", "previous") if c in out.columns]
        return out.withColumns({c: F.round(c, 2) for c in values})

    return query


QUERIES["metric_kpi"] = run(
    MetricSpec("kpi", "orders", "sum", "o_totalprice", filter=("o_orderstatus", "f"), scale="cents")
)
ORACLES["metric_kpi"] = """
SELECT round(CAST(sum(TRY_CAST(o_totalprice AS DOUBLE)) / 100.0 AS DOUBLE), 2) AS value FROM orders
WHERE lower(CAST(o_orderstatus AS VARCHAR)) = lower('f')"""
QUERIES["metric_kpi_distinct"] = run(MetricSpec("kpi", "events", "count_distinct", "user_id"))
ORACLES["metric_kpi_distinct"] = "SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM events"


def trend_sql(grain: str, label: str, measure: str, source: str, time: str, where: str = "", zero: bool = True) -> str:
    """Every period that holds a day between the first and the last row, the newest 24 of
    them, each measured by a query of its own."""
    own = f"(SELECT {measure} FROM {source} WHERE date_trunc('{grain}', {time}) = period {where})"
    value = f"coalesce({own}, 0)" if zero else own
    return f"""
WITH ends AS (SELECT CAST(min({time}) AS DATE) AS low, CAST(max({time}) AS DATE) AS high FROM {source} WHERE {time} IS NOT NULL {where}),
calendar AS (SELECT DISTINCT date_trunc('{grain}', day) AS period FROM (SELECT unnest(range(low, high + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM ends))
SELECT strftime(period, '{label}') AS label, round(CAST({value} AS DOUBLE), 2) AS value FROM calendar
WHERE period > (SELECT max(period) FROM calendar) - 24 * INTERVAL 1 {grain}"""


QUERIES["metric_trend_month"] = run(MetricSpec("trend", "orders", "sum", "o_totalprice", "o_orderdate"))
ORACLES["metric_trend_month"] = trend_sql("month", "%Y-%m", "sum(o_totalprice)", "orders", "o_orderdate")
QUERIES["metric_trend_week"] = run(
    MetricSpec("trend", "orders", time_column="o_orderdate", grain="week", filter=("o_orderpriority", "1-URGENT"))
)
ORACLES["metric_trend_week"] = trend_sql(
    "week", "%Y-%m-%d", "count(*)", "orders", "o_orderdate", "AND lower(o_orderpriority) = lower('1-URGENT')"
)
QUERIES["metric_trend_day"] = run(MetricSpec("trend", "events", "avg", "value", "ts", grain="day"))
ORACLES["metric_trend_day"] = trend_sql("day", "%Y-%m-%d", "avg(value)", "events", "ts", zero=False)

QUERIES["metric_kpi_30d"] = run(
    MetricSpec("kpi", "orders", "sum", "o_totalprice", "o_orderdate", filter=("o_orderstatus", "O"))
)
ORACLES["metric_kpi_30d"] = """
WITH aged AS (SELECT o_totalprice, o_orderstatus = 'O' AS counted, o_orderdate, max(o_orderdate) OVER () AS newest FROM orders)
SELECT round(sum(CASE WHEN counted AND newest - o_orderdate < INTERVAL 30 DAY THEN o_totalprice END), 2) AS value,
  round(sum(CASE WHEN counted AND newest - o_orderdate >= INTERVAL 30 DAY AND newest - o_orderdate < INTERVAL 60 DAY THEN o_totalprice END), 2) AS previous,
  strftime(max(newest), '%Y-%m-%d') AS as_of FROM aged"""

QUERIES["metric_breakdown"] = run(MetricSpec("breakdown", "part", "avg", "p_retailprice", group_by="p_brand"))
ORACLES["metric_breakdown"] = """
SELECT label, round(value, 2) AS value FROM (SELECT COALESCE(CAST(p_brand AS VARCHAR), '(none)') AS label, CAST(avg(p_retailprice) AS DOUBLE) AS value
FROM part GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 8)"""


@register(
    "metric_grain",
    """
WITH r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events WHERE lower(event_type) = 'purchase')
SELECT 'month' AS grain, least(24, date_diff('month', date_trunc('month', lo), date_trunc('month', hi)) + 1) AS points FROM r
UNION ALL SELECT 'week', least(24, date_diff('day', date_trunc('week', lo), date_trunc('week', hi)) // 7 + 1) FROM r
UNION ALL SELECT 'day', least(24, date_diff('day', date_trunc('day', lo), date_trunc('day', hi)) + 1) FROM r""",
)
def metric_grain(spark, sf_dir):
    spec = MetricSpec("trend", "events", time_column="ts", filter=("event_type", "Purchase"))
    return metrics.grain_points(table(spark, sf_dir, "events"), spec, metrics.SCREEN)


@register(
    "metric_grain_avg",
    """
WITH hi AS (SELECT max(o_orderdate) AS m FROM orders), v AS (SELECT o_orderdate AS t FROM orders WHERE o_totalprice IS NOT NULL)
SELECT 'month' AS grain, (SELECT count(DISTINCT date_trunc('month', t)) FROM v, hi WHERE t >= date_trunc('month', m) - INTERVAL 23 MONTH) AS points
UNION ALL SELECT 'week', (SELECT count(DISTINCT date_trunc('week', t)) FROM v, hi WHERE t >= date_trunc('week', m) - INTERVAL 161 DAY)
UNION ALL SELECT 'day', (SELECT count(DISTINCT date_trunc('day', t)) FROM v, hi WHERE t >= date_trunc('day', m) - INTERVAL 23 DAY)""",
)
def metric_grain_avg(spark, sf_dir):
    spec = MetricSpec("trend", "orders", "avg", "o_totalprice", "o_orderdate")
    return metrics.grain_points(table(spark, sf_dir, "orders"), spec, metrics.SCREEN)


@register(
    "metric_picks",
    f"""SELECT 'New orders' AS title, 'kpi' AS kind, CAST(NULL AS VARCHAR) AS grain, CAST(NULL AS VARCHAR) AS label,
  CAST(count(*) FILTER (WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'Revenue', 'kpi', NULL, NULL, round(sum(o_totalprice) FILTER (WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY), 2) FROM orders
UNION ALL SELECT 'New orders over time', 'trend', 'month', label, value FROM ({trend_sql("month", "%Y-%m", "count(*)", "orders", "o_orderdate")})
UNION ALL SELECT 'Orders by status', 'breakdown', NULL, o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'Orders by priority', 'breakdown', NULL, o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderpriority""",
)
def metric_picks(spark, sf_dir):
    """Metrics picked from the schema of the business datasets, run and kept if usable."""
    tables = business(spark, sf_dir, ["orders", "customers", "parts"])
    facts = {i: profile.facts_by_name(profile.profile_columns(df)) for i, df in tables.items()}
    kept, dropped = metrics.run_specs(tables, facts, metrics.computed_specs(tables, facts))
    rows = [
        (r.spec.title, r.spec.kind, r.spec.grain, row.asDict().get("label"), round(row["value"], 2))
        for r in metrics.merge_picks([], kept)
        for row in r.rows
    ]
    return profile.small(
        tables["orders"], rows, "title string, kind string, grain string, label string, value double"
    )


@register(
    "metric_refresh",
    """
SELECT 'orders' AS metric_id, 'orders' AS dataset_id, 'v2' AS version, CAST(NULL AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value,
  CAST(NULL AS DOUBLE) AS previous, true AS ran_again FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'segments', 'customers', 'v1', c_mktsegment, count(*), NULL, false FROM customer GROUP BY c_mktsegment""",
)
def metric_refresh(spark, sf_dir):
    """Values before and after one of two datasets changes; only its metric runs again."""
    store = Snapshots(spark, scratch(spark))
    orders, customers = (table(spark, sf_dir, t) for t in ("orders", "customer"))
    store.commit("orders", "Orders", orders, "v1")
    store.commit("customers", "Customers", customers, "v1")
    specs = {
        "orders": MetricSpec("kpi", "orders"),
        "segments": MetricSpec("breakdown", "customers", group_by="c_mktsegment"),
    }
    ids = ["orders", "customers"]

    def state():
        facts = {i: profile.facts_by_name(store.columns(i)) for i in ids}
        return {i: store.active(i) for i in ids}, facts, store.registry()

    before, _ = metrics.refresh_metrics(specs, *state(), None)
    store.commit("orders", "Orders", orders.where("o_orderstatus = 'F'"), "v2")
    after, again = metrics.refresh_metrics(specs, *state(), before)
    return after.withColumn("ran_again", F.col("metric_id").isin(again))


WIDGET = dashboards.Widget(
    "Orders by priority",
    "metric",
    "SELECT o.o_orderpriority AS priority, count(*) AS orders FROM orders o GROUP BY 1",
    ("orders",),
    x="o.priority",
)


@register("widget_rows", "SELECT o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY 1")
def widget_rows(spark, sf_dir):
    rows, shown = dashboards.widget({"orders": ("orders", table(spark, sf_dir, "orders"))}, WIDGET)
    assert (shown.type, shown.x, shown.y) == ("bar", "priority", "orders")
    return rows


@register(
    "overview_counts",
    "SELECT 'Orders' AS type, count(*) AS records FROM orders UNION ALL SELECT 'Customers', count(*) FROM customer "
    "UNION ALL SELECT 'Parts', count(*) FROM part",
)
def overview_counts(spark, sf_dir):
    names = {"Orders": "orders", "Customers": "customer", "Parts": "part"}
    return dashboards.records_by_type({n: table(spark, sf_dir, t) for n, t in names.items()})


@register(
    "overview_monthly",
    with_business("SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS records FROM b_orders GROUP BY 1", ["orders"]),
)
def overview_monthly(spark, sf_dir):
    tables = business(spark, sf_dir, ["customers", "orders"])
    return dashboards.overview(tables)[-1][2]
