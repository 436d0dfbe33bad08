"""Activity, health, threads, connection groups and change capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.operators import feeds
from ontoweave.operators.snapshots import Snapshots
from ontoweave.streaming import changes

from .data import operations, scratch, table, with_operations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


JOB_FEED = """SELECT id, CASE WHEN type IN ('pipeline', 'sync', 'upload') THEN type ELSE 'job' END AS kind,
  CASE type WHEN 'pipeline' THEN regexp_replace(name, '^Run ', '') WHEN 'sync' THEN regexp_replace(name, '^Sync ', '') ELSE name END AS title,
  status, updated_at AS "at", error, source_id FROM o_jobs"""


@register(
    "activity_feed",
    with_operations(
        f"""SELECT id, kind, title, status, error, source_id AS ref FROM ({JOB_FEED})
UNION ALL SELECT id, 'run', goal, status, NULL, id FROM o_runs
UNION ALL SELECT id, CASE WHEN proposal_id IS NOT NULL AND object_id IS NULL THEN 'publish' ELSE 'edit' END, name, 'succeeded', NULL,
  coalesce(proposal_id, substr(object_id, 4)) FROM o_audits""",
        "jobs",
        "runs",
        "audits",
    ),
)
def activity_feed(spark, sf_dir):
    jobs, runs, audits = operations(spark, sf_dir, "jobs", "runs", "audits")
    runs = runs.withColumn("updated_at", F.timestamp_seconds("updated_at").cast("timestamp_ntz"))
    return feeds.activity_feed(jobs, runs, audits).select(
        "id", "kind", "title", "status", "error", F.coalesce("source_id", "run_id", "proposal_id", "logical_id").alias("ref")
    )


def _feed(spark, sf_dir):
    jobs, runs, audits = operations(spark, sf_dir, "jobs", "runs", "audits")
    runs = runs.withColumn("updated_at", F.timestamp_seconds("updated_at").cast("timestamp_ntz"))
    return feeds.activity_feed(jobs, runs, audits)


FEED = f"""{JOB_FEED} UNION ALL SELECT id, 'run', goal, status, make_timestamp(CAST(updated_at AS BIGINT) * 1000000), NULL, NULL FROM o_runs
UNION ALL SELECT id, CASE WHEN proposal_id IS NOT NULL AND object_id IS NULL THEN 'publish' ELSE 'edit' END, name, 'succeeded', updated_at, NULL, NULL FROM o_audits"""
KEYED = f"""k AS (SELECT *, CASE kind WHEN 'pipeline' THEN 'pipeline:' || title WHEN 'sync' THEN 'sync:' || coalesce(source_id, title) END AS key
  FROM ({FEED}))"""


@register(
    "collapse_all",
    with_operations("", "jobs", "runs", "audits").rstrip()
    + f""", {KEYED}, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY coalesce(key, '=' || id)) - 1 AS repeats FROM k
  WINDOW w AS (PARTITION BY coalesce(key, '=' || id) ORDER BY "at" DESC, id))
SELECT id, kind, title, status, "at", repeats FROM n WHERE rn = 1""",
)
def collapse_all(spark, sf_dir):
    return feeds.collapse(_feed(spark, sf_dir), "all").select("id", "kind", "title", "status", "at", "repeats")


@register(
    "collapse_adjacent",
    with_operations("", "jobs", "runs", "audits").rstrip()
    + f""", {KEYED.replace("'sync:' || coalesce(source_id, title)", "'sync:' || status")},
m AS (SELECT *, CASE WHEN key IS NULL OR key IS DISTINCT FROM lag(key) OVER (ORDER BY "at" DESC, id) THEN 1 ELSE 0 END AS starts FROM k),
r AS (SELECT *, sum(starts) OVER (ORDER BY "at" DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY "at" DESC, id) AS rn, count(*) OVER (PARTITION BY run) - 1 AS repeats FROM r)
SELECT id, kind, title, status, "at", repeats FROM n WHERE rn = 1""",
)
def collapse_adjacent(spark, sf_dir):
    # Syncs are told apart by outcome here, so that runs of many lengths occur.
    feed = _feed(spark, sf_dir).withColumn("source_id", F.col("status"))
    return feeds.collapse(feed, "adjacent").select("id", "kind", "title", "status", "at", "repeats")


@register(
    "connection_health",
    with_operations("", "sources", "jobs", "datasets").rstrip()
    + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, id DESC) AS rn FROM o_jobs WHERE source_id IS NOT NULL) WHERE rn = 1),
d AS (SELECT source_id, count(*) AS owned FROM o_datasets WHERE source_id IS NOT NULL GROUP BY 1),
s AS (SELECT s.*, l.status AS js, l.error AS je, l.updated_at AS jt, owned, CASE WHEN paused THEN 1 WHEN l.status IN ('queued', 'running') THEN 3
  WHEN l.status = 'failed' OR sync_status = 'retrying' THEN 4 WHEN l.status IS NOT NULL OR owned IS NOT NULL THEN 0 ELSE 3 END AS rank
  FROM o_sources s LEFT JOIN l ON l.source_id = s.id LEFT JOIN d ON d.source_id = s.id)
SELECT connection_id AS id, arg_min(connection_name, id) AS name, arg_min(kind, id) AS connector, count(*) AS sources, CAST(coalesce(sum(owned), 0) AS BIGINT) AS datasets,
  max(CASE WHEN js = 'succeeded' THEN jt END) AS last_sync_at, arg_min(je, id) FILTER (WHERE js = 'failed') AS error,
  ['healthy', 'paused', 'stale', 'syncing', 'failed'][max(rank) + 1] AS status FROM s GROUP BY connection_id""",
)
def connection_health(spark, sf_dir):
    return feeds.connection_health(*operations(spark, sf_dir, "sources", "jobs", "datasets"))


@register(
    "unsourced_connections",
    with_operations("", "jobs", "datasets").rstrip()
    + """, u AS (SELECT arg_max(status, (updated_at, id)) AS s, arg_max(error, (updated_at, id)) AS e, bool_or(status IN ('queued', 'running')) AS busy FROM o_jobs WHERE type = 'upload')
SELECT 'files' AS id, 'Files and API' AS name, 'upload' AS connector, CASE WHEN busy THEN 'syncing' WHEN s = 'failed' THEN 'failed' ELSE 'healthy' END AS status,
  (SELECT count(*) FROM o_datasets WHERE source_id IS NULL) AS datasets FROM u""",
)
def unsourced_connections(spark, sf_dir):
    jobs, datasets = operations(spark, sf_dir, "jobs", "datasets")
    datasets = datasets.withColumns(
        {"sample_source": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")}
    )
    return feeds.unsourced_connections(datasets, jobs.where("type = 'upload'")).select(
        "id", "name", "connector", "status", "datasets"
    )


@register(
    "failing_builds",
    with_operations("", "jobs", "pipelines").rstrip()
    + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY updated_at DESC, id DESC) AS rn FROM o_jobs WHERE type = 'pipeline') WHERE rn = 1)
SELECT l.pipeline_id, p.name, l.id AS job_id, l.updated_at AS at, l.error FROM l JOIN o_pipelines p ON p.id = l.pipeline_id
WHERE l.status = 'failed' AND p.generation = 'live'""",
)
def failing_builds(spark, sf_dir):
    return feeds.failing_builds(*operations(spark, sf_dir, "jobs", "pipelines"), "live")


@register(
    "home_counts",
    with_operations(
        """SELECT 'datasets' AS kind, count(*) AS n FROM o_datasets UNION ALL SELECT 'sources', count(*) FROM o_sources
UNION ALL SELECT 'builds', count(*) FROM o_pipelines WHERE generation = 'live'
UNION ALL SELECT 'objects', count(*) FROM orders UNION ALL SELECT 'proposals', count(*) FROM o_audits WHERE proposal_id IS NOT NULL""",
        "datasets",
        "sources",
        "pipelines",
        "audits",
    ),
)
def home_counts(spark, sf_dir):
    datasets, sources, built, audits = operations(spark, sf_dir, "datasets", "sources", "pipelines", "audits")
    return feeds.home_counts(
        {
            "datasets": datasets,
            "sources": sources,
            "builds": built.where("generation = 'live'"),
            "objects": table(spark, sf_dir, "orders"),
            "proposals": audits.where("proposal_id IS NOT NULL"),
        }
    )


@register(
    "threads",
    with_operations(
        """SELECT 'run_' || split_part(id, '_', 2) || '_' || CAST(min(CAST(split_part(id, '_', 3) AS BIGINT)) AS VARCHAR) AS id,
  arg_min(goal, created_at) AS title, min(created_at) AS created_at, max(updated_at) AS updated_at, count(*) AS turns, arg_max(status, created_at) AS status
FROM o_runs GROUP BY split_part(id, '_', 2)""",
        "runs",
    ),
)
def threads(spark, sf_dir):
    return feeds.threads(operations(spark, sf_dir, "runs")[0])


def _groups(spark, sf_dir):
    sources, jobs, datasets = operations(spark, sf_dir, "sources", "jobs", "datasets")
    imports = jobs.where(F.col("type").isin("sync", "upload"))
    datasets = datasets.withColumns(
        {"import_job_id": F.lit(None).cast("string"), "sample": F.lit(False)}
    )
    return feeds.connection_groups(sources, imports, datasets)


@register(
    "connection_groups",
    with_operations("", "sources", "jobs", "datasets").rstrip()
    + """, m AS (SELECT connection_id AS group_id, kind, connection_name AS name, 'source' AS member, id FROM o_sources
UNION ALL SELECT coalesce(s.connection_id, j.id), coalesce(s.kind, 'upload'), coalesce(s.connection_name, j.name), 'import', j.id
  FROM o_jobs j LEFT JOIN o_sources s ON s.id = j.source_id WHERE j.type = 'upload' OR (j.type = 'sync' AND s.id IS NOT NULL)
UNION ALL SELECT coalesce(s.connection_id, d.id), coalesce(s.kind, CASE WHEN d.source_id IS NULL THEN 'api' ELSE 'upload' END), coalesce(s.connection_name, d.name), 'dataset', d.id
  FROM o_datasets d LEFT JOIN o_sources s ON s.id = d.source_id)
SELECT group_id, count(*) FILTER (WHERE member = 'source') AS sources, count(*) FILTER (WHERE member = 'import') AS imports,
  count(*) FILTER (WHERE member = 'dataset') AS datasets, arg_min(kind, (CASE member WHEN 'source' THEN 0 WHEN 'import' THEN 1 ELSE 2 END, id)) AS kind,
  arg_min(name, (CASE member WHEN 'source' THEN 0 WHEN 'import' THEN 1 ELSE 2 END, id)) AS name FROM m GROUP BY 1""",
)
def connection_groups(spark, sf_dir):
    return feeds.group_sizes(_groups(spark, sf_dir))


# Change capture. Events are change messages of five sources, an hour is a transaction.

CDC = """SELECT event_type AS source, CAST(date_trunc('hour', ts) AS VARCHAR) AS tx, event_id AS lsn,
  CASE WHEN value > 100 THEN 'update' WHEN value > 80 THEN 'insert' ELSE 'relation' END AS tag FROM events"""


def change_events(spark, sf_dir):
    """Messages, then each transaction's commit at its last position."""
    messages = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.date_trunc("hour", "ts").cast("string").alias("tx"),
        F.col("event_id").alias("lsn"),
        F.when(F.col("value") > 100, "update").when(F.col("value") > 80, "insert").otherwise("relation").alias("tag"),
    )
    commits = messages.groupBy("source", "tx").agg(F.max("lsn").alias("lsn")).withColumn("tag", F.lit("commit"))
    return messages, commits


def _stream(spark, sf_dir, state, *parts):
    for i, part in enumerate(parts):
        part.select("source", "tx", "lsn", "tag").write.mode("append").parquet(f"{state}/events")
    query = changes.count_changes(changes.read_events(spark, f"{state}/events", 2), f"{state}/state")
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return f"{state}/state"


COUNTED = f"""SELECT source, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS BIGINT) AS changes, max(lsn) AS cursor
FROM (SELECT source, tx, bool_or(tag <> 'relation') AS changed, max(lsn) AS lsn FROM ({CDC}) GROUP BY 1, 2) GROUP BY 1"""


@register("cdc_dirty_counter", COUNTED)
def cdc_dirty_counter(spark, sf_dir):
    """Counted by a stream of several micro-batches, where a transaction spans batches."""
    path = _stream(spark, sf_dir, scratch(spark), *change_events(spark, sf_dir))
    return changes.counters(spark, path)


@register(
    "needs_refresh",
    f"SELECT source, changes, CASE WHEN source = 'click' THEN changes - 1 ELSE 0 END AS applied FROM ({COUNTED}) WHERE source IN ('click', 'view', 'error')",
)
def needs_refresh(spark, sf_dir):
    messages, commits = change_events(spark, sf_dir)
    none = lambda schema: spark.createDataFrame([], schema)
    counted, _ = changes.advance(
        none("source string, changes bigint, cursor bigint"),
        none("source string, tx string, changed boolean, lsn bigint"),
        messages.unionByName(commits),
    )
    seen = counted.where("source IN ('click', 'signup')").select(
        "source", (F.col("changes") - F.when(F.col("source") == "click", 1).otherwise(0)).alias("applied")
    )
    known = counted.where("source IN ('click', 'signup', 'view', 'error')")
    return changes.needs_refresh(counted, seen, known)


@register(
    "coalesced_refresh",
    f"""
WITH t AS (SELECT source, tx, bool_or(tag <> 'relation') AS changed, max(lsn) AS lsn FROM ({CDC}) GROUP BY 1, 2)
SELECT source, count(*) FILTER (WHERE changed) AS changes, max(lsn) AS cursor,
  CASE WHEN source = 'click' THEN count(*) FILTER (WHERE changed AND lsn < (SELECT max(event_id) // 2 FROM events)) END AS applied FROM t GROUP BY 1""",
)
def coalesced_refresh(spark, sf_dir):
    """One source is refreshed once for all its commits; later commits leave it dirty."""
    state = scratch(spark)
    messages, commits = change_events(spark, sf_dir)
    half = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 2
    path = _stream(spark, sf_dir, state, messages, commits.where(F.col("lsn") < half))
    store = Snapshots(spark, f"{state}/store")
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    changes.refresh(store, path, "click", "clicks", "Clicks", lambda: clicks)
    clean = changes.needs_refresh(changes.counters(spark, path), changes.applied(spark, path), commits).where("source = 'click'")
    assert clean.isEmpty()
    path = _stream(spark, sf_dir, state, commits.where(F.col("lsn") >= half))
    return changes.counters(spark, path).join(changes.applied(spark, path), "source", "left")


@register(
    "refresh_due",
    with_operations(
        """SELECT id, kind, CASE kind WHEN 'posthog' THEN 360 WHEN 'stripe' THEN 60 ELSE 5 END AS every_minutes
FROM o_sources WHERE kind NOT IN ('postgres', 'mysql') AND NOT paused""",
        "sources",
    ),
)
def refresh_due(spark, sf_dir):
    import datetime as dt

    (sources,) = operations(spark, sf_dir, "sources")
    due, later = dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 2)
    planned = changes.sync_defaults(sources).withColumns(
        {
            "schedule": F.lit(None).cast("string"),
            "next_run": F.when(F.col("paused"), F.lit(later)).otherwise(F.lit(due)),
        }
    )
    return changes.refresh_due(planned, dt.datetime(2024, 2, 1)).select("id", "kind", "every_minutes")
