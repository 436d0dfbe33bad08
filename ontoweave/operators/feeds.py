"""Operational feeds: activity, health, failing builds, home counts, threads, groups."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import numbered_runs
from ..session import cut

# What activity entries are called.
SETUP_TASKS = {
    "describe_ontology": ("Describing your ontology", "Described your ontology"),
    "recommend_outcomes": ("Suggesting outcomes", "Suggested outcomes"),
    "onboarding_build": ("Building your workspace", "Built your workspace"),
    "home_metrics": ("Picking your key metrics", "Picked your key metrics"),
}
PROVIDERS = {"local": "the local AI model", "claude": "Claude", "openai": "OpenAI"}
JOB_KINDS = {
    "pipeline": ("pipeline", "Pipeline build"),
    "sync": ("sync", "Sync"),
    "upload": ("upload", "Upload"),
    "provider_prepare": ("model", "AI model"),
}
HEALTH = ["healthy", "paused", "stale", "syncing", "failed"]  # from best to worst

ITEM = (
    "id", "kind", "label", "title", "status", "at", "error", "repeats",
    "source_id", "dataset_id", "pipeline_id", "run_id", "proposal_id", "logical_id",
)


def _lookup(value: Column, names: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out


def busy(status: Column) -> Column:
    return F.coalesce(status.isin("queued", "running"), F.lit(False))


def _item(df: DataFrame, **columns: Column) -> DataFrame:
    """One feed entry per row; what an entry does not say is null."""
    defaults = {
        "id": F.col("id"),
        "status": F.coalesce("status", F.lit("succeeded")) if "status" in df.columns else F.lit("succeeded"),
        "at": F.col("updated_at"),
        "error": F.nullif(F.col("error"), F.lit("")) if "error" in df.columns else F.lit(None).cast("string"),
        "repeats": F.lit(0).cast("bigint"),
    }
    chosen = defaults | columns
    return df.select(*[chosen.get(c, F.lit(None).cast("string")).alias(c) for c in ITEM])


def activity_feed(jobs: DataFrame, runs: DataFrame, audits: DataFrame) -> DataFrame:
    """Jobs, runs and audits as one feed of entries.

    ``jobs(id, name, type, status, error, updated_at, source_id, dataset_id, pipeline_id)``
    and optionally ``provider``; ``runs(id, name, goal, task, status, updated_at)``;
    ``audits(id, name, proposal_id, object_id, updated_at)`` and optionally ``logical_id``.
    """
    kind = F.col("type")
    active = busy(F.col("status"))
    provider = F.coalesce(
        _lookup(F.col("provider"), PROVIDERS) if "provider" in jobs.columns else F.lit(None), F.lit("the AI model")
    )
    prepared = F.concat(
        F.when(active, F.lit("Preparing "))
        .when(F.col("status") == "failed", F.lit("Couldn’t prepare "))
        .otherwise(F.lit("Prepared ")),
        provider,
    )
    from_jobs = _item(
        jobs,
        kind=F.coalesce(_lookup(kind, {k: v[0] for k, v in JOB_KINDS.items()}), F.lit("job")),
        label=F.coalesce(_lookup(kind, {k: v[1] for k, v in JOB_KINDS.items()}), F.lit("Job")),
        title=F.when(kind == "pipeline", F.regexp_replace("name", "^Run ", ""))
        .when(kind == "sync", F.regexp_replace("name", "^Sync ", ""))
        .when(kind == "provider_prepare", prepared)
        .otherwise(F.col("name")),
        source_id=F.col("source_id"),
        dataset_id=F.col("dataset_id"),
        pipeline_id=F.col("pipeline_id"),
    )
    setup = F.col("task").isNotNull()
    doing = _lookup(F.col("task"), {k: v[0] for k, v in SETUP_TASKS.items()})
    done = _lookup(F.col("task"), {k: v[1] for k, v in SETUP_TASKS.items()})
    name = F.col("name") if "name" in runs.columns else F.lit(None).cast("string")
    from_runs = _item(
        runs,
        kind=F.when(setup, "setup").otherwise("run"),
        label=F.when(setup, "Setup").otherwise("Analyst"),
        title=F.when(setup, F.coalesce(F.when(active, doing).otherwise(done), name)).otherwise(
            F.coalesce("goal", name)
        ),
        run_id=F.col("id"),
    )
    publishes = F.col("proposal_id").isNotNull() & F.col("object_id").isNull()
    stated = F.col("logical_id") if "logical_id" in audits.columns else F.lit(None).cast("string")
    edited = F.regexp_replace("object_id", "^[^_]*_", "")
    from_audits = _item(
        audits,
        status=F.lit("succeeded"),
        error=F.lit(None).cast("string"),
        kind=F.when(publishes, "publish").otherwise("edit"),
        label=F.when(publishes, "Publication").otherwise("Object edit"),
        title=F.col("name"),
        proposal_id=F.when(publishes, F.col("proposal_id")),
        logical_id=F.when(~publishes, F.coalesce(stated, edited)),
    )
    return from_jobs.unionByName(from_runs).unionByName(from_audits)


def repeat_key(kind: Column, title: Column, source_id: Column) -> Column:
    """What makes two entries the same work: a build by name, a sync by source."""
    return F.when(kind == "pipeline", F.concat(F.lit("pipeline:"), title)).when(
        kind == "sync", F.concat(F.lit("sync:"), F.coalesce(source_id, title))
    )


def _age(at: Column) -> Column:
    """Sorts newest first."""
    return -F.unix_micros(at.cast("timestamp"))


def collapse(feed: DataFrame, mode: str = "all", group: str | None = None) -> DataFrame:
    """Fold repeats into the newest entry, which counts them.

    ``all`` folds every repeat; ``adjacent`` only back-to-back ones, newest first, within
    ``group`` (a workspace) where one is named.
    """
    keyed = feed.withColumns(
        {"__key": repeat_key(F.col("kind"), F.col("title"), F.col("source_id")), "__age": _age(F.col("at"))}
    )
    newest = F.struct("__age", "id")
    whole = F.struct(*feed.columns)
    if mode == "all":
        # Entries without a key keep to themselves.
        by = [F.coalesce("__key", F.concat(F.lit("="), "id")).alias("__k")] + ([F.col(group)] if group else [])
        folded = keyed.groupBy(*by)
    elif mode == "adjacent":
        if group is None:
            keyed = keyed.withColumn("__group", F.lit(0))
        runs = numbered_runs(keyed, group or "__group", "__key", [group or "__group", "__age", "id"])
        folded = runs.groupBy("run")
    else:
        raise ValueError("Collapse all or adjacent")
    out = folded.agg(
        F.min_by(whole, newest).alias("item"),
        (F.count(F.lit(1)) - 1 + F.sum("repeats")).alias("folded"),
    )
    columns = [F.col(f"item.{c}") if c != "repeats" else F.col("folded").alias(c) for c in feed.columns]
    return out.select(*columns)


# Health.


def latest(df: DataFrame, key: str) -> DataFrame:
    """The newest row of each key, combined map-side."""
    whole = F.struct(*df.columns)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max_by(whole, F.struct("updated_at", "id")).alias("r"))
        .select("r.*")
    )


def connection_health(sources: DataFrame, jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each connection with the worst status of its sources, its last success and error.

    ``sources(id, name, kind, connection_id, connection_name, paused, sync_status)``.
    """
    last = latest(jobs, "source_id").select(
        F.col("source_id").alias("id"),
        F.col("status").alias("job_status"),
        F.col("error").alias("job_error"),
        F.col("updated_at").alias("job_at"),
    )
    owned = (
        datasets.where(F.col("source_id").isNotNull())
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("owned"))
    )
    rank = {status: i for i, status in enumerate(HEALTH)}
    status = (
        F.when(F.col("paused"), rank["paused"])
        .when(busy(F.col("job_status")), rank["syncing"])
        .when((F.col("job_status") == "failed") | (F.col("sync_status") == "retrying"), rank["failed"])
        .when(F.col("job_status").isNotNull() | F.col("owned").isNotNull(), rank["healthy"])
        .otherwise(rank["syncing"])
    )
    placed = sources.join(last, "id", "left").join(owned, "id", "left").withColumn("rank", status)
    first = lambda c: F.min_by(c, "id")
    failed = F.when(F.col("job_status") == "failed", F.struct("id", F.col("job_error").alias("error")))
    return (
        placed.groupBy(F.coalesce("connection_id", "id").alias("id"))
        .agg(
            first(F.coalesce("connection_name", "name")).alias("name"),
            first("kind").alias("connector"),
            F.max("rank").alias("rank"),
            F.count(F.lit(1)).alias("sources"),
            F.coalesce(F.sum("owned"), F.lit(0)).alias("datasets"),
            F.max(F.when(F.col("job_status") == "succeeded", F.col("job_at"))).alias("last_sync_at"),
            F.min(failed).getField("error").alias("error"),
        )
        .withColumn("status", F.element_at(F.array(*[F.lit(s) for s in HEALTH]), F.col("rank") + 1))
        .drop("rank")
    )


def unsourced_connections(datasets: DataFrame, uploads: DataFrame) -> DataFrame:
    """Sample sets and files, which have no source: one connection for each sample set and
    one for all files. ``datasets(id, source_id, sample_source, updated_at)``."""
    last = uploads.agg(
        F.max_by("status", F.struct("updated_at", "id")).alias("status"),
        F.max_by("error", F.struct("updated_at", "id")).alias("error"),
        F.coalesce(F.max(busy(F.col("status"))), F.lit(False)).alias("busy"),
    ).first()
    files = "syncing" if last["busy"] else "failed" if last["status"] == "failed" else "healthy"
    sample = F.col("sample_source").isNotNull()
    grouped = (
        datasets.where(F.col("source_id").isNull())
        .groupBy(F.coalesce("sample_source", F.lit("upload")).alias("connector"), sample.alias("sample"))
        .agg(F.count(F.lit(1)).alias("datasets"), F.max("updated_at").alias("last_sync_at"))
    )
    return grouped.select(
        F.when(F.col("sample"), F.concat(F.lit("sample:"), "connector")).otherwise(F.lit("files")).alias("id"),
        F.when(F.col("sample"), F.col("connector")).otherwise(F.lit("Files and API")).alias("name"),
        "connector",
        F.when(F.col("sample"), "healthy").otherwise(files).alias("status"),
        "datasets",
        "last_sync_at",
        F.when(~F.col("sample"), F.lit(last["error"])).alias("error"),
    )


def failing_builds(jobs: DataFrame, pipelines: DataFrame, generation: str) -> DataFrame:
    """Live pipelines whose latest build failed.

    ``pipelines(id, name, generation)``.
    """
    builds = latest(jobs.where(F.col("type") == "pipeline"), "pipeline_id").where(F.col("status") == "failed")
    live = pipelines.where(F.col("generation") == generation).select(
        F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name")
    )
    return builds.join(live, "pipeline_id").select(
        "pipeline_id", F.col("pipeline_name").alias("name"), F.col("id").alias("job_id"), F.col("updated_at").alias("at"), "error"
    )


def home_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How many of each kind there are, in one union of counts."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        for kind, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# Threads.

MOST_DOUBLINGS = 40


def thread_roots(runs: DataFrame) -> DataFrame:
    """``(id, thread_id)`` for every run: its own thread, or where its chain of questions
    starts.

    Each round replaces a run's link by its link's link, so a chain of ``n`` runs takes
    ``log n`` rounds; runs that reached their root take no further part in the joins.
    ``runs(id, thread_id, previous_id, task)``.
    """
    asked = runs.where(F.col("task").isNull())
    known = asked.select(F.col("id").alias("previous_id")).distinct()
    # A run that states its thread, or whose question is unknown, is where a chain ends.
    linked = asked.join(known.withColumn("known", F.lit(True)), "previous_id", "left")
    ends = F.col("thread_id").isNotNull() | F.col("known").isNull()
    state = cut(
        linked.select(
            "id",
            F.when(ends, F.coalesce("thread_id", "id")).alias("root"),
            F.when(~ends, F.col("previous_id")).alias("up"),
        )
    )
    settled = []
    for _ in range(MOST_DOUBLINGS):
        open_runs = state.where(F.col("up").isNotNull())
        if open_runs.isEmpty():
            settled.append(state)
            return reduce(DataFrame.unionByName, settled).select("id", F.col("root").alias("thread_id"))
        above = state.select(F.col("id").alias("up"), F.col("root").alias("up_root"), F.col("up").alias("next"))
        stepped = open_runs.join(above, "up").select("id", F.col("up_root").alias("root"), F.col("next").alias("up"))
        state = cut(state.where(F.col("up").isNull()).unionByName(stepped))
    raise ValueError("Questions refer to each other in a circle")


def threads(runs: DataFrame) -> DataFrame:
    """Conversations: first question, turns, last status, first and last time.

    ``runs(id, goal, status, created_at, updated_at, ...)`` as for :func:`thread_roots`.
    """
    order = F.struct("created_at", "id")
    return (
        runs.join(thread_roots(runs).withColumnRenamed("thread_id", "thread"), "id")
        .groupBy(F.col("thread").alias("id"))
        .agg(
            F.min_by("goal", order).alias("title"),
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
            F.count(F.lit(1)).alias("turns"),
            F.max_by("status", order).alias("status"),
        )
    )


# Connection groups.


def connection_groups(sources: DataFrame, imports: DataFrame, datasets: DataFrame) -> DataFrame:
    """Which connection each source, import and dataset belongs to, one row per member.

    ``imports(id, name, type, source_id)``; ``datasets(id, name, source_id, import_job_id,
    sample)``. A connection counts once however many tables it imports.
    """
    placed = sources.select(
        F.coalesce("connection_id", "id").alias("group_id"),
        F.col("kind").alias("group_kind"),
        F.coalesce("connection_name", "name").alias("group_name"),
        F.lit("source").alias("member"),
        F.col("id").alias("member_id"),
    )
    of_source = placed.select(
        F.col("member_id").alias("source_id"), F.col("group_id").alias("g"), F.col("group_kind").alias("k"), F.col("group_name").alias("n")
    )
    found = imports.join(of_source, "source_id", "left")
    by_upload = F.col("g").isNull() & (F.col("type") == "upload")
    jobs = found.where(F.col("g").isNotNull() | by_upload).select(
        F.coalesce("g", "id").alias("group_id"),
        F.coalesce("k", F.lit("upload")).alias("group_kind"),
        F.coalesce("n", "name").alias("group_name"),
        F.lit("import").alias("member"),
        F.col("id").alias("member_id"),
    )
    of_job = jobs.select(
        F.col("member_id").alias("import_job_id"), F.col("group_id").alias("jg"), F.col("group_kind").alias("jk"), F.col("group_name").alias("jn")
    )
    kept = (
        datasets.where(~F.coalesce("sample", F.lit(False)))
        .join(of_source, "source_id", "left")
        .join(of_job, "import_job_id", "left")
        .select(
            F.coalesce("g", "jg", "id").alias("group_id"),
            F.coalesce("k", "jk", F.when(F.col("source_id").isNotNull(), "upload").otherwise("api")).alias("group_kind"),
            F.coalesce("n", "jn", "name").alias("group_name"),
            F.lit("dataset").alias("member"),
            F.col("id").alias("member_id"),
        )
    )
    return placed.unionByName(jobs).unionByName(kept)


def group_sizes(groups: DataFrame) -> DataFrame:
    """How many sources, imports and datasets each connection has."""
    count = lambda what: F.count(F.when(F.col("member") == what, 1))
    rank = F.when(F.col("member") == "source", 0).when(F.col("member") == "import", 1).otherwise(2)
    first = lambda c: F.min_by(c, F.struct(rank, F.col("member_id")))
    return groups.groupBy("group_id").agg(
        first("group_kind").alias("kind"),
        first("group_name").alias("name"),
        count("source").alias("sources"),
        count("import").alias("imports"),
        count("dataset").alias("datasets"),
    )


