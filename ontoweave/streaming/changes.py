"""Change capture: counting the commits that touch a source, and refreshing once for many.

A stream of change events ``(source, tx, lsn, tag)`` becomes one counter per source. What a
transaction has done so far is Spark's streaming state, one group per transaction, so a source
with most of the events spreads like any other; a commit ends the group, and one that never
commits expires. A micro-batch leaves one commit in a log: the counters of the sources it
touched, with its number, so a batch that runs again counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.local import local_frame
from ..operators.log import Fact, Log
from ..operators.snapshots import Snapshots

# The tags of a change stream.
CHANGES = ["insert", "update", "delete", "truncate", "ddl"]
COMMIT, CONNECT = "commit", "connect"
DATABASES = ["postgres", "mysql"]
# How often a source without a change stream refreshes, in minutes.
REFRESH_MINUTES = {"posthog": 360, "stripe": 60, "workos": 60}
DEFAULT_MINUTES = 5

EVENT = "source string, tx string, lsn bigint, tag string"
COUNTERS = "source string, changes bigint, cursor bigint"
OPEN = "source string, tx string, changed boolean, lsn bigint"
# A transaction that has not committed after so many hours is forgotten.
EXPIRES_HOURS = 24
APPLIED = "source string, applied bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(T._parse_datatype_string(schema)).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return local_frame(spark, [], schema)


def advance(
    counters: DataFrame, open_txs: DataFrame, events: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Counters and unfinished transactions after some events.

    A transaction counts once, when its commit arrives, if it changed rows or tables,
    however many micro-batches it spans. A (re)connect counts too: changes may have been
    missed. Events combine per transaction before the shuffle.
    """
    seen = events.where(F.col("tag") != CONNECT).select(
        "source",
        "tx",
        F.col("tag").isin(CHANGES).alias("changed"),
        (F.col("tag") == COMMIT).alias("closed"),
        "lsn",
    )
    carried = open_txs.select("source", "tx", "changed", F.lit(False).alias("closed"), "lsn")
    txs = seen.unionByName(carried).groupBy("source", "tx").agg(
        F.max("changed").alias("changed"), F.max("closed").alias("closed"), F.max("lsn").alias("lsn")
    )
    committed = txs.where("closed").select(
        "source", F.col("changed").cast("bigint").alias("changes"), F.col("lsn").alias("cursor")
    )
    connected = events.where(F.col("tag") == CONNECT).select(
        "source", F.lit(1).cast("bigint").alias("changes"), F.lit(None).cast("bigint").alias("cursor")
    )
    counted = (
        counters.select("source", "changes", "cursor")
        .unionByName(committed)
        .unionByName(connected)
        .groupBy("source")
        .agg(F.sum("changes").alias("changes"), F.max("cursor").alias("cursor"))
    )
    return counted, txs.where(~F.col("closed")).select("source", "tx", "changed", "lsn")


def tracker(expires_hours: float = EXPIRES_HOURS) -> Callable:
    """Follows one transaction over micro-batches: the state is whether it changed rows or tables
    and its last position; a commit emits a count and ends it."""

    def track(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        changed, last = state.get if state.exists else (False, None)
        connects, committed, seen = 0, False, None
        for part in parts:
            connects += int((part["tag"] == CONNECT).sum())
            own = part[part["tag"] != CONNECT]
            if len(own):
                seen = own["seen_at"].max()
                changed = changed or bool(own["tag"].isin(CHANGES).any())
                committed = committed or bool((own["tag"] == COMMIT).any())
                last = int(own["lsn"].max()) if last is None else max(last, int(own["lsn"].max()))
        if committed and state.exists:
            state.remove()
        elif seen is not None and not committed:
            state.update((changed, last))
            state.setTimeoutTimestamp(int(seen.timestamp() * 1000 + expires_hours * 3_600_000))
        # A (re)connect counts too: changes may have been missed.
        count = connects + (committed and changed)
        if count or committed:
            cursor = pd.array([last if committed else None], dtype="Int64")
            yield pd.DataFrame({"source": [key[0]], "changes": [count], "cursor": cursor})

    return track


def _counters(spark: SparkSession, state_path: str) -> Log:
    # One stream writes the counters, so commits that a checkpoint holds may go.
    return Log(spark, f"{state_path}/counters", one_writer=True)


def count_changes(stream: DataFrame, state_path: str, once: bool = True, expires_hours: float = EXPIRES_HOURS):
    """Start counting. Counters and checkpoint live together under ``state_path``; with ``once``
    the query stops when it has read what is there."""
    # The watermark is the time of the last micro-batch with events, so a query that stops when it
    # has read everything is not kept running by transactions that wait for their time.
    seen = stream.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "0 seconds")
    counted = seen.groupBy("source", "tx").applyInPandasWithState(
        tracker(expires_hours), COUNTERS, "changed boolean, lsn bigint", "update", GroupStateTimeout.EventTimeTimeout
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        log = _counters(batch.sparkSession, state_path)
        # One row per source that had commits.
        touched = batch.groupBy("source").agg(F.sum("changes").alias("changes"), F.max("cursor").alias("cursor")).collect()

        def decide() -> list[Fact]:
            facts = []
            for r in touched:
                old = log.get("counter", r["source"]) or {"changes": 0, "cursor": None, "batch": -1}
                if old["batch"] < batch_id:
                    cursor = max((c for c in (old["cursor"], r["cursor"]) if c is not None), default=None)
                    now = {"source": r["source"], "changes": old["changes"] + r["changes"], "cursor": cursor, "batch": batch_id}
                    facts.append(("counter", r["source"], now))
            return facts

        log.update(decide)

    writer = stream_writer(counted, state_path).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_writer(counted: DataFrame, state_path: str):
    return counted.writeStream.outputMode("update").option("checkpointLocation", f"{state_path}/checkpoint")


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(T._parse_datatype_string(EVENT))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def counters(spark: SparkSession, state_path: str) -> DataFrame:
    """Changes and cursor per source, as of the last finished batch."""
    return _counters(spark, state_path).frame("counter", COUNTERS).drop("commit")


def applied(spark: SparkSession, state_path: str) -> DataFrame:
    """The counter each source's last snapshot had seen."""
    return _read(spark, f"{state_path}/applied", APPLIED).groupBy("source").agg(F.max("applied").alias("applied"))


def needs_refresh(counters: DataFrame, applied: DataFrame, datasets: DataFrame) -> DataFrame:
    """Sources with commits no snapshot has seen, that have a dataset to refresh.

    ``datasets(source)``.
    """
    return (
        counters.join(applied, "source", "left")
        .withColumn("applied", F.coalesce("applied", F.lit(0)))
        .where(F.col("changes") > F.col("applied"))
        .join(datasets.select("source").distinct(), "source", "left_semi")
        .select("source", "changes", "applied")
    )


def refresh(
    store: Snapshots, state_path: str, source: str, dataset_id: str, name: str, load: Callable[[], DataFrame]
):
    """One snapshot for all commits so far. The counter is read before the rows are, so a
    commit during the import leaves the source dirty."""
    row = counters(store.spark, state_path).where(F.col("source") == source).first()
    seen = row["changes"] if row else 0
    state = store.commit(dataset_id, name, load(), source_id=source)
    local_frame(store.spark, [(source, seen)], APPLIED).coalesce(1).write.mode("append").parquet(f"{state_path}/applied")
    return state


def sync_defaults(sources: DataFrame) -> DataFrame:
    """How each source is kept fresh: databases by their change stream, others by snapshots
    every few minutes or hours. ``sources(id, kind)``."""
    database = F.col("kind").isin(DATABASES)
    minutes = F.lit(DEFAULT_MINUTES)
    for kind, every in REFRESH_MINUTES.items():
        minutes = F.when(F.col("kind") == kind, every).otherwise(minutes)
    return sources.withColumns(
        {
            "mode": F.when(database, "auto").otherwise("snapshot"),
            "sync_state": F.when(database, "checking").otherwise("ready"),
            "every_minutes": F.when(~database, minutes),
        }
    )


def refresh_due(sources: DataFrame, now) -> DataFrame:
    """Sources whose scheduled snapshot is due; a working change stream needs none.

    ``sources(id, mode, schedule, next_run)``.
    """
    scheduled = F.col("schedule").isNotNull() | (F.col("mode") == "snapshot")
    streaming = F.coalesce(F.col("mode").isin("cdc", "auto"), F.lit(False))
    return sources.where(~streaming & scheduled & (F.col("next_run") <= F.lit(now)))
