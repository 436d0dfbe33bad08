"""People's edits, stored: batches that count once, in the order of a log.

Three kinds of edits are kept, each in Parquet folders of its own: values of records
(``record``), objects created by hand (``object``), and links and unlinks (``relation``). A batch
is judged on the state of one version of the log, written, and committed as the next version. If
another writer took that number, the batch is judged again on the newer state, where an edit made
on an older revision is refused; so of two edits of one revision one wins. Requests carry an
idempotency key: a batch that is sent again changes nothing.

A row of a batch holds what its record is after it, so the present state is the last row of each
record, a maximum that combines map-side. Batches are folded into one folder when there are as
many new ones as a quarter of those folded (16 at least); uncommitted folders are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..session import cut
from . import edits as X
from .entities import TypeDef
from .log import Conflict, Log
from .objects import object_id

APPLIED = "version bigint, request_hash string, idempotency_key string, actor string, created_at timestamp"
ROWS = {
    "record": "logical_id string, values map<string,string>, revision bigint, id string, name string, object_id string, "
    "before map<string,string>, asked map<string,string>, " + APPLIED,
    "object": "type string, key string, values map<string,string>, logical_id string, " + APPLIED,
    "relation": "from_logical_id string, to_logical_id string, name string, enabled boolean, revision bigint, " + APPLIED,
}
# What one row of a kind is about.
ABOUT = {
    "record": ["logical_id"],
    "object": ["type", "key"],
    "relation": ["from_logical_id", "to_logical_id", "name"],
}
CREATED = "edit_id string, type string, key string, values map<string,string>, idempotency_key string, actor string, submitted_at timestamp"
LINKED = (
    "edit_id string, from_logical_id string, to_logical_id string, name string, enabled boolean, revision bigint, "
    "idempotency_key string, actor string, submitted_at timestamp"
)
FOLD_EVERY = 16

TAKEN = "An object with this key already exists"
RELATION_CHANGED = "Relation was edited; refresh the preview"

Judge = Callable[[int], tuple[DataFrame, DataFrame]]


def _hash(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


@dataclass
class EditStore:
    spark: SparkSession
    root: str
    log: Log = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.log = Log(self.spark, f"{self.root}/log")

    def version(self) -> int:
        return self.log.version()

    # Reading.

    def _folders(self, kind: str) -> tuple[dict | None, list[tuple[int, str]]]:
        """The last fold of a kind, and the batches after it."""
        fold = self.log.get("fold", kind)
        batches = self.log.frame("batch", "kind string, version bigint, path string").where(F.col("kind") == kind)
        after = batches.where(F.col("version") > (fold["version"] if fold else 0)).orderBy("version")
        return fold, [(r["version"], r["path"]) for r in after.collect()]

    def rows(self, kind: str, upto: int | None = None, since: int = 0) -> DataFrame:
        """All applied rows of a kind, as of a version, or since one."""
        fold, batches = self._folders(kind)
        paths = [fold["path"]] if fold else []
        paths += [path for version, path in batches if upto is None or version <= upto]
        if not paths:
            return local_frame(self.spark, [], ROWS[kind])
        found = self.spark.read.schema(ROWS[kind]).parquet(*paths).where(F.col("version") > since)
        return found if upto is None else found.where(F.col("version") <= upto)

    def _present(self, kind: str, columns: Sequence[str], upto: int | None, since: int) -> DataFrame:
        """The last row about each thing."""
        last = F.max_by(F.struct(*columns), "version").alias("last")
        return self.rows(kind, upto, since).groupBy(*ABOUT[kind]).agg(last).select(*ABOUT[kind], "last.*")

    def overlays(self, upto: int | None = None) -> DataFrame:
        """Edited values and the revision of each edited record."""
        return self._present("record", ["values", "revision"], upto, 0)

    def manual(self, upto: int | None = None, since: int = 0) -> DataFrame:
        """Objects that people created, as :func:`edits.with_manual_objects` reads them."""
        return self._present("object", ["values"], upto, since).select("type", "key", "values")

    def relation_edits(self, upto: int | None = None, since: int = 0) -> DataFrame:
        """The last link or unlink of each pair."""
        found = self._present("relation", ["enabled"], upto, since)
        return found.select("from_logical_id", "to_logical_id", "name", "enabled")

    def audit(self) -> DataFrame:
        """Who changed which record, how and when."""
        shown = ["id", "name", "actor", "object_id", "logical_id", "before", F.col("asked").alias("values"), "created_at"]
        return self.rows("record").select(*shown)

    def _done(self, upto: int) -> DataFrame:
        used = [self.rows(kind, upto).select("idempotency_key", "request_hash") for kind in ROWS]
        return reduce(DataFrame.unionByName, used)

    # Writing.

    def _apply(self, kind: str, judge: Judge, attempts: int = 20) -> DataFrame:
        """Judge, write and commit a batch; returns the refused requests."""
        for _ in range(attempts):
            now = self.version()
            applied, refused = judge(now)
            names = [part.split()[0] for part in ROWS[kind].split(", ")]
            path = f"{self.root}/{kind}/batch-{uuid.uuid4().hex}"
            applied.withColumn("version", F.lit(now + 1).cast("bigint")).select(*names).write.parquet(path)
            if self.spark.read.schema(ROWS[kind]).parquet(path).isEmpty():
                return refused
            batch = {"kind": kind, "version": now + 1, "path": path}
            try:
                self.log.commit([("batch", f"{kind}/{now + 1:012}", batch)], now)
            except Conflict:
                continue
            self._fold(kind)
            return refused
        raise Conflict("Too many writers at once")

    def _fold(self, kind: str) -> None:
        fold, batches = self._folders(kind)
        if len(batches) < max(FOLD_EVERY, (fold["batches"] if fold else 0) // 4):
            return
        last = batches[-1][0]
        path = f"{self.root}/{kind}/fold-{uuid.uuid4().hex}"
        about = ABOUT[kind]
        self.rows(kind, last).repartitionByRange(*about).sortWithinPartitions(*about, "version").write.parquet(path)
        value = {"version": last, "path": path, "batches": len(batches) + (fold["batches"] if fold else 0)}
        self.log.update(lambda: [("fold", kind, value)])

    def apply(
        self, records: DataFrame, edits: DataFrame, types: Sequence[TypeDef], kinds: Mapping[str, Mapping[str, str]] | None = None
    ) -> DataFrame:
        """Apply a batch of value edits (``edits.EDIT``) to the records of a generation, manual ones
        included; returns ``edit_id``, ``logical_id`` and ``reason`` of the refused ones."""

        def judge(now: int) -> tuple[DataFrame, DataFrame]:
            winners, refused = X.judge_edits(records, self.overlays(now), edits, types, self._done(now), kinds)
            after = X.new_overlays(winners).select("logical_id", F.col("values").alias("kept"), F.col("revision").alias("reached"))
            rows = X.edit_audit(winners).withColumnRenamed("values", "asked").join(after, "logical_id")
            return rows.withColumnsRenamed({"kept": "values", "reached": "revision"}), refused

        return self._apply("record", judge)

    def create(self, records: DataFrame, created: DataFrame, types: Sequence[TypeDef]) -> DataFrame:
        """Create objects (``CREATED``) of the given types whose key no record has; returns
        ``edit_id``, ``type``, ``key`` and ``reason`` of the refused ones."""
        known_types = {t.name: t for t in types}

        def judge(now: int) -> tuple[DataFrame, DataFrame]:
            requests = created.withColumn("request_hash", _hash("type", "key", F.array_sort(F.map_entries("values"))))
            taken = records.select("type", "key").unionByName(self.manual(now).select("type", "key")).join(
                created.select("type", "key").distinct(), ["type", "key"], "left_semi"
            )
            logical = properties = F.lit(None)
            for name, t in known_types.items():
                here = F.col("type") == name
                logical = F.when(here, object_id(name, F.col("key"))).otherwise(logical)
                properties = F.when(here, F.array(*[F.lit(p) for p in t.properties])).otherwise(properties)
            placed = X.with_first_uses(requests, self._done(now)).join(
                taken.distinct().withColumn("taken", F.lit(True)), ["type", "key"], "left"
            )
            unknown = F.size(F.array_except(F.map_keys("values"), properties.cast("array<string>"))) > 0
            reason = (
                F.when(F.col("misused"), X.MISUSED)
                .when(~F.col("type").isin(list(known_types)), "Object type unavailable")
                .when(unknown, "Unknown object property")
                .when(F.coalesce(F.length("key"), F.lit(0)) == 0, "A primary key is required")
                .when(F.col("taken"), TAKEN)
            )
            judged = cut(placed.where(~F.col("repeated")).withColumn("reason", reason))
            winners, refused = X.first_fine(judged, ABOUT["object"], TAKEN)
            return winners.withColumn("logical_id", logical).withColumn("created_at", F.col("submitted_at")), refused

        return self._apply("object", judge)

    def link(self, records: DataFrame, links: DataFrame) -> DataFrame:
        """Link or unlink pairs of records (``LINKED``) that exist; returns ``edit_id``, the pair and
        ``reason`` of the refused ones."""

        def judge(now: int) -> tuple[DataFrame, DataFrame]:
            about = ABOUT["relation"]
            requests = links.withColumn("request_hash", _hash(*about, "enabled", "revision"))
            ends = links.select(F.explode(F.array("from_logical_id", "to_logical_id")).alias("logical_id")).distinct()
            known = records.select("logical_id").join(ends, "logical_id", "left_semi").distinct()
            start = known.select(F.col("logical_id").alias("from_logical_id"), F.lit(True).alias("starts"))
            stop = known.select(F.col("logical_id").alias("to_logical_id"), F.lit(True).alias("stops"))
            current = self._present("relation", ["revision"], now, 0).withColumnRenamed("revision", "old_revision")
            placed = X.with_first_uses(requests, self._done(now))
            placed = placed.join(start, "from_logical_id", "left").join(stop, "to_logical_id", "left").join(current, about, "left")
            reason = (
                F.when(F.col("misused"), X.MISUSED)
                .when(F.col("starts").isNull() | F.col("stops").isNull(), "Objects unavailable")
                .when(F.col("revision") != F.coalesce("old_revision", F.lit(0)), RELATION_CHANGED)
            )
            judged = cut(placed.where(~F.col("repeated")).withColumn("reason", reason))
            winners, refused = X.first_fine(judged, about, RELATION_CHANGED)
            after = winners.withColumn("revision", F.col("revision") + 1).withColumn("created_at", F.col("submitted_at"))
            return after, refused

        return self._apply("relation", judge)

