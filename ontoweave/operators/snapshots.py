"""Datasets as immutable Parquet versions with a registry of which one is active.

Layout under one root folder::

    data/<dataset>/<version>/     the rows of one version
    log/                          facts: registry, versions with their profiles, findings, lineage

A commit to the log states a version, its finding and the dataset's new pointers at once, after
the rows are written, so a job that dies leaves nothing half done and may run again. Writers of
different datasets do not disturb each other; of two that change one dataset from the same
state the second is refused.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from threading import RLock

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.local import local_frame
from . import profile as P
from . import query as Q
from .log import Conflict, Fact, Log

COLUMN = (
    "struct<position: int, name: string, type: string, rows: bigint, nulls: bigint, "
    "distinct: bigint, sensitive: boolean, primary_key: boolean>"
)
VERSIONS = (
    "dataset_id string, version string, rows bigint, duplicate_rows bigint, "
    f"fingerprint string, columns array<{COLUMN}>, created_at timestamp"
)
REGISTRY = (
    "dataset_id string, seq bigint, name string, source_id string, table_name string, "
    "active_version string, pending_version string, generation string, synced_at timestamp"
)
FINDINGS = (
    "dataset_id string, version string, title string, kind string, rows_before bigint, "
    "rows_after bigint, issues array<string>, duplicate_rows bigint, fingerprint string, "
    "dismissed boolean, created_at timestamp"
)
LINEAGE = "from_id string, to_id string, input_version string, generation string"


def schema_of(columns: Sequence[Mapping]) -> list[tuple[str, str]]:
    return [(c["name"], c["type"]) for c in columns]


def drifted(before: Sequence[Mapping], after: Sequence[Mapping]) -> bool:
    """An ordered list of names and types that is not the one being served."""
    return schema_of(before) != schema_of(after)


def quality_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that lost uniqueness or hold a higher share of nulls than before.

    Both sides are column profiles: one row per column.
    """
    old = before.select(
        "name",
        F.col("primary_key").alias("was_key"),
        (F.col("nulls") / F.greatest("rows", F.lit(1))).alias("null_rate_before"),
    )
    rate = F.col("nulls") / F.greatest("rows", F.lit(1))
    compared = after.join(old, "name").select(
        "name",
        (F.col("was_key") & ~F.col("primary_key")).alias("lost_key"),
        (rate > F.col("null_rate_before")).alias("more_nulls"),
    )
    issues = F.array(
        F.when(
            F.col("lost_key"), F.concat(F.col("name"), F.lit(" lost uniqueness or contains nulls"))
        ),
        F.when(F.col("more_nulls"), F.concat(F.col("name"), F.lit(" null rate increased"))),
    )
    return compared.select("name", F.explode(F.array_compact(issues)).alias("issue"))


def schema_signature(schemas: Mapping[str, Sequence[tuple[str, str]]]) -> str:
    """Changes with a dataset, a column name or a type; not with rows."""
    return digest(repr([(i, list(map(tuple, schemas[i]))) for i in sorted(schemas)]))


COLUMN_NAMES = [part.split(":")[0] for part in COLUMN[len("struct<") : -1].split(", ")]


def _named(columns: Sequence) -> list[dict]:
    """Column profiles, rows or tuples of them, by name."""
    return [
        {n: c[n] for n in COLUMN_NAMES} if isinstance(c, (dict, Row)) else dict(zip(COLUMN_NAMES, c, strict=True)) for c in columns
    ]


@dataclass
class Snapshots:
    spark: SparkSession
    root: str

    log: Log = field(init=False, repr=False)
    # Threads of one store write rows side by side, and read and state facts one after another.
    _turn: RLock = field(default_factory=RLock, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.log = Log(self.spark, f"{self.root}/log")

    # What the log states.

    def versions(self) -> DataFrame:
        return self.log.frame("version", VERSIONS).drop("commit")

    def findings(self) -> DataFrame:
        return self.log.frame("finding", FINDINGS).drop("commit")

    def lineage(self) -> DataFrame:
        return self.log.frame("lineage", LINEAGE).drop("commit")

    def registry(self) -> DataFrame:
        """The present state of every dataset."""
        return self.log.frame("registry", REGISTRY).drop("commit")

    def history(self, dataset_id: str) -> list[str]:
        """The versions of a dataset, newest first."""
        known = self.log.frame("version", VERSIONS).where(F.col("dataset_id") == dataset_id)
        return [r["version"] for r in known.orderBy(F.desc("commit")).select("version").collect()]

    def state(self, dataset_id: str) -> dict | None:
        return self.log.get("registry", dataset_id)

    def version_profile(self, dataset_id: str, version: str) -> dict | None:
        return self.log.get("version", f"{dataset_id}/{version}")

    def path(self, dataset_id: str, version: str) -> str:
        return f"{self.root}/data/{dataset_id}/{version}"

    def _point(self, old: dict | None, dataset_id: str, facts: Sequence[Fact] = (), **values) -> dict:
        """Move a dataset's pointers from the state that was read, with what goes along."""
        fields = [part.split()[0] for part in REGISTRY.split(", ")]
        known = (old or {}) | values | {"dataset_id": dataset_id}
        known["seq"] = (old["seq"] if old else 0) + 1
        known["synced_at"] = dt.datetime.now(dt.timezone.utc).isoformat()
        row = {f: known.get(f) for f in fields}

        def decide() -> list[Fact]:
            if self.state(dataset_id) != old:
                raise Conflict(f"{dataset_id} was changed by another writer")
            return [*facts, ("registry", dataset_id, row)]

        self.log.update(decide)
        return row

    # Versions.

    def commit(
        self,
        dataset_id: str,
        name: str,
        df: DataFrame,
        version: str | None = None,
        source_id: str | None = None,
        generation: str | None = None,
    ) -> dict:
        """Write one complete snapshot. A changed schema waits as pending; otherwise the
        new version is served at once. Committing a version again changes nothing.

        A derived dataset has one version per ``generation``, named for it; definitions
        decide its schema, so no schema waits."""

        def write(path: str) -> DataFrame:
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        return self._commit(dataset_id, name, write, version, source_id, generation)

    def ingest(
        self, dataset_id: str, name: str, path: str, format: str | None = None, version: str | None = None, source_id: str | None = None
    ) -> dict:
        """Commit a file or folder as a snapshot. JSON lines are parsed once for their types and once as they are written."""
        from ..sources import files

        kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
        if kind not in ("jsonl", "ndjson"):
            return self.commit(dataset_id, name, files.scan(self.spark, path, kind), version, source_id)
        return self._commit(dataset_id, name, lambda target: files.land_json_lines(self.spark, path, target), version, source_id, None)

    def _commit(
        self, dataset_id: str, name: str, write: Callable[[str], DataFrame], version: str | None, source_id: str | None, generation: str | None
    ) -> dict:
        with self._turn:
            old = self.state(dataset_id)
            version = generation or version
            if version and old and self.version_profile(dataset_id, version):
                return old
        version = version or str(uuid.uuid4())
        # A failed attempt may have left files that the log does not name.
        fresh = P.profile(write(self.path(dataset_id, version)))
        with self._turn:
            before = self.version_profile(dataset_id, old["active_version"]) if old else None
            now = dt.datetime.now(dt.timezone.utc).isoformat()
            about = {"dataset_id": dataset_id, "version": version, "created_at": now}
            kept = {c: fresh[c] for c in ("rows", "duplicate_rows", "fingerprint")}
            facts: list[Fact] = [("version", f"{dataset_id}/{version}", about | kept | {"columns": _named(fresh["columns"])})]
            drift = not generation and before is not None and drifted(before["columns"], fresh["columns"])
            if before is not None and before["fingerprint"] != fresh["fingerprint"]:
                found = quality_diff(self._columns(before), self._columns(fresh)).collect()
                finding = {
                    "title": ("Schema changed: " if drift else "Data refreshed: ") + name,
                    "kind": "schema" if drift else "refresh",
                    "rows_before": before["rows"],
                    "rows_after": fresh["rows"],
                    "issues": [r["issue"] for r in found],
                    "duplicate_rows": fresh["duplicate_rows"],
                    "fingerprint": fresh["fingerprint"],
                    "dismissed": False,
                }
                facts.append(("finding", f"{dataset_id}/{version}", about | finding))
            return self._point(
                old,
                dataset_id,
                facts,
                name=old["name"] if old else name,
                source_id=source_id or (old["source_id"] if old else None),
                table_name=Q.dataset_table(dataset_id),
                active_version=old["active_version"] if drift else version,
                pending_version=version if drift else None,
                generation=generation or (old["generation"] if old else None),
            )

    def _columns(self, profile: Mapping) -> DataFrame:
        columns = [tuple(c.values()) for c in _named(profile["columns"])]
        return local_frame(self.spark, columns, COLUMN[len("struct<") : -1])

    def accept(self, dataset_id: str) -> dict:
        """Serve the version that waits because of its schema."""
        old = self.state(dataset_id)
        if old is None or not old["pending_version"]:
            raise ValueError("No pending version")
        return self._point(old, dataset_id, active_version=old["pending_version"], pending_version=None)

    def active(self, dataset_id: str, generation: str | None = None) -> DataFrame:
        """The served rows. A derived dataset is read as its generation left it, so a new
        generation is not seen before readers move to it."""
        state = self.state(dataset_id)
        if state is None or not state["active_version"]:
            raise ValueError("Dataset is unavailable")
        version = state["active_version"]
        if state["generation"]:
            if not generation or not self.version_profile(dataset_id, generation):
                raise ValueError("Dataset is unavailable")
            version = generation
        return self.spark.read.parquet(self.path(dataset_id, version))

    def columns(self, dataset_id: str) -> DataFrame:
        """The column profile of the active version."""
        state = self.state(dataset_id)
        return self._columns(self.version_profile(dataset_id, state["active_version"]))

    def inputs(self, ids: Sequence[str], generation: str | None = None) -> dict[str, tuple[str, DataFrame]]:
        names = {i: self.state(i)["name"] if self.state(i) else i for i in dict.fromkeys(ids)}
        return {i: (name, self.active(i, generation)) for i, name in names.items()}

    def query(
        self,
        ids: Sequence[str],
        sql: str,
        filters: Sequence[Q.Filter] = (),
        persist: tuple[str, str] | None = None,
        generation: str | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """SQL over active versions, and the versions it read. ``persist=(id, name)`` also
        writes and profiles the result as a version; a plain query is never profiled."""
        result = Q.query_frames(self.inputs(ids, generation), sql, filters)
        citations = self.citations(ids)
        if persist:
            self.commit(*persist, result)
            result = self.active(persist[0])
        return result, citations

    def citations(self, ids: Sequence[str]) -> DataFrame:
        return (
            self.registry()
            .where(F.col("dataset_id").isin(list(ids)))
            .select("dataset_id", F.col("active_version").alias("version"), F.lit("dataset_snapshot").alias("state"))
        )

    # Guards and facts over the registry.

    def record_lineage(self, to_id: str, inputs: Sequence[str], generation: str | None = None) -> None:
        def decide() -> list[Fact]:
            read = {i: self.state(i)["active_version"] for i in inputs}
            names = ("from_id", "to_id", "input_version", "generation")
            rows = [dict(zip(names, (i, to_id, version, generation), strict=True)) for i, version in read.items()]
            return [("lineage", f"{to_id}/{i}/{run}", row) for i, row in zip(read, rows, strict=True)]

        run = uuid.uuid4().hex
        self.log.update(decide)


def stale_inputs(recorded: DataFrame, registry: DataFrame) -> DataFrame:
    """Recorded ``(dataset_id, version)`` pairs that are not the active version any more."""
    current = registry.select("dataset_id", "active_version")
    return recorded.join(current, "dataset_id", "left").where(
        ~F.col("version").eqNullSafe(F.col("active_version"))
    )


def readiness(datasets: DataFrame, sources: DataFrame, imports: DataFrame) -> DataFrame:
    """What still blocks setup, one row per blocker, from the latest import of each source
    or dataset.

    ``datasets(id, name, source_id, active_version, pending_version, rows)``,
    ``sources(id, name)``, ``imports(id, name, source_id, dataset_id, status, background,
    created_at)``.
    """
    latest = latest_imports(imports)
    served = datasets.where(F.col("active_version").isNotNull()).select("source_id").distinct()
    served = served.where(F.col("source_id").isNotNull()).withColumn("served", F.lit(True))
    unfinished = latest.join(served, "source_id", "left").where(
        (F.col("status") != "succeeded")
        & ~(
            F.col("background")
            & F.col("status").isin("queued", "running")
            & F.coalesce("served", F.lit(False))
        )
    )
    ended = F.col("status").isin("failed", "canceled")
    import_blockers = unfinished.select(
        F.col("id").alias("about"),
        F.concat(
            "name",
            F.when(ended, ": retry or remove this import.").otherwise(
                ": import is still in progress."
            ),
        ).alias("blocker"),
    )
    owned = datasets.select("source_id").unionByName(latest.select("source_id"))
    idle = sources.join(owned, sources["id"] == owned["source_id"], "left_anti").select(
        F.col("id").alias("about"),
        F.concat("name", F.lit(": start the import or remove this source.")).alias("blocker"),
    )
    drift = datasets.where(F.col("pending_version").isNotNull()).select(
        F.col("id").alias("about"),
        F.concat("name", F.lit(": review the schema change before continuing.")).alias("blocker"),
    )
    empty = datasets.where(
        F.col("active_version").isNull() | (F.coalesce("rows", F.lit(0)) == 0)
    ).select(
        F.col("id").alias("about"),
        F.concat(
            "name",
            F.lit(": no records to analyze. Add records or remove this dataset from setup."),
        ).alias("blocker"),
    )
    nothing = (
        datasets.agg(F.count(F.lit(1)).alias("n"))
        .where("n = 0")
        .select(F.lit(None).cast("string").alias("about"), F.lit("Import at least one dataset to continue.").alias("blocker"))
    )
    return import_blockers.unionByName(idle).unionByName(drift).unionByName(empty).unionByName(nothing)


def latest_imports(imports: DataFrame) -> DataFrame:
    """The last import of each source, else dataset, else of itself."""
    subject = F.coalesce("source_id", "dataset_id", "id")
    return (
        imports.groupBy(subject.alias("__subject"))
        .agg(F.max_by(F.struct(*imports.columns), F.struct("created_at", "id")).alias("r"))
        .select("r.*")
    )


def readiness_signature(datasets: DataFrame, sources: DataFrame, imports: DataFrame) -> DataFrame:
    """A digest of which versions, sources and unfinished imports setup is looking at.

    Parts are hashed where they are and summed, so no list of them is ever collected.
    """
    incomplete = latest_imports(imports).where(F.col("status") != "succeeded")
    parts = [
        datasets.select(
            F.concat_ws(
                "|", F.lit("d"), "id", F.coalesce("active_version", F.lit("-")), F.coalesce("pending_version", F.lit("-"))
            ).alias("part")
        ),
        sources.select(F.concat_ws("|", F.lit("s"), "id").alias("part")),
        incomplete.select(F.concat_ws("|", F.lit("i"), "id").alias("part")),
    ]
    hashed = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        F.xxhash64(F.lit(1), "part").alias("a"), F.xxhash64(F.lit(2), "part").alias("b")
    )
    return hashed.agg(
        F.sha2(
            F.concat_ws(
                "|",
                F.count(F.lit(1)).cast("string"),
                F.sum(F.col("a").cast("decimal(38,0)")).cast("string"),
                F.sum(F.col("b").cast("decimal(38,0)")).cast("string"),
            ),
            256,
        ).alias("signature")
    )
