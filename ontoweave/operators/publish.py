"""From connected datasets to a published generation, in one call."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

from ..functions.jobs import together
from ..plans.runs import PipelineDef, run_checks
from . import dashboards as D
from . import entities as E
from . import validate as V
from .dashboards import Widget
from .editstore import EditStore
from .entities import Bundle
from .objects import Graph, PublicationRefused
from .snapshots import Snapshots


@dataclass(frozen=True)
class Proposal:
    """Definitions with the report of their checks and what they were checked on."""

    bundle: Bundle
    report: tuple[V.CheckResult, ...]
    versions: dict[str, str]
    base: str | None

    @property
    def valid(self) -> bool:
        return all(c.passed for c in self.report)


def input_ids(bundle: Bundle) -> list[str]:
    """Stored datasets a bundle reads or describes: those of its derived tables and pipelines, of
    its types, widgets and catalog."""
    made = [*bundle.tables, *bundle.pipelines]
    derived = {x.id for x in made}
    read = [i for x in made for i in x.inputs] + [t.dataset for t in bundle.types]
    read += [i for d in bundle.dashboards for w in d.widgets for i in w.inputs]
    read += [dataset for dataset, _, _ in bundle.catalog]
    return [i for i in dict.fromkeys(read) if i not in derived]


def _columns(tables: dict[str, DataFrame]) -> dict[str, list[tuple[str, str]]]:
    return {i: E.columns_of(df) for i, df in tables.items()}


def _served(store: Snapshots) -> dict[str, str]:
    """The active version of every dataset that serves one, derived tables aside."""
    served = store.registry().where("active_version IS NOT NULL AND generation IS NULL")
    return {r["dataset_id"]: r["active_version"] for r in served.select("dataset_id", "active_version").collect()}


def propose(store: Snapshots, graph: Graph, bundle: Bundle) -> Proposal:
    """Check a bundle on the active versions; failing definitions, such as those about a
    dataset the store does not serve, are left out and the rest is checked again."""
    served = _served(store)
    versions = {i: served[i] for i in input_ids(bundle) if i in served}
    tables = {i: store.active(i) for i in versions}
    report = V.validate_bundle(tables, _columns(tables), bundle)
    if not all(c.passed for c in report):
        bundle = V.drop_failing(bundle, report)
        versions = {i: versions[i] for i in input_ids(bundle)}
        report = V.validate_bundle(tables, _columns(tables), bundle)
    return Proposal(V.presented(bundle, tables, _columns(tables)), tuple(report), versions, graph.active())


def publish(
    store: Snapshots,
    graph: Graph,
    proposal: Proposal,
    manual: DataFrame | None = None,
    relation_edits: DataFrame | None = None,
    actor: str = "",
    generation: str | None = None,
    stored: EditStore | None = None,
) -> str:
    """Write a valid proposal's derived tables, lineage, objects, relations and dashboards under a
    new generation, which readers see when its pointer is written at the end. Tables are built in
    the order they read each other; a pipeline whose written rows fail a check stops it all."""
    if not proposal.valid:
        raise PublicationRefused("Definitions must pass validation")
    bundle = proposal.bundle
    generation = generation or str(uuid.uuid4())
    served = _served(store)
    versions = {i: served.get(i) for i in input_ids(bundle)}
    if versions != proposal.versions:
        raise PublicationRefused("Input data changed. Revalidate these definitions.")
    tables = {i: store.active(i) for i in versions}
    made = E.build_order(bundle)
    for x in made:
        store.commit(x.id, x.name, E.derive(x, tables, _columns(tables)), generation=generation)
        store.record_lineage(x.id, x.inputs, generation)
        tables[x.id] = store.active(x.id, generation)
        if isinstance(x, PipelineDef):
            report = run_checks(tables[x.id], {i: tables[i] for i in x.inputs}, x.checks)
            failed = [r["name"] for r in report.collect() if not r["passed"]]
            if failed:
                raise PublicationRefused(f"Quality check failed: {', '.join(failed)}")
    return graph.publish(
        bundle,
        tables,
        base=proposal.base,
        recorded=proposal.versions,
        versions=versions | {x.id: generation for x in made},
        manual=manual,
        relation_edits=relation_edits,
        actor=actor,
        generation=generation,
        stored=stored,
    )


def show(store: Snapshots, graph: Graph, dashboard: str, title: str) -> tuple[DataFrame, Widget]:
    """The rows of a published widget, over the datasets as the active generation sees them."""
    generation = graph.active()
    found = [w for d in graph.dashboards(generation) if d.name == dashboard for w in d.widgets if w.title == title]
    if not found:
        raise ValueError("Unknown widget")
    return D.widget(store.inputs(found[0].inputs, generation), found[0])


def store_all(store: Snapshots, datasets: Sequence) -> None:
    """Commit datasets (as :class:`keys.Dataset`) as snapshots, several of them at once."""
    together([partial(store.commit, d.id, d.name, d.df, source_id=d.system or None) for d in datasets])
