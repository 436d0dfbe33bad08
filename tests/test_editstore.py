import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_publication import BUNDLE, CUSTOMER, ORDER, edit, logical

from ontoweave.operators import edits as X
from ontoweave.operators import editstore as S
from ontoweave.operators import objects as O

TYPES = [CUSTOMER, ORDER]
AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def tables(frame):
    return {
        "customers": frame([("A", "EU", "a@example.com"), ("B", "NA", "b@example.com")], "id string, region string, email string"),
        "orders": frame([(1, "A", 10, "delayed"), (2, "A", 20, "done"), (3, "B", 5, "done")], "id int, customer string, amount int, status string"),
    }


@pytest.fixture
def graph(spark, tmp_path, tables):
    store = O.Graph(spark, str(tmp_path / "graph"))
    store.publish(BUNDLE, tables, generation="g1")
    return store


@pytest.fixture
def stored(spark, tmp_path):
    return S.EditStore(spark, str(tmp_path / "edits"))


def region(graph, stored):
    people = graph.records(stored).where("type = 'Customer'")
    return {r["key"]: (r["effective"].get("region"), r["revision"]) for r in people.collect()}


def test_edits_survive_publication(graph, stored, tables, frame):
    batch = frame([edit(1, "A", {"region": "FR"})], X.EDIT)
    assert stored.apply(graph.records(stored), batch, TYPES).isEmpty()
    assert region(graph, stored) == {"A": ("FR", 1), "B": ("NA", 0)}
    fresh = {**tables, "customers": tables["customers"].withColumn("region", F.lit("XX"))}
    graph.publish(BUNDLE, fresh, base="g1", generation="g2", stored=stored)
    assert region(graph, stored) == {"A": ("FR", 1), "B": ("XX", 0)}
    assert rows(stored.audit(), "actor", "object_id") == [("ada", f"g1_{logical('Customer', 'A')}")]
    entry = stored.audit().first()
    assert (entry["before"]["region"], entry["values"]) == ("EU", {"region": "FR"})


def test_a_batch_that_is_sent_again_changes_nothing(graph, stored, frame):
    batch = frame([edit(1, "A", {"region": "FR"}), edit(2, "B", {"email": None})], X.EDIT)
    stored.apply(graph.records(stored), batch, TYPES)
    before = (stored.version(), rows(stored.overlays()))
    assert stored.apply(graph.records(stored), batch, TYPES).isEmpty()
    assert (stored.version(), rows(stored.overlays())) == before
    other = frame([edit(1, "A", {"region": "ES"}, revision=1)], X.EDIT)
    assert rows(stored.apply(graph.records(stored), other, TYPES), "reason") == [(X.MISUSED,)]
    undone = frame([edit(9, "A", {}, revision=1, revert=True)], X.EDIT)
    stored.apply(graph.records(stored), undone, TYPES)
    assert region(graph, stored)["A"] == ("EU", 2)


def test_of_two_writers_at_one_revision_one_is_refused(spark, graph, stored, frame):
    other = S.EditStore(spark, stored.root)
    records = graph.records(stored)
    met = []

    class Late(S.EditStore):
        """A writer whom another one overtakes between judging and committing."""

        def version(self):
            now = super().version()
            if not met:
                met.append(rows(other.apply(records, frame([edit(2, "A", {"region": "DE"}, at=3)], X.EDIT), TYPES)))
            return now

    late = Late(spark, stored.root)
    refused = late.apply(records, frame([edit(1, "A", {"region": "FR"}), edit(3, "B", {"region": "UK"})], X.EDIT), TYPES)
    assert met == [[]] and rows(refused, "edit_id", "reason") == [("e1", X.CHANGED)]
    assert region(graph, stored) == {"A": ("DE", 1), "B": ("UK", 1)}, "the edit of another record goes through"
    assert stored.version() == 2


def created(frame, *made):
    filled = [(f"c{n}", t, key, values, f"create-{n}", "ada", AT) for n, t, key, values in made]
    return frame(filled, S.CREATED)


def test_created_objects(graph, stored, tables, frame):
    wanted = created(
        frame, (1, "Customer", "C", {"id": "C", "region": "EU"}), (2, "Customer", "A", {"id": "A"}), (3, "Gone", "x", {}),
        (4, "Customer", "D", {"nope": "1"}), (5, "Customer", "", {"id": ""}), (6, "Customer", "C", {"id": "C"}), (7, "Customer", None, {}),
    )
    refused = stored.create(graph.records(stored), wanted, TYPES)
    assert rows(refused, "edit_id", "reason") == [
        ("c2", S.TAKEN), ("c3", "Object type unavailable"), ("c4", "Unknown object property"),
        ("c5", "A primary key is required"), ("c6", S.TAKEN), ("c7", "A primary key is required"),
    ]
    assert region(graph, stored)["C"] == ("EU", 0), "seen before the next publication"
    stored.apply(graph.records(stored), frame([edit(1, "C", {"region": "FR"})], X.EDIT), TYPES)
    graph.publish(BUNDLE, tables, base="g1", generation="g2", stored=stored)
    assert region(graph, stored) == {"A": ("EU", 0), "B": ("NA", 0), "C": ("FR", 1)}
    assert graph.objects().where("manual").count() == 1
    again = created(frame, (1, "Customer", "C", {"id": "C", "region": "EU"}), (8, "Customer", "C", {"id": "C"}))
    assert rows(stored.create(graph.records(stored), again, TYPES), "edit_id") == [("c8",)]


def linked(frame, *made):
    filled = [
        (f"l{n}", logical("Order", a), logical("Customer", b), name, enabled, revision, f"link-{n}", "ada", AT)
        for n, a, b, name, enabled, revision in made
    ]
    return frame(filled, S.LINKED)


def test_links_and_unlinks(graph, stored, tables, frame):
    first = linked(frame, (1, 1, "B", "reviewed by", True, 0), (2, 2, "A", "placed by", False, 0), (3, 3, "gone", "placed by", True, 0))
    assert rows(stored.link(graph.records(stored), first), "edit_id", "reason") == [("l3", "Objects unavailable")]

    def pairs(generation):
        at = len(generation) + 1
        return {(r["name"], r["from_id"][at:], r["to_id"][at:]) for r in graph.links(stored).collect()}

    wanted = {
        ("reviewed by", logical("Order", 1), logical("Customer", "B")),
        ("placed by", logical("Order", 1), logical("Customer", "A")),
        ("placed by", logical("Order", 3), logical("Customer", "B")),
    }
    assert pairs("g1") == wanted
    graph.publish(BUNDLE, tables, base="g1", generation="g2", stored=stored)
    assert pairs("g2") == wanted and graph.relations().count() == 3
    stale = linked(frame, (4, 1, "B", "reviewed by", False, 0))
    assert rows(stored.link(graph.records(stored), stale), "reason") == [(S.RELATION_CHANGED,)]
    assert stored.link(graph.records(stored), linked(frame, (5, 1, "B", "reviewed by", False, 1))).isEmpty()
    assert pairs("g2") == wanted - {("reviewed by", logical("Order", 1), logical("Customer", "B"))}


def test_folds_keep_every_row(graph, stored, frame, monkeypatch):
    monkeypatch.setattr(S, "FOLD_EVERY", 3)
    records = graph.records(stored).cache()
    for n in range(7):
        assert stored.apply(records, frame([edit(n, "A", {"region": f"R{n}"}, revision=n)], X.EDIT), TYPES).isEmpty()
    fold, batches = stored._folders("record")
    assert fold["batches"] == 6 and len(batches) == 1
    assert region(graph, stored)["A"] == ("R6", 7) and stored.audit().count() == 7
    again = frame([edit(0, "A", {"region": "R0"}, revision=0)], X.EDIT)
    assert stored.apply(records, again, TYPES).isEmpty() and region(graph, stored)["A"] == ("R6", 7)
    assert stored.overlays(3).first()["values"] == {"region": "R2"}, "the state as of an earlier version"


def test_of_two_publications_on_one_base_one_is_refused(spark, graph, tables):
    other = O.Graph(spark, graph.root)

    class Late(O.Graph):
        def _write(self, name, df, generation, order):
            super()._write(name, df, generation, order)
            if name == "relations_to" and other.active() == "g1":
                other.publish(BUNDLE, tables, base="g1", generation="g2")

    with pytest.raises(O.PublicationRefused, match="Published definitions changed"):
        Late(spark, graph.root).publish(BUNDLE, tables, base="g1", generation="g3")
    assert graph.active() == "g2" and graph.pointer()["previous"] == "g1"
