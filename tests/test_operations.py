import datetime as dt
import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoweave.operators import feeds as D
from ontoweave.operators.snapshots import Snapshots
from ontoweave.plans.ordered import numbered_runs
from ontoweave.streaming import changes as C

AT = dt.datetime(2024, 1, 1)
JOBS = (
    "id string, name string, type string, status string, error string, updated_at timestamp_ntz, "
    "source_id string, dataset_id string, pipeline_id string, provider string"
)
RUNS = "id string, name string, goal string, task string, status string, updated_at timestamp_ntz"
AUDITS = "id string, name string, proposal_id string, object_id string, updated_at timestamp_ntz"


def at(minutes):
    return AT + dt.timedelta(minutes=minutes)


def test_activity(frame):
    jobs = frame(
        [
            ("j1", "Run Revenue", "pipeline", "succeeded", None, at(1), None, None, "p1", None),
            ("j2", "Sync Shop", "sync", "failed", "timeout", at(2), "s1", None, None, None),
            ("j3", "file.csv", "upload", "running", "", at(3), None, "d1", None, None),
            ("j4", "x", "provider_prepare", "failed", None, at(4), None, None, None, "openai"),
            ("j5", "x", "provider_prepare", "queued", None, at(5), None, None, None, None),
            ("j6", "Tidy up", "other", None, None, at(6), None, None, None, None),
        ],
        JOBS,
    )
    runs = frame(
        [
            ("r1", "n", "What sold?", None, "succeeded", at(7)),
            ("r2", "n", None, "home_metrics", "running", at(8)),
            ("r3", "n", None, "home_metrics", "succeeded", at(9)),
            ("r4", "Odd task", None, "unheard_of", "succeeded", at(9)),
        ],
        RUNS,
    )
    audits = frame(
        [("a1", "Published workspace", "p9", None, at(10)), ("a2", "Updated A", None, "g1_abc", at(11))], AUDITS
    )
    got = {r["id"]: r for r in D.activity_feed(jobs, runs, audits).collect()}
    assert {i: (r["kind"], r["label"], r["title"]) for i, r in got.items()} == {
        "j1": ("pipeline", "Pipeline build", "Revenue"),
        "j2": ("sync", "Sync", "Shop"),
        "j3": ("upload", "Upload", "file.csv"),
        "j4": ("model", "AI model", "Couldn’t prepare OpenAI"),
        "j5": ("model", "AI model", "Preparing the AI model"),
        "j6": ("job", "Job", "Tidy up"),
        "r1": ("run", "Analyst", "What sold?"),
        "r2": ("setup", "Setup", "Picking your key metrics"),
        "r3": ("setup", "Setup", "Picked your key metrics"),
        "r4": ("setup", "Setup", "Odd task"),
        "a1": ("publish", "Publication", "Published workspace"),
        "a2": ("edit", "Object edit", "Updated A"),
    }
    assert (got["j2"]["error"], got["j3"]["error"], got["j6"]["status"]) == ("timeout", None, "succeeded")
    assert (got["a1"]["proposal_id"], got["a2"]["logical_id"], got["r1"]["run_id"]) == ("p9", "abc", "r1")


FEED = "id string, kind string, title string, source_id string, at timestamp_ntz, repeats bigint"


def naive_collapse(items, mode):
    """One pass over the newest-first list, as a reader would do it."""
    out, by_key = [], {}
    for item in sorted(items, key=lambda r: (-r[4].timestamp(), r[0])):
        key = f"pipeline:{item[2]}" if item[1] == "pipeline" else f"sync:{item[3] or item[2]}" if item[1] == "sync" else None
        into = None
        if key and mode == "all":
            into = by_key.get(key)
        elif key and out and out[-1][1] == key:
            into = out[-1]
        if into:
            into[2] += 1 + item[5]
        else:
            out.append([item[0], key, item[5]])
            by_key[key] = out[-1]
    return sorted((i, n) for i, _, n in out)


@pytest.mark.parametrize("mode", ["all", "adjacent"])
@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_collapsing_repeats(frame, mode, hot):
    """Against a single pass; ``hot`` gives one source most entries."""
    rng = random.Random(7)
    items = []
    for i in range(400):
        kind = rng.choice(["pipeline", "sync", "sync", "run"])
        source = "s0" if rng.random() < hot else f"s{rng.randrange(3)}"
        items.append((f"i{i:03}", kind, f"t{rng.randrange(2)}", source if rng.random() < 0.9 else None, at(rng.randrange(150)), rng.randrange(2)))
    got = D.collapse(frame(items, FEED).repartition(5), mode)
    assert rows(got, "id", "repeats") == naive_collapse(items, mode)


def test_runs_of_neighbours_stay_within_their_group(frame):
    df = frame([(g, i, "k" if g else None) for g in range(3) for i in range(20)], "g int, i int, k string")
    got = numbered_runs(df, "g", "k", ["g", "i"], blocks=7).groupBy("g").agg(F.count_distinct("run").alias("n"))
    assert rows(got) == [(0, 20), (1, 1), (2, 1)]


def test_one_run_over_all_blocks(frame):
    df = frame([(0, i, "same") for i in range(100)], "g int, i int, k string")
    assert numbered_runs(df, "g", "k", ["g", "i"], blocks=8).select("run").distinct().count() == 1


SOURCES = "id string, name string, kind string, connection_id string, connection_name string, paused boolean, sync_status string"


def test_connection_health(frame):
    sources = frame(
        [
            ("s1", "a", "postgres", "c1", "Shop", False, "ready"), ("s2", "b", "postgres", "c1", "Shop", False, "ready"),
            ("s3", "c", "s3", None, None, True, "ready"), ("s4", "d", "s3", None, None, False, "retrying"),
            ("s5", "e", "s3", None, None, False, "ready"), ("s6", "f", "s3", None, None, False, "ready"),
        ],
        SOURCES,
    )
    jobs = frame(
        [
            ("j1", "", "sync", "failed", "old", at(1), "s1", None, None, None), ("j2", "", "sync", "succeeded", None, at(2), "s1", None, None, None),
            ("j3", "", "sync", "failed", "timeout", at(3), "s2", None, None, None), ("j4", "", "sync", "running", None, at(3), "s5", None, None, None),
        ],
        JOBS,
    )
    datasets = frame([("d1", "s1"), ("d2", "s1"), ("d3", "s6"), ("d4", None)], "id string, source_id string")
    got = {r["id"]: r for r in D.connection_health(sources, jobs, datasets).collect()}
    assert {i: r["status"] for i, r in got.items()} == {
        "c1": "failed", "s3": "paused", "s4": "failed", "s5": "syncing", "s6": "healthy",
    }
    shop = got["c1"]
    assert (shop["name"], shop["sources"], shop["datasets"], shop["last_sync_at"], shop["error"]) == ("Shop", 2, 2, at(2), "timeout")


def test_files_and_samples_are_connections(frame):
    datasets = frame(
        [("d1", None, "stripe", at(1)), ("d2", None, "stripe", at(2)), ("d3", None, None, at(3)), ("d4", "s1", None, at(9))],
        "id string, source_id string, sample_source string, updated_at timestamp_ntz",
    )
    uploads = frame([("u1", "failed", "bad csv", at(5)), ("u2", "succeeded", None, at(4))], "id string, status string, error string, updated_at timestamp_ntz")
    got = rows(D.unsourced_connections(datasets, uploads), "id", "name", "status", "datasets", "error")
    assert got == [("files", "Files and API", "failed", 1, "bad csv"), ("sample:stripe", "stripe", "healthy", 2, None)]


def test_failing_builds(frame):
    jobs = frame(
        [
            ("j1", "", "pipeline", "failed", "x", at(1), None, None, "p1", None), ("j2", "", "pipeline", "succeeded", None, at(2), None, None, "p1", None),
            ("j3", "", "pipeline", "failed", "y", at(2), None, None, "p2", None), ("j4", "", "pipeline", "failed", "z", at(2), None, None, "p3", None),
        ],
        JOBS,
    )
    known = frame([("p1", "One", "g1"), ("p2", "Two", "g1"), ("p3", "Three", "g0")], "id string, name string, generation string")
    assert rows(D.failing_builds(jobs, known, "g1"), "pipeline_id", "name", "error") == [("p2", "Two", "y")]


CHATS = "id string, goal string, thread_id string, previous_id string, task string, status string, created_at int, updated_at int"


def chat(i, previous=None, thread=None, task=None, status="succeeded"):
    return (f"r{i}", f"q{i}", thread, previous, task, status, i, i + 1)


def test_threads(frame):
    runs = frame(
        [
            chat(0), chat(1, "r0"), chat(2, "r1"), chat(3, "r1", status="failed"),  # a tree below r0
            chat(4, "missing"), chat(5, thread="t1"), chat(6, "r5"), chat(7, "r8"), chat(8, task="home_metrics"),
        ],
        CHATS,
    )
    got = rows(D.threads(runs), "id", "title", "turns", "status", "updated_at")
    assert got == [("r0", "q0", 4, "failed", 4), ("r4", "q4", 1, "succeeded", 5), ("r7", "q7", 1, "succeeded", 8), ("t1", "q5", 2, "succeeded", 7)]


def test_long_threads(frame):
    runs = frame([chat(i, f"r{i - 1}" if i else None) for i in range(300)], CHATS)
    assert rows(D.threads(runs), "id", "turns") == [("r0", 300)]


def test_circular_questions_are_refused(frame, monkeypatch):
    monkeypatch.setattr(D, "MOST_DOUBLINGS", 4)
    with pytest.raises(ValueError, match="circle"):
        D.threads(frame([chat(0, "r1"), chat(1, "r0")], CHATS))


def test_connection_groups(frame):
    sources = frame([("s1", "orders", "mysql", "c1", "Shop", False, ""), ("s2", "users", "mysql", "c1", "Shop", False, "")], SOURCES)
    imports = frame([("j1", "Sync", "sync", "s1"), ("j2", "a.csv", "upload", None), ("j3", "Sync", "sync", "gone")], "id string, name string, type string, source_id string")
    datasets = frame(
        [("d1", "orders", "s1", None, False), ("d2", "a", None, "j2", False), ("d3", "api rows", None, None, False),
         ("d4", "left over", "gone", None, False), ("d5", "sample", None, None, True)],
        "id string, name string, source_id string, import_job_id string, sample boolean",
    )
    sizes = D.group_sizes(D.connection_groups(sources, imports, datasets))
    assert rows(sizes, "group_id", "kind", "name", "sources", "imports", "datasets") == [
        ("c1", "mysql", "Shop", 2, 1, 1), ("d3", "api", "api rows", 0, 0, 1), ("d4", "upload", "left over", 0, 0, 1), ("j2", "upload", "a.csv", 0, 1, 1),
    ]


# Change capture.


def events(frame, *made):
    return frame(list(made), C.EVENT)


@pytest.fixture
def capture(spark, tmp_path):
    def run(*batches):
        for b in batches:
            b.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            stream = C.read_events(spark, str(tmp_path / "events"), 1)
            C.count_changes(stream, str(tmp_path / "state")).awaitTermination()
        return str(tmp_path / "state")

    return run


def test_commits_count_once(spark, frame, capture):
    state = capture(
        events(frame, ("a", "t1", 1, "connect"), ("a", "t1", 2, "insert"), ("a", "t1", 3, "update"), ("b", "t7", 1, "relation")),
        events(frame, ("a", "t1", 4, "commit"), ("a", "t2", 5, "begin"), ("a", "t2", 6, "commit"), ("b", "t7", 2, "delete")),
        events(frame, ("b", "t7", 3, "commit"), ("a", "t3", 9, "truncate")),
    )
    # The connect, and t1 across two batches; t2 touched nothing; t3 has not committed.
    assert rows(C.counters(spark, state), "source", "changes", "cursor") == [("a", 2, 6), ("b", 1, 3)]


def test_a_restarted_stream_goes_on_and_its_state_stays_small(spark, frame, tmp_path, monkeypatch):
    """Many micro-batches, stopped and started again: counts as one batch would, in few files."""
    import os

    from ontoweave.operators import log

    monkeypatch.setattr(log, "EVERY", 4)
    monkeypatch.setattr(C, "Log", lambda *a, **how: log.Log(*a, every=4, **how))
    path, sizes, n = str(tmp_path / "events"), [], 0
    for part in range(2):
        for _ in range(9):
            made = [("a", f"t{n}", 2 * n, "insert"), ("a", f"t{n - 1}", 2 * n + 1, "commit"), ("b", f"u{n}", n, "relation"), ("b", f"u{n}", n, "commit")]
            events(frame, *made).coalesce(1).write.mode("append").parquet(path)
            n += 1
        C.count_changes(C.read_events(spark, path, 1), str(tmp_path / "state")).awaitTermination()
        sizes.append(len(os.listdir(tmp_path / "state" / "counters")))
    # Every insert but the last has its commit one batch later.
    assert rows(C.counters(spark, str(tmp_path / "state")), "source", "changes", "cursor") == [("a", n - 1, 2 * n - 1), ("b", 0, n - 1)]
    assert sizes[1] <= sizes[0] + 8, sizes


def test_transactions_that_never_commit_expire():
    import pandas as pd

    class State:
        hasTimedOut, exists, value, timeout = False, False, None, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists, self.value = False, None

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

    def part(*tags):
        return pd.DataFrame({"source": "a", "tx": "t", "lsn": range(len(tags)), "tag": tags, "seen_at": pd.Timestamp(1000, unit="s")})

    track, state = C.tracker(expires_hours=2), State()
    assert list(track(("a", "t"), iter([part("insert"), part("relation")]), state)) == []
    assert state.value == (True, 0) and state.timeout == 8_200_000
    state.hasTimedOut = True
    assert list(track(("a", "t"), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    (late,) = track(("a", "t"), iter([part("relation", "commit")]), state)
    assert late.to_dict("records") == [{"source": "a", "changes": 0, "cursor": 1}] and not state.exists
    (both,) = track(("a", None), iter([part("connect", "connect")]), state)
    assert both["changes"].tolist() == [2] and both["cursor"].isna().all()


def test_a_batch_that_runs_again_changes_nothing(spark, frame):
    empty = frame([], "source string, changes bigint, cursor bigint"), frame([], "source string, tx string, changed boolean, lsn bigint")
    batch = events(frame, ("a", "t1", 1, "insert"), ("a", "t1", 2, "commit"))
    once, twice = C.advance(*empty, batch)[0], C.advance(*empty, batch)[0]
    assert rows(once) == rows(twice) == [("a", 1, 2)]


def test_refresh_sees_only_what_it_read(spark, frame, capture, tmp_path):
    state = capture(events(frame, ("a", "t1", 1, "insert"), ("a", "t1", 2, "commit")))
    store = Snapshots(spark, str(tmp_path / "store"))
    datasets = frame([("a",)], "source string")
    dirty = lambda: rows(C.needs_refresh(C.counters(spark, state), C.applied(spark, state), datasets))
    assert dirty() == [("a", 1, 0)]

    def load():
        capture(events(frame, ("a", "t2", 3, "insert"), ("a", "t2", 4, "commit")))  # commits during the import
        return frame([(1,)], "id int")

    C.refresh(store, state, "a", "orders", "Orders", load)
    assert dirty() == [("a", 2, 1)]
    C.refresh(store, state, "a", "orders", "Orders", lambda: frame([(1,), (2,)], "id int"))
    assert dirty() == [] and store.active("orders").count() == 2
    assert rows(C.needs_refresh(C.counters(spark, state), frame([], C.APPLIED), frame([("z",)], "source string"))) == []


def test_schedules(frame):
    kinds = frame([(k, k) for k in ("postgres", "mysql", "stripe", "posthog", "rest")], "id string, kind string")
    assert rows(C.sync_defaults(kinds), "id", "mode", "every_minutes") == [
        ("mysql", "auto", None), ("postgres", "auto", None), ("posthog", "snapshot", 360), ("rest", "snapshot", 5), ("stripe", "snapshot", 60),
    ]
    planned = frame(
        [("cdc", "cdc", "x", AT), ("auto", "auto", "x", AT), ("snap", "snapshot", None, AT), ("later", "snapshot", None, at(9)),
         ("legacy", None, "x", AT), ("none", None, None, AT)],
        "id string, mode string, schedule string, next_run timestamp_ntz",
    )
    assert rows(C.refresh_due(planned, at(1)), "id") == [("legacy",), ("snap",)]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_counters_do_not_depend_on_batches(spark, data):
    """Any cut of a change stream into micro-batches counts what one batch counts."""
    from ontoweave.functions.local import local_frame

    txs = data.draw(st.lists(st.tuples(st.sampled_from("ab"), st.lists(st.sampled_from(["insert", "relation"]), max_size=3)), min_size=1, max_size=5))
    made = []
    for n, (source, tags) in enumerate(txs):
        made += [(source, f"t{n}", tag) for tag in [*tags, "commit"]]
    made = [(source, tx, i, tag) for i, (source, tx, tag) in enumerate(made)]
    cuts = sorted(data.draw(st.sets(st.integers(1, len(made)), max_size=2)) | {0, len(made)})
    counters = local_frame(spark, [], "source string, changes bigint, cursor bigint")
    still = local_frame(spark, [], "source string, tx string, changed boolean, lsn bigint")
    for lo, hi in zip(cuts, cuts[1:]):
        counters, still = C.advance(counters, still, local_frame(spark, made[lo:hi], C.EVENT))
    wanted = {}
    for n, (source, tags) in enumerate(txs):
        last = max(lsn for s, tx, lsn, _ in made if tx == f"t{n}")
        changes, cursor = wanted.get(source, (0, -1))
        wanted[source] = (changes + ("insert" in tags), max(cursor, last))
    assert rows(counters, "source", "changes", "cursor") == sorted((s, *w) for s, w in wanted.items())
    assert still.isEmpty()
