import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoweave.llm import secrets

ACCESS, KEY = "AKIA" + "Q7" * 8, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def base(text):
    """Every match of the stated patterns, then the stated lengths."""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda p: (p[1], secrets.KINDS.index(p[0])))


def test_strong_parts_by_brute_force():
    draw = random.Random(4)
    words = ["token", "SECRET", "Passwd", "api_key", "apikey", "API_KEY", "=", ":", " ", "'", '"', "abc", "abcdef", "0123456789abcdef" * 2, ACCESS, "AKIA", "é", "ſecret", "toKen", "\n", "  ", "-", "😀", "A1B2", "secrets"]
    for _ in range(3000):
        text = "".join(draw.choice(words) for _ in range(draw.randrange(25)))
        parts = secrets.linked_parts(text)
        assert [p[:3] for p in parts if p[0] in secrets.BASE] == base(text), text


def test_a_dropped_match_still_takes_its_text():
    assert base("token: token: abcdefgh") == []
    assert secrets.linked_parts("token: token: abcdefgh") == []
    assert [p[0] for p in secrets.linked_parts("token: abcdefgh")] == ["assign"]


def test_weak_parts_need_a_complement_in_scope():
    kinds = lambda text: [p[0] for p in secrets.linked_parts(text)]
    assert kinds(f"{KEY} https://s3.example/x") == []
    assert kinds(f"{ACCESS} {KEY}") == ["access", "key"]
    assert kinds(f"{KEY}\n{ACCESS}\nhttps://s3.example/x") == ["key", "access", "endpoint"]
    assert kinds(f"{ACCESS}\n\n{KEY}") == ["access"], "another paragraph"
    assert kinds(f"{ACCESS} {'x ' * 300}{KEY}") == ["access"], "out of reach"
    assert kinds("password=hunter22 at https://db.example") == ["assign", "endpoint"]
    assert kinds(f"secret={KEY} {ACCESS}") == ["assign", "access"], "the key is the assigned secret"
    (_, key) = secrets.linked_parts(f"{ACCESS} {KEY}")
    assert key == ("key", 21, 61, 0)


@pytest.mark.parametrize("name", ["aws_secret_access_key", "AWS_SECRET_ACCESS_KEY", "secret_key", "SecretAccessKey"])
@pytest.mark.parametrize(
    "form", ["{n}={k}", "{n} = {k}", "{n}: {k}", "{n}:{k}", '{n}="{k}"', "export {n}='{k}'", '{{"{n}":"{k}"}}', "https://s3.example/x?a=1&{n}={k}&b=2"]
)
def test_a_key_after_any_assignment_sign(name, form):
    for text in (f"id={ACCESS}\n{form.format(n=name, k=KEY)}", f"{form.format(n=name, k=KEY)}\nid={ACCESS}"):
        at = text.index(KEY)
        assert [p[1:] for p in secrets.linked_parts(text) if p[0] == "key"] == [(at, at + 40, text.index(ACCESS))], text


def test_what_is_no_key_after_an_assignment_sign():
    kinds = lambda text: [p[0] for p in secrets.linked_parts(text)]
    assert kinds(f"{ACCESS} secret_key={KEY}a") == kinds(f"{ACCESS} secret_key={KEY}=") == ["access"], "a longer value"
    assert kinds(f"secret_key={KEY}") == [], "no complement"
    assert kinds(f"secret={ACCESS}={KEY}") == ["assign", "access"], "inside an assigned secret, behind another part"


def test_assigned_keys_leave_the_text(spark):
    docs = spark.createDataFrame([(1, f"AWS_ACCESS_KEY_ID={ACCESS}\nAWS_SECRET_ACCESS_KEY={KEY}\n", None)], "doc_id bigint, text string, n_chars int")
    (row,) = corpus_pipeline.hide_secrets(spark, docs, "").collect()
    assert row["text"] == "AWS_ACCESS_KEY_ID=[secret]\nAWS_SECRET_ACCESS_KEY=[secret]\n" and row["n_chars"] == len(row["text"])


def test_a_long_paragraph_is_one_scope(spark):
    filler = "x " * 5000
    texts = [f"{ACCESS} {filler}{KEY}", f"{KEY} {filler}{ACCESS}", f"password=hunter22 {filler}https://db.example", f"{ACCESS}\n\n{filler}{KEY}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for reach, wanted in ((None, [["access", "key"], ["key", "access"], ["assign", "endpoint"], ["access"]]), (400, [["access"], ["access"], ["assign"], ["access"]])):
        found = secrets.find(docs, reach).orderBy("doc_id").collect()
        assert [[p["kind"] for p in r["spans"]] for r in found] == wanted
    assert [p["kind"] for p in secrets.find(docs).orderBy("doc_id").first()["spans"]] == ["access", "key"]
    hidden = corpus_pipeline.hide_secrets(spark, docs, "").collect()
    assert KEY not in "".join(r["text"] for r in hidden if r["doc_id"] < 2)


def test_a_long_part_before_is_measured_by_its_end():
    # The assigned value holds an access identifier whose own end is out of reach.
    text = f"token={ACCESS}.{'x' * 500} https://db.example"
    assert [p for p in secrets.linked_parts(text) if p[0] == "endpoint"] == [("endpoint", text.index("https"), len(text), 0)]


def test_closest_parts_by_brute_force():
    draw = random.Random(7)
    words = [ACCESS, KEY, f"token={ACCESS}.{'x' * 60}", "secret=abcdefgh", "https://s3.example/x", "\n\n", "\n", " ", "y" * 30, "="]
    for _ in range(1500):
        text = "".join(draw.choice(words) + draw.choice([" ", ", ", ""]) for _ in range(draw.randrange(14)))
        strong = secrets.strong_parts(text)
        bounds = [0, *(m.end() for m in secrets.BLANK.finditer(text)), len(text) + 1]
        for reach in (None, 40, 400):
            wanted = {}
            for kind, pattern, others in (("key", secrets.KEY, ("access",)), ("endpoint", secrets.ENDPOINT, ("access", "assign"))):
                for m in pattern.finditer(text):
                    start, end = m.span()
                    low, high = next(p for p in zip(bounds, bounds[1:]) if p[0] <= start < p[1])
                    gaps = [max(s - end, start - e, 0) for k, s, e in strong if k in others and low <= s < high]
                    within = kind == "key" and any(s <= start and end <= e for _, s, e in strong)
                    if gaps and not within and (reach is None or min(gaps) <= reach):
                        wanted[kind, start, end] = min(gaps)
            got = {}
            for kind, start, end, anchor in secrets.linked_parts(text, reach):
                if anchor is not None:
                    got[kind, start, end] = min(max(s - end, start - e, 0) for k, s, e in strong if s == anchor and k in ("access", "assign")[: 1 + (kind == "endpoint")])
            assert got == wanted, text


def test_many_parts_in_one_text():
    text = "\n".join(f"{ACCESS} {KEY} token=abcdef{i}" for i in range(20_000))
    parts = secrets.linked_parts(text)
    assert len(parts) == 60_000 and all(p[3] is not None for p in parts if p[0] == "key")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "clean text", f"é😀 {ACCESS}, {KEY}", "token = 'abcdef0123456789abcdef0123456789'", "x" * 200_000 + " password: abcdefgh"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"kind": F.lit("clash"), "start": F.lit(1)})


def test_documents(docs):
    found = secrets.find(docs.withColumn("spans", F.lit("replaced")))
    assert set(docs.columns) < set(found.columns)
    for r in secrets.digest(found).join(docs.select("doc_id", "text"), ["doc_id"]).collect():
        parts = secrets.linked_parts(r["text"])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base(r["text"] or ""))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in parts)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(p[0] == k for p in parts) for k in secrets.BASE)


def test_redaction(docs):
    texts = {r["text"]: r["hidden"] for r in secrets.find(docs).withColumn("hidden", secrets.redacted("text", "spans")).collect()}
    assert texts[None] is None and texts[""] == "" and texts["clean text"] == "clean text"
    assert texts[f"é😀 {ACCESS}, {KEY}"] == "é😀 [secret], [secret]"
    assert texts["token = 'abcdef0123456789abcdef0123456789'"] == "[secret]'"
    assert not [t for t in texts.values() if secrets.linked_parts(t)]


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.digest(secrets.find(none)).collect() == []
