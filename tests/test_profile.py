import pytest
from conftest import rows
from pyspark.sql import functions as F

from ontoweave.functions.text import redact
from ontoweave.operators import profile as P


@pytest.fixture
def people(frame):
    return frame(
        [("a", 12, "EU", "a@example.com"), ("b", 23, "US", None)],
        "id string, amount int, region string, email string",
    )


def test_counts_keys_and_sensitivity(people):
    found = P.facts_by_name(P.profile_columns(people))
    assert found["id"]["primary_key"] and found["id"]["type"] == "VARCHAR"
    assert (found["email"]["nulls"], found["email"]["distinct"]) == (1, 1)
    assert found["email"]["sensitive"] and not found["email"]["primary_key"]
    assert not found["region"]["sensitive"]


def test_empty_table_has_a_profile_and_no_key(people):
    empty = people.where("false")
    whole = P.profile(empty)
    assert (whole["rows"], whole["duplicate_rows"]) == (0, 0)
    assert [c["name"] for c in whole["columns"]] == people.columns
    assert not any(c["primary_key"] for c in whole["columns"])


def test_distinct_counts_follow_sql(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (0.0D, array(1), 'x'), (-0.0D, array(1), 'x '), (double('NaN'), array(2), null), "
        "(double('NaN'), null, '') AS t(n, a, s)"
    )
    counts = {r["name"]: r["distinct"] for r in P.profile_columns(df).collect()}
    direct = df.agg(*[F.count_distinct(c).alias(c) for c in ("n", "a", "s")]).first().asDict()
    assert counts == direct == {"n": 2, "a": 2, "s": 3}


def test_long_texts_count_exactly(spark):
    df = spark.range(3000).select(F.concat(F.repeat(F.lit("x"), 500), F.col("id")).alias("t"))
    found = P.facts_by_name(P.profile_columns(df))
    assert found["t"]["distinct"] == 3000 and found["t"]["primary_key"]


def test_duplicates_treat_nulls_as_equal_and_tell_columns_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (null, 'a'), (null, 'a'), ('a', null), ('b', 'c') AS t(x, y)")
    assert P.duplicate_rows(df).first().asDict() == {"rows": 4, "duplicate_rows": 1}
    assert P.profile(df)["duplicate_rows"] == 1


def test_fingerprint_ignores_order_and_sees_content(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("m"))
    same = df.orderBy(F.rand()).repartition(5)
    mark = lambda d: P.fingerprint(d).first()["fingerprint"]
    assert mark(df) == mark(same) == P.profile(df)["fingerprint"]
    assert mark(df) != mark(df.where("id <> 3"))
    # A pair of equal rows cancels under XOR alone.
    assert mark(df) != mark(df.unionByName(df.limit(1)).unionByName(df.limit(1)))
    assert mark(df) != mark(df.withColumnRenamed("m", "n"))


def test_maps_are_profiled(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2)")
    assert P.profile_columns(df).first()["distinct"] == 2
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_pages_and_samples_are_repeatable(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), "id").repartition(7)
    got = [r["id"] for r in P.page(df, ["g"], 10, 5).collect()]
    assert got == [r["id"] for r in P.page(df.repartition(2), ["g"], 10, 5).collect()]
    assert [r["id"] for r in P.sample_rows(df, 2).collect()] == [0, 3]


def test_masking(spark):
    df = spark.sql(
        "SELECT 'a@b.c' AS Email, repeat('x', 50) AS note, array(repeat('y', 41), 'z') AS list, "
        "named_struct('t', repeat('w', 60), 'n', 1) AS s"
    )
    whole = P.mask_sample(df).first()
    assert (whole["note"], whole["list"][0]) == ("x" * 50, "y" * 41)
    row = P.mask_sample(df, longest=40).first()
    assert row["Email"] == "[masked]" and row["note"] == "x" * 40 + "…"
    assert row["list"] == ["y" * 40 + "…", "z"] and row["s"]["t"] == "w" * 40 + "…"
    assert P.mask_sample(df, hide=False).first()["Email"] == "a@b.c"


def test_schema_card(frame):
    df = frame(
        [("i1", "paid", 5), ("i2", "void", None), ("i3", "None", 7), ("i4", "paid", 5)],
        "invoice_id string, status string, amount bigint",
    )
    cards = [r["card"] for r in P.schema_card(df, P.profile_columns(df)).orderBy("position").collect()]
    assert cards == [
        "invoice_id VARCHAR unique",
        "status VARCHAR values: paid|void",
        "amount BIGINT 1 null",
    ]


def test_roles(frame):
    df = frame([("a", "x", 1.0)], "id string, kind string, n double")
    facts = P.facts_by_name(P.profile_columns(df))
    facts["kind"]["primary_key"] = False
    assert P.column_roles(df, facts) == {"id": {"key"}, "kind": {"category"}, "n": {"number", "key"}}


def test_redaction(spark):
    text = "see postgres://u:p@h/db and API_KEY = abc, then Token: xyz; ok " + "z" * 2000
    got = spark.range(1).select(redact(F.lit(text)).alias("t")).first()["t"]
    assert got.startswith("see postgres://[redacted] and API_KEY=[redacted], then Token=[redacted]; ok")
    assert got.endswith("z" * 2000), "the whole text"


def test_rows_helper(people):
    assert rows(people, "id") == [("a",), ("b",)]
