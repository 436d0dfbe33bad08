"""The registered queries that SQL cannot express, and the pipeline, by brute force."""

import hashlib
import os
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from test_neardup_text import brute
from test_secrets import base
from test_sharding_mixing import placed
from test_tokens import library

import __spark_entry__ as entry
import corpus_pipeline
from ontoweave.llm import secrets

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
NAMES = "op1_warc op2_mixing op3_sharding op4_token_counts op5_nearest op6_secrets op7_minhash_neardup op8_embedding_neardup op9_toxicity op10_bpe op11_hard_negatives op12_quality op13_spelling pipeline"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())


def run(spark, name):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, SF_DIR).collect()}


def test_all_are_registered():
    assert set(NAMES.split()) <= set(entry.queries())
    assert {"op1_warc", "op2_mixing", "op5_nearest", "op7_minhash_neardup", "op8_embedding_neardup"} <= set(entry.oracle_sql())
    assert {"op11_hard_negatives", "op12_quality", "op13_spelling"} <= set(entry.oracle_sql())


def test_sharding(spark, texts):
    got = run(spark, "op3_sharding")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r["shard"], r["size"], r["text_crc32"]) == (placed(i, 24), len(texts[i].encode()) + 8, zlib.crc32(texts[i].encode()))
        assert r["grown_shard"] == placed(i, 25)


def test_token_counts(spark, texts):
    made, got = library(public_tokenizers.path("word_bpe_49k.json")), run(spark, "op4_token_counts")
    for i, text in texts.items():
        n = len(made.encode(text, add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len(text.encode()), n, n > 2048)


def test_secrets(spark, texts):
    got = run(spark, "op6_secrets")
    for i, text in texts.items():
        found = base(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert got[i]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in secrets.linked_parts(text))


def test_bpe(spark, texts):
    made, got = library(public_tokenizers.path("byte_bpe_50k.json")), run(spark, "op10_bpe")
    for i, text in texts.items():
        ids = made.encode(text, add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = made.decode(ids, skip_special_tokens=False).encode()
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())


def test_pipeline_stage_by_stage(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF_DIR)
        assert name == "bpe" or made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "minhash_neardup":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in brute(rows) if r[3])
        if name == "secrets":
            for r in docs.collect():
                assert not base(r["text"]) and r["n_chars"] == len(r["text"])
                if not base(texts[r["doc_id"]]):
                    assert r["text"] == texts[r["doc_id"]]
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "mixing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= kept.keys()
            copies = docs.count()
        if name == "bpe":
            assert docs.count() == copies
            for r in docs.collect():
                assert r["text"] == kept[r["doc_id"]] and len(r["ids"]) == 4 * r["n_tokens"]


def test_stages_with_odd_rows(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d e f g", "en", None, 13), (2, "a b c d e f g", "en", None, 13), (3, "A b c d e f g", None, "s", 13)]
    for made in (rows, []):
        docs = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert name == "bpe" or out.columns == docs.columns
            count = out.count()
            assert (name == "minhash_neardup" and made and count == 3) or name == "mixing" or count == len(made)
