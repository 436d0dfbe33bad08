import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoweave.llm import bpe, token_counts, wordtable
from ontoweave.llm.pretokens import Splitter, pieces

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def odd_texts(n=400):
    draw = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + list("  \n\n''strem ld漢字😀ΣςſKİ́  \u0085") + [
        "<|endoftext|>", "<|startoftext|>", "<|", "'re", "'ll ", "\r\n", "   "
    ]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(n)]
    return texts + ["", " ", "\n", "<|endoftext|>", "It's  the <|endoftext|>end", "a" * 50_000, "wörd " * 20_000, "12345 ½ 3²"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pretokens_give_the_library_ids(path):
    cut, made = Splitter(path), library(path)
    assert cut.kind is not None
    for text in odd_texts(4000):
        words = cut.split(text)
        assert [i for ids in cut.ids(words) for i in ids] == made.encode(text, add_special_tokens=False).ids, text


def test_other_files_go_through_the_library(tmp_path):
    made = library(BYTE)
    made.normalizer = __import__("tokenizers").normalizers.NFKC()
    made.save(str(tmp_path / "own.json"))
    cut = Splitter(str(tmp_path / "own.json"))
    assert cut.kind is None
    for text in odd_texts(100):
        assert [i for ids in cut.ids(cut.split(text)) for i in ids] == made.encode(text, add_special_tokens=False).ids


def test_packing():
    import numpy as np

    for values in ([], [0], [1, 2**32 - 1, 5], list(range(1000))):
        assert wordtable.unpack(wordtable.pack(np.array(values, np.uint32))).tolist() == values
    got = wordtable.ragged(np.arange(10), np.array([3, 0, 8]), np.array([2, 0, 1]))
    assert got.tolist() == [3, 4, 8]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (3, "again"), (3, "again"), (900, None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    return made.withColumns({"ids": F.lit("clash"), "words": F.lit(1), "block": F.lit(2)})


def test_counts(docs):
    made = library(WORD)
    got = token_counts.count_tokens(docs, WORD, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = []
    for r in docs.collect():
        n = len(made.encode(r["text"] or "", add_special_tokens=False).ids)
        wanted.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 100))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_round_trip(docs):
    made = library(BYTE)
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    at_once = bpe.encode(docs, BYTE, decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, got))
    wanted = []
    for r in docs.collect():
        ids = made.encode(r["text"] or "", add_special_tokens=False).ids
        wanted.append((r["doc_id"], len(ids), struct.pack(f"<{len(ids)}I", *ids), made.decode(ids, skip_special_tokens=False)))
    assert sorted(((*r[:2], bytes(r[2]), r[3]) for r in got), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("n_bytes", [0, 1, 10**6, 10**9, 10**12, 10**14, 3 * 10**14, 10**16])
def test_the_layout_is_bounded_at_any_size(n_bytes):
    made = wordtable.Layout.for_bytes(n_bytes)
    assert 8 << 20 <= made.block_bytes <= 64 << 20
    assert 1 <= made.table_buckets <= 32_768 < 100_000 and 1 <= made.word_buckets <= 4096
    assert wordtable.Layout.for_bytes(n_bytes, 100).table_buckets <= 100
    blocks = -(-n_bytes // made.block_bytes)
    assert blocks <= max(4_000_000, n_bytes // (64 << 20) + 1)


def test_many_blocks_share_a_bucket(spark, docs, monkeypatch):
    monkeypatch.setattr(wordtable.Layout, "for_bytes", staticmethod(lambda n, most: wordtable.Layout(2000, 2, 3)))
    test_round_trip(docs)
    test_counts(docs)


def test_more_words_than_are_remembered(docs, monkeypatch):
    monkeypatch.setattr(wordtable, "MEMO", 5)
    test_counts(docs)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(none, WORD).collect() == []
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).collect() == []


def test_ids_that_split_a_character(spark):
    table = pieces(BYTE)
    ids = [i for i, p in enumerate(table) if p == b"\xe6"] + [i for i, p in enumerate(table) if p == b"a"]
    row = [(1, 2, bytearray(struct.pack("<2I", *ids)))]
    got = bpe.decode(spark.createDataFrame(row, "doc_id bigint, n_tokens bigint, ids binary"), BYTE).first()
    assert got["decoded"] == library(BYTE).decode(ids, skip_special_tokens=False) == "�a"
