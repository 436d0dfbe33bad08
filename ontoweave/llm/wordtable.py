"""A table of distinct words between texts and what a tokenizer makes of their words.

1. Tasks split whole texts into pre-tokens and number the distinct ones of a block of texts. A
   document becomes the list of its words' numbers; the block's distinct words are dealt into
   buckets by their hash. Both are written once to the shared folder.
2. Buckets bring equal words of all blocks together, where each distinct word is encoded
   once. The answer, its ids or only how many there are, goes back to its blocks by number.
3. A block's documents meet its answers and take them by position.

Only distinct words of blocks move, packed; neither the texts nor the numbers of their words
do: those are written bucketed by block, so that meeting the answers shuffles the answers
alone. A word that stands in every text is one entry per block.

:class:`Layout` says how many of each there are for any size of input. Blocks hold 8 MB of text
(one text may be longer: a document is the unit), and more, up to 64 MB, where there would be
millions of them. The table has as many buckets as blocks, up to ``TABLE_BUCKETS``; beyond that a
task reads several blocks, one after the other. Buckets of words grow with the square root of the
bytes, as vocabularies grow more slowly than texts, so a block's rows of words stay large. A
bucket's words are remembered up to ``MEMO`` at a time; only a larger bucket encodes a word twice.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, releasing, small_batches
from .pretokens import splitter

BUCKET_BYTES = 16 << 20
TABLE_BUCKETS = 1 << 15
MEMO = 500_000


@dataclass(frozen=True)
class Layout:
    """Bytes of text in a block, buckets of the table of blocks, and buckets of words."""

    block_bytes: int
    table_buckets: int
    word_buckets: int

    @staticmethod
    def for_bytes(n_bytes: int, most_buckets: int = TABLE_BUCKETS) -> Layout:
        block = min(64 << 20, max(8 << 20, n_bytes // 4_000_000))
        blocks = -(-n_bytes // block)
        words = math.ceil(4 * math.sqrt(n_bytes / BUCKET_BYTES))
        return Layout(block, max(1, min(most_buckets, max(8, blocks))), max(1, min(4096, words)))


SPLIT = "block bigint, bucket int, words binary, lengths binary, numbers binary, doc_id bigint, n_bytes bigint, items binary"
SPLIT_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("numbers", pa.binary()),
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("items", pa.binary()),
    ]
)

_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of each place, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _packer.compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacker.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return _packer.compress("".join(words).encode()), pack(lengths)


def unpack_words(data: bytes, lengths: bytes) -> list[str]:
    text, ends = _unpacker.decompress(data).decode(), np.cumsum(unpack(lengths), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of every entry, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def split(docs: DataFrame, path: str, layout: Layout, items: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Rows of documents (``doc_id``, ``n_bytes``, ``items``: what ``items`` keeps of the numbers
    of the words) and rows of words (``bucket``, ``words``, their ``lengths`` and the steps from
    one of their ``numbers`` to the next), by block."""

    buckets, block_bytes = layout.word_buckets, layout.block_bytes

    def of_documents(block: int, rows: list) -> pa.RecordBatch:
        n = len(rows)
        ids, sizes, kept = zip(*rows, strict=True)
        columns = [[block] * n, *[[None] * n] * 4, ids, sizes, kept]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPLIT_ARROW)], schema=SPLIT_ARROW)

    def of_words(block: int, known: Numbers) -> Iterator[pa.RecordBatch]:
        words = np.array(list(known), object)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for numbers in np.split(order, cuts) if len(order) else []:
            steps = pack(np.diff(numbers, prepend=0))
            packed, lengths = pack_words(words[numbers].tolist())
            columns = [[block], [int(bucket[numbers[0]])], [packed], [lengths], [steps], [None], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPLIT_ARROW)], schema=SPLIT_ARROW)

    def run(batches):
        cut = splitter(path)
        block, known, size = TaskContext.get().partitionId() << 24, Numbers(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                n_bytes = len(text.encode())
                if size and size + n_bytes > block_bytes:
                    if rows:
                        yield of_documents(block, rows)
                    yield from of_words(block, known)
                    block, known, size, rows = block + 1, Numbers(), 0, []
                words = cut.split(text)
                rows.append((doc_id, n_bytes, items(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))))
                size += n_bytes
                if len(rows) >= 512:
                    yield of_documents(block, rows)
                    rows = []
            if rows:
                yield of_documents(block, rows)
        yield from of_words(block, known)

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return plain.mapInArrow(releasing(run), SPLIT)


def encoded_words(words: DataFrame, path: str, ids: bool) -> DataFrame:
    """``block``, ``numbers``, ``lengths`` and, if wanted, ``ids`` from rows of words that are sorted by
    bucket: every distinct word of a bucket is encoded once."""
    fields = [("block", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]
    schema = pa.schema(fields[: 4 if ids else 3])

    def run(batches):
        cut, memo, last = splitter(path), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != last or len(memo) > MEMO:
                    memo, last = {}, row["bucket"]
                words = unpack_words(row["words"], row["lengths"])
                new = [w for w in words if w not in memo]
                made = cut.ids(new)
                memo.update(zip(new, made if ids else map(len, made), strict=True))
                found = [memo[w] for w in words]
                lengths = np.fromiter(map(len, found) if ids else found, np.uint32, len(found))
                columns = [[row["block"]], [row["numbers"]], [pack(lengths)]]
                if ids:
                    columns.append([pack(np.fromiter((n for some in found for n in some), np.uint32, int(lengths.sum())))])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return words.mapInArrow(releasing(run), "block bigint, numbers binary, lengths binary" + ", ids binary" * ids)


class BlockTable:
    """How many ids each of a block's words has, by its number, and which, if they came along."""

    def __init__(self, answers: pa.Table):
        def all_of(column: str) -> np.ndarray:
            return np.concatenate([*map(unpack, answers.column(column).to_pylist()), np.empty(0, np.uint32)])

        steps = [np.cumsum(unpack(s), dtype=np.int64) for s in answers.column("numbers").to_pylist()]
        numbers, lengths = np.concatenate([*steps, np.empty(0, np.int64)]), all_of("lengths")
        self.lengths = np.zeros(len(numbers), np.int64)
        self.lengths[numbers] = lengths
        if "ids" in answers.column_names:
            self.ids = all_of("ids")
            self.starts = np.zeros(len(numbers), np.int64)
            self.starts[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths


def by_blocks(
    docs: DataFrame,
    path: str,
    items: Callable[[np.ndarray], bytes],
    finish: Callable[[BlockTable, pa.Table], pa.Table],
    schema: str,
    ids: bool = True,
) -> DataFrame:
    """What ``finish`` makes of each block's documents and the ids, or only numbers of ids, of its
    words."""
    spark = small_batches(docs).sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0
    allowed = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", str(TABLE_BUCKETS)))
    layout = Layout.for_bytes(n_bytes, min(allowed, TABLE_BUCKETS))
    # A table, as only a table remembers its buckets; its files lie in the shared folder.
    name = f"words_{uuid.uuid4().hex}"
    writer = split(docs, path, layout, items).write.bucketBy(layout.table_buckets, "block").option("compression", "zstd")
    writer.option("path", fresh_folder(spark, "words")).saveAsTable(name)
    rows = spark.table(name)
    words = rows.where("bucket IS NOT NULL").select("block", "bucket", "words", "lengths", "numbers")
    answers = encoded_words(words.repartition("bucket").sortWithinPartitions("bucket"), path, ids)
    documents = rows.where("bucket IS NULL").select("block", "doc_id", "n_bytes", "items")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(BlockTable(right), left)

    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
