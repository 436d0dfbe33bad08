"""BPE encoding and decoding through a table of distinct words.

Encoding: texts are split into words inside Spark tasks, each distinct word is encoded once,
and its ids are joined back by position (see ``wordtable``). Decoding joins ids to pieces:
the piece table has one row per id of the vocabulary, so it is joined on the side of the
ids, inside the task, and a text is the pieces of its ids in order.

A null or empty text has no ids and decodes to an empty text. Repeated rows are answered one
by one, a null doc_id is kept, other columns are not read, and an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import pieces
from .wordtable import BlockTable, by_blocks, pack, ragged, unpack


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) per document,
    for the tokenizer file at ``path`` without added special tokens, truncation or padding.

    ``decoded`` adds what :func:`decode` makes of the ids, while they are at hand.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema([*fields, ("decoded", pa.string())] if decoded else fields)

    def finish(table: BlockTable, documents: pa.Table) -> pa.Table:
        made = []
        # Small batches, as each passes to Spark as a whole.
        for batch in documents.select(["doc_id", "items"]).to_batches(max_chunksize=64):
            values, texts = [], []
            for item in batch.column("items"):
                numbers = unpack(item.as_py())
                ids = ragged(table.ids, table.starts[numbers], table.lengths[numbers]).astype("<u4")
                values.append(ids.tobytes())
                if decoded:
                    texts.append(text_of(ids, path))
            columns = [batch.column("doc_id"), pa.array([len(v) // 4 for v in values], pa.int64()), pa.array(values, pa.binary())]
            columns += [pa.array(texts, pa.string())] if decoded else []
            made.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        return pa.Table.from_batches(made, schema)

    spec = "doc_id bigint, n_tokens bigint, ids binary" + (", decoded string" if decoded else "")
    return by_blocks(docs, path, pack, finish, spec)


@cache
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, and the start and length of each id's piece."""
    found = pieces(path)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths, lengths


def text_of(ids: np.ndarray, path: str) -> str:
    """The pieces of the ids, joined; bytes that are no UTF-8 become U+FFFD."""
    flat, starts, lengths = piece_table(path)
    return ragged(flat, starts[ids], lengths[ids]).tobytes().decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the ``decoded`` text, special tokens included; bytes
    that are no UTF-8 become U+FFFD."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [text_of(np.frombuffer(value.as_py() or b"", "<u4"), path) for value in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    kept = encoded.select("doc_id", "n_tokens", "ids")
    return kept.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
