"""Token counts of whole documents without materialising their ids.

Pieces are counted once per distinct pre-token; a document keeps the frequencies of its
pre-tokens, meets the counts of its block's pre-tokens and sums the products. See
``wordtable`` for how words and documents meet.

A null or empty text has no bytes and no tokens. Repeated rows are answered one by one, a
null doc_id is kept, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordtable import BlockTable, by_blocks, pack, unpack


def frequencies(numbers: np.ndarray) -> bytes:
    """The distinct numbers, as steps from one to the next, and how often each occurs."""
    distinct, counts = np.unique(numbers, return_counts=True)
    steps = np.diff(distinct.astype(np.int64), prepend=0)
    return pack(np.concatenate([steps, counts]))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` per document, for the tokenizer
    file at ``path`` without added special tokens, truncation or padding."""

    def finish(table: BlockTable, documents: pa.Table) -> pa.Table:
        totals = []
        for item in documents.column("items"):
            steps, counts = np.split(unpack(item.as_py()).astype(np.int64), 2)
            totals.append(int((table.lengths[np.cumsum(steps)] * counts).sum()))
        kept = documents.select(["doc_id", "n_bytes"])
        return kept.append_column("n_tokens", pa.array(totals, pa.int64()))

    counted = by_blocks(docs, path, frequencies, finish, "doc_id bigint, n_bytes bigint, n_tokens bigint", ids=False)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
