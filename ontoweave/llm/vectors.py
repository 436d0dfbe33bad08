"""Vectors that take part in comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is not null, not zero and holds finite numbers only, of any length."""
    value = F.col(column)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(value.isNotNull() & (F.size(value) > 0)).where(finite & F.exists(value, lambda x: x != 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of double precision."""
    column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))
