"""Helpers inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows with equal keys (integers), one table at a time, from batches sorted by them.

    Holds one group and one batch; nothing else of the partition stays in memory.
    """
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        values = [part.column(k).to_numpy() for k in keys]
        changes = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        for start, stop in zip([0, *changes], [*changes, part.num_rows], strict=True):
            key = tuple(v[start] for v in values)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(start, stop - start))
            last = key
    if held:
        yield pa.concat_tables(held)


def fixed_rows(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column whose values all hold ``width`` items, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


class Forest:
    """Joins places and keeps the links that joined something new."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, xs: np.ndarray, ys: np.ndarray) -> None:
        differ = self.parent[xs] != self.parent[ys]
        for x, y in zip(xs[differ].tolist(), ys[differ].tolist(), strict=True):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.edges.append((x, y))
