"""Nearest vectors of many queries by a block matrix join.

Queries and candidates are dealt into blocks, and every two blocks meet in one tile. There
both are quantised to 8-bit integers; the product of the integer matrices gives each inner
product up to a bound that follows from what quantisation left over:
``|q.x - q'.x'| <= |q| * |x - x'| + |q - q'| * |x'|``. A pair survives where its upper bound
reaches the k-th best lower bound of its query, so no true neighbour is dropped. Survivors
are recomputed in double precision from the original vectors and merged into the query's k
best, block by block within the tile and then across tiles.

Blocks are bounded, so a tile holds bounded memory. The result is exact. Ties go to the
smaller vec_id. Vectors null, zero, or with null or non-finite components take no part; those of
different lengths have no inner product and never meet. A row that repeats a vec_id is a query and a candidate of its own; only the
query's own row is left out. Rows without vec_id are candidates only, and rank last among
equals. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, usable

STEP = 2048
BLOCK_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integer codes (-127 to 127, as floats whose products stay exact), their scales, and the
    lengths of the quantised rows and of what quantisation left over."""
    scale = np.abs(rows).max(1) / 127.0
    codes = np.rint(rows / scale[:, None])
    back = codes * scale[:, None]
    exact = np.float32 if 127 * 127 * rows.shape[1] < 1 << 24 else np.float64
    return codes.astype(exact), scale, np.linalg.norm(back, axis=1), np.linalg.norm(rows - back, axis=1)


def best(rows: np.ndarray, others: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query (``rows``), highest score, then smaller id."""
    order = np.lexsort((others, ids, -scores, rows))
    starts = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - starts < k]


def tile(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, number: np.ndarray, ids: np.ndarray, k: int):
    """The k best candidates of each query in one tile: query place, candidate place, score.

    ``own`` and ``number`` are row numbers of queries and candidates."""
    q_codes, q_scale, _, q_rest = quantised(queries)
    q_norm = np.linalg.norm(queries, axis=1)
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    floor = np.full(len(queries), -np.inf)
    for at in range(0, len(vectors), STEP):
        part = vectors[at : at + STEP]
        codes, scale, norm, rest = quantised(part)
        product = (q_codes @ codes.T).astype(np.float64) * (q_scale[:, None] * scale[None, :])
        bound = q_norm[:, None] * rest[None, :] + q_rest[:, None] * norm[None, :]
        bound += 1e-9 * q_norm[:, None] * (norm + rest)[None, :]
        itself = own[:, None] == number[None, at : at + STEP]
        lower = np.where(itself, -np.inf, product - bound)
        if len(part) >= k:
            floor = np.maximum(floor, np.partition(lower, len(part) - k, axis=1)[:, len(part) - k])
        a, b = np.nonzero((product + bound >= floor[:, None]) & ~itself)
        exact = np.concatenate([(queries[a[i : i + 65536]] * part[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)] or [[]])
        joined = tuple(np.concatenate([x, y]) for x, y in zip(held, (a, b + at, exact), strict=True))
        kept = best(joined[0], joined[1], joined[2], ids[joined[1]], k)
        held = tuple(x[kept] for x in joined)
        # A query that holds k exact scores needs nothing below the last of them.
        full = np.bincount(held[0], minlength=len(queries)) >= k
        worst = np.full(len(queries), np.inf)
        np.minimum.at(worst, held[0], held[2])
        floor = np.where(full, np.maximum(floor, worst), floor)
    return held


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k nearest by
    inner product."""
    plain = usable(vectors.select(F.col("vec_id").cast("bigint"), "embedding", is_query.alias("__query")))
    plain = plain.withColumns({"row": F.monotonically_increasing_id(), "length": F.size("embedding")})
    rows = written(plain, "vectors")
    n, n_queries, longest = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce("__query", F.lit(False))), F.max("length")).first()
    fit = max(64, BLOCK_BYTES // (8 * (longest or 1)))
    wide, high = min(fit, 16384, max(512, n // 16)), min(fit, 4096, max(512, n_queries // 16))
    across, down = max(1, -(-n // wide)), max(1, -(-n_queries // high))
    spread = lambda parts, of: F.pmod(F.xxhash64("row", F.lit(of)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    values = ["row", "vec_id", "embedding"]
    own = [F.col("length").alias("own_length"), *(F.col(c).alias(c) for c in values)]
    queries = rows.where("__query").select(*own, spread(down, "q").alias("i"), every(across).alias("j"))
    candidates = rows.select("length", *values, spread(across, "c").alias("j"), every(down).alias("i"))
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        own, number = left.column("row").to_numpy(), right.column("row").to_numpy()
        ids = right.column("vec_id").combine_chunks()
        a, b, scores = tile(
            matrix(left.column("embedding")), own, matrix(right.column("embedding")), number,
            ids.fill_null(LAST).to_numpy(), k,
        )
        named = [pa.array(own[a]), left.column("vec_id").take(pa.array(a)).combine_chunks(), ids.take(pa.array(b)), pa.array(scores)]
        return pa.Table.from_arrays(named, schema=schema)

    met = queries.groupBy("own_length", "i", "j").cogroup(candidates.groupBy("length", "i", "j"))
    found = met.applyInArrow(meet, "row bigint, query_id bigint, vec_id bigint, score double")
    # Spark keeps k rows per query on both sides of this shuffle.
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
