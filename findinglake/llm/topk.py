"""Exact top-k search by inner product, by columnar branch-and-bound.

Vectors are packed into blocks, vertically: a block holds its dimensions one
after the other. Every query block meets every block of candidates. Within a
pair of blocks, scores are accumulated some dimensions at a time; what the
remaining dimensions can still add is at most the product of the remaining
lengths (Cauchy-Schwarz). A candidate whose bound lies under the k-th best
score that is already certain for every query is dropped, and the rest are
compacted. The best k of each pair of blocks are merged by query.

Components are turned into floor(scale * x) first and all sums are exact: in
doubles while no sum can reach 2^53, in 64-bit integers beyond.

Cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; shorter vectors count as padded with zeros; ties
go to the smaller id; rows that share the query's id are its own; other
repeated rows each stand for themselves; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a block of candidates and of queries; dimensions accumulated at a time.
CANDIDATES, QUERIES, DIMENSIONS = 4096, 128, 16
_EXACT = 1 << 53


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of a partition's rows: `n`, `dims`, `ids` and `columns` (int64, dimension after dimension)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[int]] = []

        def block() -> pa.RecordBatch:
            dims = max(map(len, vectors))
            table = np.zeros((len(vectors), dims), np.int64)
            for k, vector in enumerate(vectors):
                table[k, : len(vector)] = vector
            return pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([np.ascontiguousarray(table.T).tobytes()], pa.binary())],
                names=["n", "dims", "ids", "columns"],
            )

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                vectors.append(vector)
                if len(ids) == size:
                    yield block()
                    ids.clear()
                    vectors.clear()
        if ids:
            yield block()

    return rows.mapInArrow(pack, "n int, dims int, ids binary, columns binary")


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int, step: int = DIMENSIONS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point id, score) of each query's k best points. `queries` and `points` are (dimension, row)."""
    dims = max(len(queries), len(points))
    queries, points = (np.pad(m, ((0, dims - len(m)), (0, 0))) for m in (queries, points))
    most = max(1, dims) * int(np.abs(queries).max(initial=0)) * int(np.abs(points).max(initial=0))
    kind = np.float64 if most < _EXACT else np.int64
    q, p = queries.astype(kind), points.astype(kind)

    def left(m: np.ndarray) -> np.ndarray:
        """Length of what lies beyond each boundary, a little too long rather than too short."""
        squares = np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        return np.sqrt(np.vstack([squares, np.zeros((1, m.shape[1]))])) * (1 + 1e-9)

    q_left, p_left = left(queries), left(points)
    own = query_ids[:, None] == point_ids[None, :]
    alive = np.arange(points.shape[1])
    scores = np.zeros((queries.shape[1], points.shape[1]), kind)
    for start in range(0, dims, step):
        end = min(start + step, dims)
        scores += q[start:end].T @ p[start:end]
        if end == dims or len(alive) <= k:
            continue
        rest = q_left[end][:, None] * p_left[end][None, :]
        slack = 1e-9 * (np.abs(scores) + 1)
        certain = np.where(own, -np.inf, scores - rest - slack)
        least = np.partition(certain, len(alive) - k, axis=1)[:, len(alive) - k]
        stays = (~own & (scores + rest + slack >= least[:, None])).any(axis=0)
        if stays.sum() < 0.8 * len(alive):
            alive, scores, p, p_left, own = alive[stays], scores[:, stays], p[:, stays], p_left[:, stays], own[:, stays]
    rows, ids, values = [], [], []
    kept_ids = point_ids[alive]
    for row in range(len(query_ids)):
        other = np.flatnonzero(~own[row])
        if len(other) > k:
            least = np.partition(scores[row, other], len(other) - k)[len(other) - k]
            other = other[scores[row, other] >= least]
        order = other[np.lexsort((kept_ids[other], -scores[row, other]))][:k]
        rows.append(np.full(len(order), row))
        ids.append(kept_ids[order])
        values.append(scores[row, order].astype(np.int64))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def search(
    df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vector: str = "embedding", row_id: str = "vec_id"
) -> DataFrame:
    """`query_id`, `rank` (from 1), `row_id` and `score` of the k best rows for every row that `is_query` accepts."""
    numbers = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = df.where(F.col(row_id).isNotNull() & _usable(F.col(vector)))
    rows = usable.select(F.col(row_id).cast("long").alias("id"), numbers.alias("numbers"))
    asking = usable.where(is_query).select(F.col(row_id).cast("long").alias("id"), numbers.alias("numbers")).distinct()
    blocks = stored(_packed(rows, CANDIDATES), "candidates")
    query_blocks = stored(_packed(asking.coalesce(8), QUERIES), "queries")
    # Every query block goes to every group of candidate blocks: the stated queries against all rows, block by block.
    n_groups = max(1, df.sparkSession.sparkContext.defaultParallelism) * 4
    spread = blocks.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(n_groups)))
    asked = query_blocks.select(
        F.col("n").alias("q_n"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("group"),
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                query_ids = np.frombuffer(r.q_ids, np.int64)
                found = best_of_block(
                    np.frombuffer(r.q_columns, np.int64).reshape(r.q_dims, r.q_n), query_ids,
                    np.frombuffer(r.columns, np.int64).reshape(r.dims, r.n), np.frombuffer(r.ids, np.int64), k,
                )
                yield pd.DataFrame({"query_id": query_ids[found[0]], "id": found[1], "score": found[2]})

    met = spread.join(asked, "group").select("n", "dims", "ids", "columns", "q_n", "q_dims", "q_ids", "q_columns")
    best = met.mapInPandas(meet, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(row_id), "score"
    )
