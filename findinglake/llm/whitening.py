"""Embedding whitening: leading components by spectrum slicing of the covariance.

Components become whole numbers, floor(scale * c) + shift, so counts, sums and
products are exact and do not depend on how rows lie in partitions: one pass
sums the vectors, a second one the products of what is left after taking off the
whole number next to the mean; what that leaves (under one half) is taken off in
exact fractions. Only these sums, one number for each pair of dimensions, reach
the driver.

The number of positive pivots of LDL^T of V - s I is the number of eigenvalues
over s (Sylvester). Such counts cut the spectrum until an interval holds the
k-th eigenvalue alone; Rayleigh quotient iteration, which converges cubically,
starts inside it; and counts on both sides of the result certify that it is the
k-th and no other. Eigenvalues that lie closer than double precision tells apart
are one cluster: their vectors are kept at right angles to each other and the
counts certify the numbers of the whole cluster.

Cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; null ids keep their rows; repeated
rows count as often as they stand; a direction without variance (fewer distinct
vectors than components, or one row) has no component, so constant or empty
tables give no row; `deviation` is null where it exceeds a long; components of
an absolute 2^44 or more after scaling raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_LARGEST, _EXACT = 1 << 44, 1 << 53
_EPS = float(np.finfo(np.float64).eps)


def positive_count(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: LDL^T with pivots of one or two rows, the larger way out being stable."""
    a = np.array(a, np.float64)
    n, count, at = len(a), 0, 0
    bound = (1 + 17**0.5) / 8
    while at < n:
        column = np.abs(a[at + 1 :, at])
        row = at + 1 + int(column.argmax()) if len(column) else at
        most = column.max(initial=0.0)
        size = 1
        if most > 0 and abs(a[at, at]) < bound * most:
            beside = np.abs(a[row, at:]).copy()
            beside[row - at] = 0
            if abs(a[at, at]) * beside.max() >= bound * most * most:
                pass
            elif abs(a[row, row]) >= bound * beside.max():
                a[[at, row]] = a[[row, at]]
                a[:, [at, row]] = a[:, [row, at]]
            else:
                size = 2
                a[[at + 1, row]] = a[[row, at + 1]]
                a[:, [at + 1, row]] = a[:, [row, at + 1]]
        end = at + size
        pivot = a[at:end, at:end]
        if size == 1:
            count += pivot[0, 0] > 0
            if pivot[0, 0] == 0:  # its whole column is zero
                at = end
                continue
        else:
            count += int((np.linalg.eigvalsh(pivot) > 0).sum())
        left = a[end:, at:end]
        a[end:, end:] -= left @ np.linalg.solve(pivot, left.T)
        at = end
    return int(count)


def _turned(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The part of v at right angles to the others, of length one."""
    for _ in range(2):
        for other in others:
            v = v - (other @ v) * other
    return v / np.linalg.norm(v)


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to `most` largest positive eigenvalues, falling, and their unit eigenvectors as columns."""
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max(initial=0.0))
    least = 4 * d * _EPS * norm  # what double precision can tell from zero, and two eigenvalues apart
    if norm == 0:
        return np.zeros(0), np.zeros((d, 0))
    eye = np.eye(d)

    def over(s: float) -> int:
        return positive_count(v - s * eye)

    wanted = min(most, over(least))
    values, vectors = [], []
    start = np.random.default_rng(7)
    while len(values) < wanted:
        k = len(values) + 1
        low, high, at_low, at_high = least, 2 * norm, None, 0
        # Cut until (low, high] holds eigenvalue k alone, or a cluster that cannot be cut.
        while at_low != k or at_high != k - 1:
            if high - low <= least:
                break
            middle = (low + high) / 2
            n = over(middle)
            if n >= k:
                low, at_low = middle, n
            else:
                high, at_high = middle, n
            if at_low is None and middle - least <= least:
                low, at_low = least, over(least)
        size = max(1, (at_low if at_low is not None else over(low)) - (k - 1))
        together: list[float] = []
        for _ in range(min(size, wanted - k + 1)):
            value, vector = _rayleigh(v, low, high, over, k, size > 1, vectors, start)
            together.append(value)
            vectors.append(vector)
        values += together
        room = max(least, 4 * _residual(v, together, vectors[-len(together) :]))
        if over(max(together) + room) > k - 1 or over(min(together) - room) < k - 1 + len(together):
            raise ArithmeticError(f"counts do not certify component {k}")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(values), d)[order].T


def _residual(v: np.ndarray, values: list[float], vectors: list[np.ndarray]) -> float:
    return max(float(np.linalg.norm(v @ u - e * u)) for e, u in zip(values, vectors))


def _rayleigh(v, low, high, over, k, clustered, found, start) -> tuple[float, np.ndarray]:
    """One eigenpair with its value in [low, high]; a step that leaves it halves the interval and starts again there."""
    d, norm = len(v), float(np.abs(v).sum(axis=1).max())
    good = 2 * d * _EPS * norm
    while True:
        value = (low + high) / 2
        u = _turned(start.standard_normal(d), found)
        for step in range(30):
            try:
                u = np.linalg.solve(v - value * np.eye(d), u)
            except np.linalg.LinAlgError:
                value += _EPS * norm
                continue
            u = _turned(u / np.abs(u).max(), found)
            if step:  # the first solve from the middle of the interval turns the start toward it
                value = float(u @ v @ u)
            if step and np.linalg.norm(v @ u - value * u) <= good:
                break
        if low - good <= value <= high + good and np.linalg.norm(v @ u - value * u) <= 64 * good:
            # One more step than needed costs nothing and leaves the vector at double precision.
            return float(u @ v @ u), u
        if clustered or high - low <= good:
            raise ArithmeticError(f"no vector found for component {k}")
        middle = (low + high) / 2
        if over(middle) >= k:
            low = middle
        else:
            high = middle


@dataclass(frozen=True)
class Whitening:
    """What the rows are turned with: count, sums, eigenvalues, unit eigenvectors (dimension, component), trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def _numbers(column: pa.Array, dims: int, scale: int, shift: int) -> np.ndarray:
    """x of each vector as a row of whole numbers, padded to `dims`."""
    ends = column.offsets.to_numpy()
    lengths = np.diff(ends)
    flat = np.floor(column.flatten().to_numpy().astype(np.float64) * scale)
    if np.abs(flat).max(initial=0) >= _LARGEST:
        raise ValueError(f"a component times {scale} reaches 2^44")
    table = np.zeros((len(lengths), max(dims, lengths.max(initial=0))), np.int64)
    table[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return table + shift


def _exact_product(x: np.ndarray) -> np.ndarray:
    """Sums of products of columns: by doubles in pieces that stay under 2^53, else by Python's integers."""
    most = int(np.abs(x).max(initial=0)) ** 2
    if most >= _EXACT:
        return x.astype(object).T @ x.astype(object)
    rows = max(1, _EXACT // max(1, most) - 1)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for start in range(0, len(x), rows):
        part = x[start : start + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def fit(df: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vector: str = "embedding") -> Whitening:
    """Two passes over all usable vectors."""
    rows = df.where(_usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    # A vector shorter than the longest stands for zeros there, that is for `shift`.
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dims:
        return Whitening(n or 0, (), np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    number = pa.decimal128(38, 0)

    def summed(measure, schema: str) -> list:
        """Sums over all tasks of the numbers that `measure` gives for a batch; one row a task and number is shuffled."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    new = measure(_numbers(batch.column(0), dims, scale, shift))
                    total = new if total is None else total + new
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(total)), pa.int32()), pa.array([int(x) for x in total], number)], names=["at", "x"]
                )

        return rows.mapInArrow(run, schema).groupBy("at").agg(F.sum("x").alias("x")).collect()

    schema = "at int, x decimal(38,0)"
    sums = [0] * dims
    for at, x in summed(lambda table: table.sum(axis=0).astype(object), schema):
        sums[at] = int(x)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(dims)
    products = np.zeros(len(upper[0]), object)
    for at, x in summed(lambda table: _exact_product(table - centre)[upper], schema):
        products[at] = int(x)
    left = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.zeros((dims, dims))
    for i, j, p in zip(*upper, products):
        v[i, j] = v[j, i] = float(Fraction(n * p - left[i] * left[j], n * n))
    values, vectors = leading(v, most)
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(v)), scale, shift)


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """One row per usable vector: the id, `deviation` (exact, as a long) and `whitened` (array, one number a component)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[row_id].dataType
    schema = pa.schema([("row_id", to_arrow_type(kind)), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        centre = np.array([(2 * s + m.n) // (2 * m.n) for s in m.sums], np.int64)
        left = np.array([s - m.n * int(c) for s, c in zip(m.sums, centre)], object)
        turn = m.vectors / np.sqrt(m.values)
        rest = np.array([float(Fraction(int(x), m.n)) for x in left])
        square = int((left * left).sum())
        # n x - S = n (x - centre) - left; the squares of its parts add up in Python's integers.
        small = int(np.abs(left).max(initial=0))
        for batch in batches:
            x = _numbers(batch.column(1), len(m.sums), m.scale, m.shift) - centre
            largest = int(np.abs(x).max(initial=0))
            exact = x if len(m.sums) * largest * max(largest, small) < 1 << 62 else x.astype(object)
            squares = (exact * exact).sum(axis=1).tolist()
            crossed = (exact @ left.astype(exact.dtype)).tolist()
            deviation = [m.n * m.n * a - 2 * m.n * b + square for a, b in zip(squares, crossed)]
            white = ((x - rest) @ turn).ravel()
            offsets = np.arange(0, len(white) + 1, max(1, len(m.values)), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(white))],
                schema=schema,
            )

    if not len(model.values):
        return df.sparkSession.createDataFrame([], f"{row_id} {kind.simpleString()}, deviation long, whitened array<double>")
    rows = df.where(_usable(F.col(vector))).select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"row_id {kind.simpleString()}, deviation long, whitened array<double>").withColumnRenamed("row_id", row_id)


def identity_error(white: DataFrame, components: int) -> float:
    """The largest entry of |covariance - identity| of `whitened`, whose mean is taken off."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(components + len(pairs))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, components)
            n += len(w)
            product = w.T @ w
            total += np.concatenate([w.sum(axis=0), [product[i, j] for i, j in pairs]])
        if n:
            at = pa.array(range(-1, len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array(np.concatenate([[float(n)], total]))], names=["at", "x"])

    found = dict(white.select("whitened").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect())
    if not found:
        return 0.0
    n = found[-1]
    mean = [found[k] / n for k in range(components)]
    return max(abs(found[components + k] / n - mean[i] * mean[j] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(df: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: the id, `component` (from 1), `n`, `deviation`, `whitened`, `explained`
    and `identity_error`, one value for all."""
    model = fit(df, most, scale, shift, vector)
    white = stored(transform(df, model, vector, row_id), "whitened")
    error = identity_error(white, len(model.values))
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if len(model.values) else F.array().cast("array<double>")
    each = white.select(row_id, "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        row_id, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
