"""Embedding whitening: mean and covariance in two passes, projection onto the leading components.

An entry ``c`` becomes the integer ``floor(SCALE * c) + OFFSET``. The first pass sums these integers, exactly: each
entry is split into two halves whose sums fit a long, and the sums of partitions are added up as Python's integers. The
second pass sums outer products of the centred vectors by NumPy's matrix product, batch by batch; an entry is
centred by the integer part of the mean (exact) and then by what is left of it (less than 1), so large means cost no
digits. Both passes give one row a partition, merged by ``treeAggregate``: nothing larger than one matrix of
``dimensions ** 2`` doubles reaches the driver, whatever the number of rows. LAPACK's symmetric ``eigh`` gives
the components there, and a matrix of dimensions x components is broadcast for the projection. A third pass sums the
covariance of what was projected, batches merged by their means and centred products, to measure how far it is
from the identity.

Dropped: null vectors, vectors with a null or non-finite entry. Vectors of another length than the commonest one
(of ties the longer) can't be of the same space and are dropped too; so are vectors without entries. Null ids
pass through; repeated rows count as often as they stand there; an empty table gives an empty result; other columns
are ignored. Integers saturate at +-2^53, and ``deviation`` at the largest long. A component without
variance (up to rounding) has null in ``whitened`` and no part in ``identity_error``; without any variance, or any
component that has some, ``explained`` and ``identity_error`` are null. Fewer dimensions than components: as many
components as dimensions. More than ``MOST_DIMENSIONS`` raise an error, which bounds what the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
MOST_DIMENSIONS = 4096
LARGEST = 1 << 53
#: Rows that are multiplied at a time.
BLOCK = 4096
MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """What a table of vectors is whitened by."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling, of the leading components
    components: np.ndarray  # dimensions x components
    trace: float
    rank: int  # components with variance

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Integer part of the mean, and what is left of it."""
        return centre(self.n, self.sums)


def centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole)])


def integers(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """List arrays of one length -> rows of integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(SCALE * flat) + OFFSET, -LARGEST, LARGEST)
    return x.astype(np.int64).reshape(-1, dimensions)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[np.ndarray]:
    for b in batches:
        x = integers(b.column(b.num_columns - 1), dimensions)
        for at in range(0, len(x), BLOCK):
            yield x[at : at + BLOCK]


def _sum(dimensions: int):
    """Vectors -> one row (n, high, low): sums of the entries' upper parts and lower 26 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for x in _blocks(batches, dimensions):
            n += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([high], kind), pa.array([low], kind)], names=["n", "high", "low"])

    return run


def _outer(dimensions: int, whole: np.ndarray, rest: np.ndarray):
    """Vectors -> one row: the sum of the centred vectors' outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for x in _blocks(batches, dimensions):
            d = (x - whole).astype(np.float64) - rest
            total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["products"])

    return run


def _merge_moments(a: tuple, b: tuple) -> tuple:
    """(n, mean, centred products) of two sets of rows together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _moments(project: Callable[[np.ndarray], np.ndarray], dimensions: int, components: int):
    """Vectors -> one row (n, mean, products): the moments of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(components), np.zeros((components, components)))
        for x in _blocks(batches, dimensions):
            w = project(x)
            mean = w.mean(axis=0)
            total = _merge_moments(total, (len(w), mean, (w - mean).T @ (w - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), *(pa.array([t.tobytes()], pa.binary()) for t in total[1:])], names=["n", "mean", "products"])

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(_id, _v) of the vectors that count, and their length."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col(id_col).alias("_id"), v.alias("_v")).filter(F.col("_v").isNotNull() & finite & (F.size("_v") > 0))
    commonest = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimensions = commonest["d"] if commonest else 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} dimensions; {MOST_DIMENSIONS} at most")
    return rows.filter(F.size("_v") == dimensions), dimensions


def fit(rows: DataFrame, dimensions: int, components: int = COMPONENTS) -> Fit | None:
    """Mean and leading components of (_id, _v); None of no rows."""
    if not dimensions:
        return None
    vectors = rows.select("_v")
    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])])
    parts = vectors.mapInArrow(_sum(dimensions), "n bigint, high array<bigint>, low array<bigint>").rdd
    n, sums = parts.treeAggregate((0, [0] * dimensions), lambda a, r: add(a, (r.n, [(h << 26) + w for h, w in zip(r.high, r.low)])), add)
    whole, rest = centre(n, sums)
    shape = (dimensions, dimensions)
    parts = vectors.mapInArrow(_outer(dimensions, whole, rest), "products binary").rdd
    products = parts.treeAggregate(np.zeros(shape), lambda a, r: a + np.frombuffer(r.products).reshape(shape), lambda a, b: a + b)
    covariance = products / n
    values, own = np.linalg.eigh(covariance)
    k = min(components, dimensions)
    values, own = values[::-1][:k], np.ascontiguousarray(own[:, ::-1][:, :k])
    least = dimensions * np.finfo(np.float64).eps * max(float(values[0]), 0.0)
    return Fit(n, tuple(sums), values, own, float(np.trace(covariance)), int((values > least).sum()))


def projection(found: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of integers -> their whitened values, one for each component with variance."""
    whole, rest = found.mean
    turn = found.components[:, : found.rank] / np.sqrt(found.values[: found.rank])
    return lambda x: ((x - whole).astype(np.float64) - rest) @ turn


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The sum over dimensions of (n * x - sum)^2 of each row, exact up to the largest long, where it saturates."""
    whole = np.array([s // n for s in sums], np.int64)
    left = [s - n * (s // n) for s in sums]
    y = x - whole
    easy = len(sums) * (float(n) * (np.abs(y).max(axis=1).astype(np.float64) + 1)) ** 2 < 2.0**62
    out = np.zeros(len(x), np.int64)
    q = n * y[easy] - np.array(left, np.int64)
    out[easy] = (q * q).sum(axis=1)
    for i in np.flatnonzero(~easy):
        out[i] = min(MAX_LONG, sum((n * a - r) ** 2 for a, r in zip(y[i].tolist(), left)))
    return out


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that counts and each component: id, component, n, deviation, whitened, explained, identity_error."""
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kept, dimensions = usable(rows, id_col, vector_col)
    found = fit(kept, dimensions, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(found)
    error = None
    k = found.rank
    if k:
        parts = kept.select("_v").mapInArrow(_moments(projection(found), dimensions, k), "n bigint, mean binary, products binary").rdd
        own = lambda r: (r.n, np.frombuffer(r.mean), np.frombuffer(r.products).reshape(k, k))
        n, _, products = parts.treeAggregate((0, np.zeros(k), np.zeros((k, k))), lambda a, r: _merge_moments(a, own(r)), _merge_moments)
        error = float(np.abs(products / n - np.eye(k)).max())
    explained = [float(v) / found.trace if found.trace > 0 else None for v in found.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = shared.value
        project, m = projection(f), len(f.values)
        names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for b in batches:
            x = integers(b.column(1), dimensions)
            w = np.full((len(x), m), np.nan)
            w[:, : f.rank] = project(x)
            void = np.tile(np.arange(m) >= f.rank, len(x))
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(len(x)), m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * m, f.n, np.int64)),
                pa.array(np.repeat(deviations(x, f.n, f.sums), m)),
                pa.array(w.ravel(), mask=void),
                pa.array(explained * len(x), pa.float64()),
                pa.array([error] * (len(x) * m), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)
