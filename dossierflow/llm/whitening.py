"""Embedding whitening (operator 11): two passes for the covariance, principal components, projection to unit variance.

Entries become integers x = floor(SCALE * c) + SHIFT. The first pass adds them up exactly (long in a task, Python integers
beyond), which gives the mean; the second centres each batch and sums its outer products by one matrix product; partial
sums of all tasks merge in a tree, so the driver adds a few matrices however many tasks there are. LAPACK's symmetric
solver gives the components; the sign of each is set so that its entry of greatest size is positive. A third pass takes
the covariance of what the projection gives and measures how far it is from the identity. The projection (dimensions x
components) is broadcast: its size does not depend on the rows.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped. The dimension is the length
that most of the others have (of two equally common the greater); vectors of another length are dropped. Entries beyond
+-LARGEST count as +-LARGEST. Repeated rows and repeated or null ids are rows of their own. A component without variance
(one row, equal rows, fewer rows than dimensions) has null for `whitened` and is left out of `identity_error`, which is
null if there is no other; `explained` is null if all variance is zero. A deviation that no long holds is null. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.session import read_table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries of greater size count as this; a task's sums over 2**26 rows then fit in a long.
LARGEST = 2.0**26
#: Vectors worked on at a time.
ROWS = 4096
#: Levels of the tree in which partial sums merge.
DEPTH = 3


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray  #: dimensions x components
    variances: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def clean(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """(key, embedding) of the vectors that take part, and their dimension (0 if there is none)."""
    whole = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = whole.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    common = whole.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    return whole.where(F.size("embedding") == size), size


def _integers(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for start in range(0, batch.num_rows, ROWS):
        flat = batch.column(1).slice(start, ROWS).flatten().to_numpy(zero_copy_only=False)
        yield np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64).reshape(-1, size) + SHIFT


def _summed(vectors: DataFrame, size: int, start: Callable[[], list[np.ndarray]], add: Callable[[list[np.ndarray], np.ndarray], None]) -> list[np.ndarray] | None:
    """Partial sums by task, each a row, merged in a tree. Sums of integers go on as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = start()
        for batch in batches:
            for x in _integers(batch, size):
                add(parts, x)
        yield pa.RecordBatch.from_pydict({f"p{k}": pa.array([p.tobytes()], pa.binary()) for k, p in enumerate(parts)})

    shapes = [(p.dtype, p.shape) for p in start()]
    partial = vectors.mapInArrow(run, ", ".join(f"p{k} binary" for k in range(len(shapes))))

    def read(row) -> list[np.ndarray]:
        found = [np.frombuffer(b, kind).reshape(shape) for b, (kind, shape) in zip(row, shapes, strict=True)]
        return [f.astype(object) if f.dtype == np.int64 else f for f in found]

    merge = lambda a, b: b if a is None else a if b is None else [x + y for x, y in zip(a, b, strict=True)]
    return partial.rdd.map(read).treeAggregate(None, merge, merge, DEPTH)


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x - mean


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the vectors of `clean`; None if there is none."""
    if not size:
        return None

    def count(parts: list[np.ndarray], x: np.ndarray) -> None:
        parts[0] += len(x)
        parts[1] += x.sum(axis=0)

    n, sums = _summed(vectors, size, lambda: [np.zeros(1, np.int64), np.zeros(size, np.int64)], count)
    n, sums = int(n[0]), [int(s) for s in sums]
    # Whole quotient and remainder apart, so that the mean is right to the last bit.
    mean = np.array([s // n + (s % n) / n for s in sums])

    def square(parts: list[np.ndarray], x: np.ndarray) -> None:
        y = _centred(x, mean)
        parts[0] += y.T @ y

    (total,) = _summed(vectors, size, lambda: [np.zeros((size, size))], square)
    covariance = total / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, size)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    flat = values <= max(trace, 0.0) * size * np.finfo(float).eps
    values = np.where(flat, 0.0, values)
    scaled = axes[:, ~flat] / np.sqrt(values[~flat])
    error = None
    if scaled.shape[1]:

        def check(parts: list[np.ndarray], x: np.ndarray) -> None:
            w = _centred(x, mean) @ scaled
            parts[0] += w.T @ w

        (again,) = _summed(vectors, size, lambda: [np.zeros((scaled.shape[1],) * 2)], check)
        error = float(np.abs(again / n - np.eye(scaled.shape[1])).max())
    return Whitening(n, sums, axes, values, [float(v) / trace if trace > 0 else None for v in values], error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; None where a long is too small."""
    rough = (np.abs(x).max(initial=0) * float(n) + max(map(abs, sums))) ** 2 * x.shape[1]
    if rough >= 2.0**62:
        # The bound is wide: the differences themselves are taken, exactly where a long holds them.
        wide = np.abs(x).max(initial=0) * float(n) >= 2.0**62 or max(map(abs, sums)) >= 2**62
        far = x.astype(object) * n - np.array(sums, object) if wide else x * n - np.array(sums, np.int64)
        if not wide and (np.abs(far).astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            return (far * far).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in far]
        return [v if v < 2**63 else None for v in exact]
    far = x * n - np.array(sums, np.int64)
    return (far * far).sum(axis=1).tolist()


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, size: int, model: Whitening | None) -> DataFrame:
    """One row for each vector of `clean` and component."""
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], _RESULT)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        mean = np.array([s // m.n + (s % m.n) / m.n for s in m.sums])
        k, live = m.components.shape[1], m.variances > 0
        with np.errstate(divide="ignore"):
            scale = np.where(live, 1 / np.sqrt(m.variances), 0.0)
        for batch in batches:
            done = 0
            for x in _integers(batch, size):
                w = (_centred(x, mean) @ m.components) * scale
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, rows).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, m.n, np.int64)),
                        pa.array(_deviations(x, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(w.ravel(), mask=np.tile(~live, rows)),
                        pa.array(m.explained * rows, pa.float64()),
                        pa.array([m.identity_error] * (rows * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                done += rows

    return vectors.mapInArrow(run, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, size = clean(read_table(spark, sf_dir, "embeddings"))
    return whiten(vectors, size, fit(vectors, size))
