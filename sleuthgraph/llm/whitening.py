"""Whitening of embeddings: moments over Spark, components by contour integration (``feast``).

Entries become integers, floor(256 c).  The fit list is each distinct integer vector once: its
length n and sums S are exact, its covariance is summed centred, one partial
matrix for each task, rows of it added up after a shuffle by their number.  What the driver
holds is one matrix of the vectors' dimension.  Then every vector is projected where it lies.

Nulls and ties: rows whose vector is null or holds null, NaN or infinite entries go; so do
empty vectors and those of another length than most distinct vectors have (of equally
frequent lengths the smallest counts).  Entries beyond a long saturate, and a deviation beyond
a long is null.  Components whose eigenvalue is 0 cannot be whitened and have no rows, so one
distinct vector alone gives none.  Repeated rows are returned each; an empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

from . import feast

COMPONENTS = 4
FACTOR = 256
LOW, HIGH = -(2.0 ** 63), 2.0 ** 63 - 1024


def _integers(batches):
    """Vectors as longs; those that do not count are left out."""
    for batch in batches:
        vectors = batch.column("embedding")
        vectors = vectors.filter(vectors.is_valid())
        ids = batch.column("vec_id").filter(batch.column("embedding").is_valid())
        sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
        flat = vectors.flatten()
        entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is NaN here
        ends = np.append(0, np.cumsum(sizes))
        bad = np.append(0, np.cumsum(~np.isfinite(entries)))
        good = (np.diff(bad[ends]) == 0) & (sizes > 0)
        kept = np.repeat(good, sizes)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(FACTOR * entries[kept]), LOW, HIGH).astype(np.int64)
        x = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes[good])).astype(np.int32), pa.array(x))
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), x], names=["vec_id", "x"])


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that count."""
    kind = dict(embeddings.dtypes)["vec_id"]
    return (embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
            .mapInArrow(_integers, f"vec_id {kind}, x array<long>"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _summed(vectors: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of a matrix made of rows of them: one partial sum a task, added up by row."""
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                here = part(_matrix(batch, d))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                             names=["i", "row"])

    def added(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                row = row.values.to_numpy()
                found[i] = found[i] + row if i in found else row
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))],
                                             names=["i", "row"])

    rows = vectors.select("x").mapInArrow(partial, "i int, row array<double>").repartition("i").mapInArrow(added, "i int, row array<double>")
    return np.array([r["row"] for r in rows.orderBy("i").toLocalIterator()], dtype=float)


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S), exact."""
    def partial(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            n, total = n + len(x), [t + (h << 32) + v for t, h, v in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array(map(str, [n, *total]))], names=["i", "s"])

    rows = (vectors.select("x").mapInArrow(partial, "i int, s string")
            .groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect())  # one row for each dimension
    found = {r["i"]: int(r["s"]) for r in rows}
    return found[-1], [found[i] for i in range(d)]


def _dimension(fit: DataFrame) -> int:
    row = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """The sum of (n x - S) squared over the dimensions, exact; null beyond a long."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    rows = cut(integers(embeddings))
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    # a vector that many rows hold is one row of each task before the shuffle
    distinct = cut(rows.select("x").distinct())
    d = _dimension(distinct)
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    fit = distinct.where(F.size("x") == d)
    n, sums = _sums(fit, d)
    mean = np.array([s // n + s % n / n for s in sums])

    def products(x):
        c = x - mean
        return c.T @ c

    covariance = _summed(fit, d, products) / n
    values, vectors = feast.largest(covariance, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)
    centre = _summed(fit, d, lambda x: ((x - mean) @ turn).sum(axis=0)[None, :])[0] / n

    def check(x):
        w = (x - mean) @ turn - centre
        return w.T @ w

    error = float(np.abs(_summed(fit, d, check) / n - np.eye(len(values))).max())
    explained, k = values / np.trace(covariance), len(values)

    def project(batches):
        for batch in batches:
            x = _matrix(batch, d)
            arrays = [batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                      pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                      pa.array([v for v in _deviations(x, n, sums) for _ in range(k)], pa.int64()),
                      pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return rows.where(F.size("x") == d).mapInArrow(project, schema)
