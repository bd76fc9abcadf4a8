"""Embedding whitening: vectors on the principal axes of their covariance, each scaled to variance 1.

A first pass over the vectors gives the count, mean and centred scatter of each partition; two such summaries merge by Chan's formula
(scatters add, plus the outer product of the difference of means times n m / (n + m)) in treeReduce, so that few small
matrices reach the driver, which takes the eigenvectors. A second pass whitens and summarises the same way, and gives the largest absolute
entry of the covariance minus the identity. A third one returns the rows.

Vectors are taken as integers floor(64 * c) + SHIFT. The shift changes no difference, so that moments are taken of floor(64 * c), whose sums
are exact; deviations are exact too: in longs where those suffice, in Python's integers otherwise.

Cases: vectors that are null or hold null or non-finite entries are left out, and so are those of another length than most have (of equally
common lengths, the largest counts; vectors without entries don't); a null id passes through; repeated rows each count; axes without
variance (one row, or entries that depend on others) have no component; an empty table gives an empty result; further columns
are ignored. Entries of 2 ** 40 and more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.vectors import finite, grid, matrix

SHIFT = 1_000_000
BITS = 46
LEAST = 1e-11  # of the largest eigenvalue: below that, an axis has no variance but rounding


class Moments(NamedTuple):
    """Count, sums, mean and centred scatter of some vectors. Sums are exact for integers, as Python's integers."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray) -> Moments:
    mean = x.sum(0) / len(x)
    y = x - mean
    return Moments(len(x), x.sum(0).tolist(), mean, y.T @ y)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula for the moments of both."""
    n, d = a.n + b.n, b.mean - a.mean
    sums = [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    return Moments(n, sums, np.array([s / n for s in sums]), a.scatter + b.scatter + np.outer(d, d) * (a.n / n * b.n))


def _summary(dims: int, whiten=None):
    """Of each task, its moments in one row: of integers, or of what whiten makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            x = grid(matrix(batch.column("__v"), dims)[1], BITS)
            if len(x):
                now = moments(x if whiten is None else whiten(x))
                have = now if have is None else merged(have, now)
        if have is not None:
            sums = [str(s) for s in have.sums]  # beyond longs, too
            yield pa.RecordBatch.from_arrays([pa.array([have.n]), pa.array([sums]), pa.array([have.mean.tobytes()]), pa.array([have.scatter.tobytes()])], ["n", "sums", "mean", "scatter"])

    return run


def reduced(rows: DataFrame, dims: int, out: int | None = None, whiten=None) -> Moments:
    """The moments of all vectors (__v) with so many entries, of which there must be one."""
    width = out or dims
    kind = int if whiten is None else float

    def read(r) -> Moments:
        return Moments(r["n"], [kind(s) for s in r["sums"]], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(width, width))

    parts = rows.select("__v").mapInArrow(_summary(dims, whiten), "n long, sums array<string>, mean binary, scatter binary").rdd.map(read)
    # the depth at which tasks of treeReduce merge some ten summaries each
    depth = max(2, int(np.ceil(np.log10(max(parts.getNumPartitions(), 2)))))
    return parts.treeReduce(merged, depth)


def deviation(x: np.ndarray, n: int, sums: list) -> list[int]:
    """Of each row of integers the sum of (n x - S) ** 2, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    exact = np.int64 if len(sums) * most**2 < 2**63 else object
    y = n * x.astype(exact) - np.array(sums, exact)
    return (y * y).sum(1).tolist()


class Whitening:
    """The fitted map: components by falling eigenvalue, the largest entry of each positive."""

    def __init__(self, m: Moments, most: int):
        self.n, self.sums, self.mean = m.n, m.sums, np.array([s / m.n for s in m.sums])
        v = m.scatter / m.n
        e, axes = np.linalg.eigh((v + v.T) / 2)
        e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
        have = e > LEAST * max(e.max(initial=0), 0)
        self.explained = e[have] / max(np.trace(v), np.finfo(float).tiny)
        axes = axes[:, have] * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(e))])[have]
        self.map = axes / np.sqrt(e[have])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.map


def _rows(dims: int, whiten: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column("__v"), dims)
            x = grid(x, BITS)
            w = whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            off = pa.array(deviation(x, whiten.n, whiten.sums), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(rows)), off, lists], ["__id", "deviation", "__w"])

    return run


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector kept and component (from 1, at most `most`): id, component, n, deviation (decimal), whitened, explained, identity_error."""
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).where(finite(F.col("__v")) & (F.size("__v") > 0))
    kind = dict(rows.dtypes)["__id"]
    longest = rows.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = longest["d"] if longest else 0
    fitted = Whitening(reduced(rows, dims), most) if longest else None
    if fitted is None or not fitted.map.shape[1]:
        names = (("component", "int"), ("n", "bigint"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
        return rows.where("false").select(F.col("__id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in names))
    count = fitted.map.shape[1]
    check = reduced(rows, dims, count, fitted)
    error = float(np.abs(check.scatter / check.n - np.eye(count)).max())
    out = rows.mapInArrow(_rows(dims, fitted), f"__id {kind}, deviation decimal(38,0), __w array<double>").select("__id", "deviation", F.posexplode("__w").alias("__i", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(x)) for x in fitted.explained)), F.col("__i") + 1)
    return out.select(F.col("__id").alias(id_col), (F.col("__i") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
