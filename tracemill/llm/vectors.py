"""Columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite entries (an empty one holds none)."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the places of the vectors with exactly `dims` entries, none null or non-finite, and their entries as doubles."""
    if isinstance(column.type, pa.FixedSizeListType):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy().astype(np.int64)
    rows = np.flatnonzero(np.diff(offsets) == dims)
    if column.null_count:
        rows = rows[np.asarray(column.is_valid())[rows]]
    values = column.values.cast(pa.float64())
    values = np.asarray(values.fill_null(np.nan)) if values.null_count else values.to_numpy()
    x = values[offsets[:-1][rows][:, None] + np.arange(dims)]
    good = np.isfinite(x).all(1)
    return rows[good], x[good]


def grid(x: np.ndarray, bits: int) -> np.ndarray:
    """floor(64 * x) as integers; those that need more than `bits` bits are an error, not a wrong result."""
    x = np.floor(64 * x)
    if np.abs(x).max(initial=0) >= 2.0**bits:
        raise ArithmeticError(f"floor(64 * x) of a vector's entry needs more than {bits} bits")
    return x.astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Each row divided by its norm; a row of zeros stays. Rows are scaled first, so that squares neither overflow nor vanish."""
    x = x / np.where((most := np.abs(x).max(1, initial=0)) > 0, most, 1)[:, None]
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None]
