"""Vectors as integer matrices in Arrow batches, and sums of matrices over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

#: Rows whose vectors one step works on.
ROWS = 8192


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold vectors of `dim` components, none of them null or not finite; and those vectors as doubles."""
    if not len(column):
        return np.empty(0, bool), np.empty((0, dim))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fit = lengths == dim
    x = pc.list_flatten(column.filter(pa.array(fit))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(int(fit.sum()), dim)
    whole = np.isfinite(x).all(axis=1)  # nulls come as NaN
    fit[fit] = whole
    return fit, x[whole]


def whole_numbers(vectors: DataFrame, keep: list[str], vec_col: str, dim: int, scale: float, shift: int, limit: int, out_of_range: str = "null") -> DataFrame:
    """The columns `keep` of rows with a vector of `dim` finite components, and x: floor(scale * component) + shift of each, as longs.

    Where a number isn't within -limit and limit, x is null, or the row is left out if out_of_range is "drop".
    """
    rows = vectors.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(vec_col)).cast("array<double>").alias("__vector"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fit, x = finite_rows(part.column(part.num_columns - 1), dim)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x) + shift
                fine = (np.abs(x) < limit).all(axis=1)
                if out_of_range == "drop":
                    fit[fit], x, fine = fine, x[fine], np.ones(int(fine.sum()), bool)
                flat = pa.array(np.where(fine[:, None], x, 0).astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat, mask=pa.array(~fine)) if len(x) else pa.array([], pa.list_(pa.int64()))
                kept = part.filter(pa.array(fit))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], lists], names=[*keep, "x"])

    return rows.mapInArrow(run, schema)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of `dim` longs, none null, as a matrix."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), dim)


def parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(part.column("x"), dim)


def summed(rows: DataFrame, dim: int, shape: tuple[int, int], of: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all rows (x never null) of the matrices that `of` makes of their parts.

    Each task adds up its own parts and hands on one matrix, as rows (row, column, value) that Spark sums: no task and not the driver
    takes more than shape allows. exact: whole numbers, in longs within a task and in decimals beyond; else doubles.
    """
    kind = np.int64 if exact else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for part, x in parts(batches, dim):
            total += of(part, x)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])

    value = F.col("value").cast("decimal(38,0)") if exact else F.col("value")
    cells = rows.mapInArrow(run, f"i int, j int, value {'long' if exact else 'double'}").groupBy("i", "j").agg(F.sum(value).alias("value")).collect()
    out = np.zeros(shape, object if exact else np.float64)
    for r in cells:
        out[r.i, r.j] = int(r.value) if exact else r.value
    return out
