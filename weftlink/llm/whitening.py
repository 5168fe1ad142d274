"""Whitening by the leading components of the covariance, from a randomised range finder.

A few random directions more than asked for are multiplied by the covariance again and again, each time in a pass over all centred rows
that never forms the covariance itself; Rayleigh-Ritz in the span gives components and residuals. Where the residuals stay too large for
double precision, as with a spectrum that hardly falls, the basis is completed to the full dimension, where they vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted
from .vectors import parts, summed, whole_numbers

#: Whole numbers beyond this aren't taken: sums within a task stay within 64 bits.
LIMIT = 1 << 40
#: A component counts as found when its residual is this small against the distance to the next eigenvalue.
RESIDUAL = 1e-12
LONGEST = float((1 << 63) - 1)


@dataclass(frozen=True)
class Whitening:
    """n rows with sums by dimension; components: columns, unit length, of falling eigenvalue; explained: shares of the trace.
    size: how many directions the last basis had. Rows x: the numbers, with the id."""

    rows: DataFrame
    vec_id: str
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    size: int

    @property
    def turn(self) -> np.ndarray:
        """What centred rows are multiplied by."""
        return self.components / np.sqrt(self.eigenvalues)

    def identity_error(self) -> float:
        """The largest entry, without sign, of the whitened rows' covariance minus the identity, in one pass over all rows."""
        p, n, sums, turn = len(self.eigenvalues), self.n, self.sums, self.turn
        if not p:
            return 0.0

        def of(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
            w = np.hstack([centred(x, n, sums) @ turn, np.ones((len(x), 1))])
            return w.T @ w

        m = summed(self.rows, len(sums), (p + 1, p + 1), of) / n
        return float(np.abs(m[:p, :p] - np.outer(m[p, :p], m[p, :p]) - np.eye(p)).max())

    def whitened(self) -> DataFrame:
        """The id, deviation long (sum over dimensions of (n * x - sum)^2; null where that exceeds 64 bits) and whitened array<double>."""
        vec_id, n, sums, turn = self.vec_id, self.n, self.sums, self.turn
        schema = T.StructType([self.rows.schema[vec_id], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in parts(batches, len(sums)):
                w = centred(x, n, sums) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(vec_id), deviations(x, n, sums), lists], names=[f.name for f in schema.fields])

        return self.rows.mapInArrow(run, schema)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off in whole numbers, so that only differences are rounded."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([(s % n) / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    rough = (centred(x, n, sums) ** 2).sum(axis=1) * float(n) * float(n)
    small = rough < LONGEST * 0.999
    y = n * (x[small] - np.array([s // n for s in sums], np.int64)) - np.array([s % n for s in sums], np.int64)
    out = np.zeros(len(x), np.int64)
    out[small] = (y * y).sum(axis=1)
    for k in np.flatnonzero(~small & (rough < LONGEST * 1.001)):  # near the edge: as many digits as it takes
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums, strict=True))
        out[k], small[k] = (exact, True) if exact < 1 << 63 else (0, False)
    return pa.array(out, mask=~small)


def common_length(vectors: DataFrame, vec_col: str) -> int:
    """The length that most vectors have; of equally frequent ones the larger; 0 if there is none."""
    length = F.size(F.col(quoted(vec_col))).alias("length")
    row = vectors.where(F.col(quoted(vec_col)).isNotNull()).groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    return row["length"] if row else 0


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 0, oversample: int = 8, passes: int = 4, seed: int = 0, dim: int | None = None) -> Whitening:
    """The first components of the covariance (divisor n) of floor(scale * component) + shift over all vectors.

    Rows whose vector is null or holds entries that are null or not finite are left out, also those that aren't of `dim` components (if not
    given, the length that most vectors have) and those with numbers of 2**40 and more. Equal rows count each. There are fewer components
    than asked for if the vectors don't span as many: an eigenvalue has to exceed 1e-13 of the largest. No rows: no components.
    Only the id is carried over.

    The driver and each task hold matrices of the dimension times the number of directions, nothing that grows with the rows.
    """
    dim = common_length(vectors, vec_col) if dim is None else dim
    rows = materialize(whole_numbers(vectors, [vec_id], vec_col, dim, scale, shift, LIMIT, "drop"), "numbers")
    total = summed(rows, dim, (1, dim + 1), lambda part, x: np.append(x.sum(axis=0), len(x))[None], exact=True)[0]
    n, sums = int(total[dim]), [int(s) for s in total[:dim]]
    if not n or not dim:
        return Whitening(rows, vec_id, n, sums, np.empty((dim, 0)), np.empty(0), np.empty(0), 0)
    trace = float(summed(rows, dim, (1, 1), lambda part, x: np.array([[(centred(x, n, sums) ** 2).sum()]]))[0, 0]) / n

    def times(q: np.ndarray) -> np.ndarray:
        def of(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return summed(rows, dim, q.shape, of) / n

    draw = np.random.default_rng(seed)
    want, size = min(components, dim), min(dim, components + oversample)
    basis = np.linalg.qr(draw.standard_normal((dim, size)))[0]
    for k in range(passes + 1):
        image = times(basis)
        values, vectors_, good = ritz(basis, image, want)
        if good or size == dim:
            break
        if k + 1 < passes:  # another power pass
            basis = np.linalg.qr(image)[0]
        else:  # the span becomes the whole space
            size, basis = dim, np.linalg.qr(np.hstack([image, draw.standard_normal((dim, dim - size))]))[0]
    there = values > 1e-13 * max(values.max(initial=0), 0)
    return Whitening(rows, vec_id, n, sums, vectors_[:, there], values[there], values[there] / trace if trace else values[there], size)


def ritz(basis: np.ndarray, image: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The `want` largest Ritz values and vectors of the span, given its image under the covariance, and whether they are found to
    double precision: residuals small against the distance to the nearest other value."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    found = basis @ turn
    residual = np.linalg.norm(image @ turn - found * values, axis=0)[:want]
    gap = np.array([np.abs(np.delete(values, k) - v).min() if len(values) > 1 else v for k, v in enumerate(values[:want])])
    return values[:want], found[:, :want] / np.linalg.norm(found[:, :want], axis=0), bool((residual <= RESIDUAL * gap).all())


def whitening_rows(model: Whitening) -> DataFrame:
    """A row a vector and component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    error = model.identity_error()
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    rows = model.whitened().select(model.vec_id, "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(model.vec_id, (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))
