"""Centroid clustering in whole numbers, with an annulus search for the nearest centroid.

Centroids lie sorted by their norms. A vector's distance to any centroid is an upper bound of that to its nearest; a centroid nearer than
that has a norm that differs from the vector's by no more. Two binary searches find the centroids in that annulus, its edges included,
and those alone are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted
from .vectors import matrix, parts, summed, whole_numbers

#: Bytes of all centroids, which every task gets.
MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Clusters:
    """rows: the vector's id, cluster int and distance long of every kept vector. centroids: as whole numbers. inertia: by centroid."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, hint: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid (of equally near ones the first), the squared distance, and how many were compared beyond
    the two that give the bound: the hint and the centroid whose norm comes next to the vector's. All whole numbers, of 64 bits."""
    own = np.sqrt(np.einsum("ij,ij->i", centroids, centroids).astype(np.float64))
    order = np.argsort(own, kind="stable")
    norms = own[order]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
    best, least = hint.astype(np.int64), squared(x, centroids[hint])

    def compare(rows: np.ndarray, tried: np.ndarray) -> None:
        d = squared(x[rows], centroids[tried])
        better = (d < least[rows]) | (d == least[rows]) & (tried < best[rows])
        best[rows[better]], least[rows[better]] = tried[better], d[better]

    compare(np.arange(len(x)), order[np.clip(np.searchsorted(norms, norm), 0, len(norms) - 1)])
    reach = np.sqrt(least.astype(np.float64)) + 1  # 1: more than the roots' rounding, so that ties on the edge are within
    low, high = np.searchsorted(norms, norm - reach, side="left"), np.searchsorted(norms, norm + reach, side="right")
    for k in range(int((high - low).max(initial=0))):
        rows = np.flatnonzero(low + k < high)
        compare(rows, order[low[rows] + k])
    return best, least, int((high - low).sum())


def start(numbers: DataFrame, vec_id: str, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id (null: empty); of equal ones that with the smaller components."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(quoted(vec_id)).cast("string"), F.lit("")))
    rows = numbers.where("x is not null").select(F.sha2(text.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def annulus_clusters(vectors: DataFrame, vec_id: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:") -> Clusters:
    """`rounds` times, every vector goes to its nearest centroid (squared Euclidean distance, ties to the smaller number) and every
    centroid that has vectors becomes their mean, rounded down; then all go to the nearest once more.

    Kept are the vectors of `dim` components, none null or not finite; a component counts as floor(scale * component). The centroids start
    as the k vectors whose seed and id have the smallest SHA-256. Equal rows count each. With fewer than k vectors there are as many
    centroids as vectors, with none there are none. A kept vector whose components are so large that distances exceed 64 bits (beyond
    about 1.3e8 after scaling, for 64 components) takes no part and has null as cluster and distance. Only the id is carried over.

    A round reads the vectors once; a task hands on a sum and a count for each centroid it met. What the driver and every task hold is the
    k centroids, whose bytes are bounded.
    """
    if 8 * k * dim > MOST_BYTES:
        raise ValueError(f"{k} centroids of {dim} components are more than {MOST_BYTES} bytes")
    numbers = whole_numbers(vectors, [vec_id], vec_col, dim, scale, 0, math.isqrt(((1 << 63) - 1) // dim) // 2)
    first = start(numbers, vec_id, k, seed)
    if not len(first):
        return Clusters(numbers.select(vec_id, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), first, [])
    rows = materialize(_assigned(numbers, dim, first, vec_id, keep=True), "vectors")
    centroids, whole = first, rows.where("x is not null")
    for _ in range(rounds):
        centroids = moved(whole, dim, centroids)
    out = materialize(_assigned(rows, dim, centroids, vec_id), "clusters")
    inertia = {r.cluster: int(r.n) for r in out.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    return Clusters(out, centroids, [inertia.get(c, 0) for c in range(len(centroids))])


def moved(rows: DataFrame, dim: int, centroids: np.ndarray) -> np.ndarray:
    """Every centroid's mean of its vectors, rounded down; those without vectors stay."""

    def sums(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        best, _, _ = nearest(x, part.column("cluster").to_numpy(zero_copy_only=False), centroids)
        out = np.zeros((len(centroids), dim + 1), np.int64)
        order = np.argsort(best, kind="stable")
        met, at = np.unique(best[order], return_index=True)
        out[met, :dim] = np.add.reduceat(x[order], at, axis=0) if len(at) else 0
        out[:, dim] = np.bincount(best, minlength=len(centroids))
        return out

    total = summed(rows, dim, (len(centroids), dim + 1), sums, exact=True)
    return np.array([[int(v) // int(t[dim]) for v in t[:dim]] if t[dim] else c.tolist() for t, c in zip(total, centroids, strict=True)], np.int64)


def _assigned(rows: DataFrame, dim: int, centroids: np.ndarray, vec_id: str, keep: bool = False) -> DataFrame:
    """(id, cluster, distance), or with keep (id, x, cluster), for the given centroids; rows may have a cluster of an earlier round."""
    hinted = "cluster" in rows.columns
    source = rows.select(F.col(quoted(vec_id)).alias("__id"), "x", *(["cluster"] if hinted else []))
    last = T.StructField("x", T.ArrayType(T.LongType())) if keep else T.StructField("distance", T.LongType())
    schema = T.StructType([T.StructField(vec_id, source.schema["__id"].dataType), T.StructField("cluster", T.IntegerType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, there in _with_nulls(batch, dim):
                hint = part.column("cluster").fill_null(0).to_numpy(zero_copy_only=False)[there] if hinted else np.zeros(len(x), np.int64)
                best, least, _ = nearest(x, hint, centroids)
                cols = []
                for values in (best, least):
                    full = np.zeros(part.num_rows, np.int64)
                    full[there] = values
                    cols.append(pa.array(full, mask=~there))
                yield pa.RecordBatch.from_arrays([part.column("__id"), cols[0].cast(pa.int32()), part.column("x") if keep else cols[1]], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _with_nulls(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    there = batch.column("x").is_valid()
    if batch.column("x").null_count == 0:
        for part, x in parts([batch], dim):
            yield part, x, np.ones(part.num_rows, bool)
    elif batch.num_rows:
        yield batch, matrix(batch.column("x").filter(there), dim), there.to_numpy(zero_copy_only=False)
