"""Helpers shared by the training-data operators: shared storage, Arrow batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step of an Arrow task handles at a time, and those whose words are hashed together.
SLICE_BYTES, HASH_BYTES = 1 << 20, 1 << 18
LOWER = np.frombuffer(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), np.uint8)
#: Marks the bytes that words are made of: all but ASCII whitespace; ASCII letters and digits, and all that isn't ASCII.
SOLID = np.array([x not in b" \t\n\r\x0b\x0c" for x in range(256)])
ALNUM = np.array([x > 127 or bytes([x]).isalnum() for x in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir; where that is unset and all is one process, as in tests,
    a folder of our own. On a cluster it has to be named: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="weftlink-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage in a way that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(columns: list[str], names) -> list[str]:
    """Those of columns that bear none of the names, in whatever case, as Spark tells columns apart without it."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def id_text(col: str = "doc_id"):
    """The id as text; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part, single rows apart, has more than limit bytes in column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_text(df: DataFrame, text_col: str, fields: list[T.StructField], fn: Callable[[], Callable[[list[bytes]], list]], keep_text: bool = True) -> DataFrame:
    """Append the columns `fields`, computed in Arrow batches from whole texts.

    fn() is called once a task and returns a function from a list of texts to one array per field.
    All other columns pass through; a column of df that bears the name of a new one, in any case, is replaced.
    """
    passed = [c for c in others(df.columns, [f.name for f in fields]) if keep_text or c != text_col]
    hidden = text_col not in passed
    source = df.select(*[F.col(quoted(c)) for c in passed], *([F.col(quoted(text_col)).alias("__text")] if hidden else []))
    column = "__text" if hidden else text_col
    schema = T.StructType([f for c in passed for f in source.schema.fields if f.name == c] + fields)
    new = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fn()
        for batch in batches:
            for part in slices(batch, column):
                cols = [part.column(c) for c in passed] + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in made(texts(part, column))]
                yield pa.RecordBatch.from_arrays(cols, names=passed + new)

    return source.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: The word hash is a polynomial in BASE over random values of the bytes; BASE - 1 has one factor of two only.
BASE = 0x9E3779B97F4A7C17
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(n, x, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


@dataclass(frozen=True)
class Words:
    """The words of a list of texts: their hashes one after another, how many each text has, where each begins and ends in raw."""

    raw: np.ndarray
    at: np.ndarray  # where each text begins in raw; a space stands after each
    hashes: np.ndarray
    n: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words_of(batch: list[bytes], solid: np.ndarray = SOLID, lower: bool = False) -> Words:
    """Split texts into words, runs of the bytes that `solid` marks, and hash each word to 64 bits."""
    raw = np.frombuffer(b" ".join([*batch, b""]), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in batch[:-1])]) if batch else np.empty(0, np.int64)
    inner = solid[raw]
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    if len(raw) and inner[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    hashes, k = np.empty(len(begin), np.uint64), 0
    while k < len(begin):  # some words at a time, as the sums take eight times the bytes
        to = max(k + 1, int(np.searchsorted(end, begin[k] + HASH_BYTES, side="right")))
        part, base = raw[begin[k] : end[to - 1]], begin[k]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((VALUE[LOWER] if lower else VALUE)[part] * up[: len(part)], out=total[1:])
        first, last = begin[k:to] - base, end[k:to] - base
        hashes[k:to] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        k = to
    return Words(raw, at, hashes, np.diff(np.append(np.searchsorted(begin, at), len(begin))), begin, end)


def word_hash(word: bytes) -> int:
    return int(words_of([word]).hashes[0])


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs of the given lengths."""
    ends = np.cumsum(counts)
    return ends - counts, ends


def range_sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values[start : start + count], for starts in order and ranges that don't overlap."""
    out = np.zeros(len(starts), np.int64 if values.dtype.kind in "bui" else np.float64)
    some = np.flatnonzero(counts > 0)
    if len(some):
        edges = np.stack([starts[some], starts[some] + counts[some]], 1).ravel()
        out[some] = np.add.reduceat(np.append(values, values[:1]), edges, dtype=out.dtype)[::2]
    return out


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities: Newton's method on held-back rows, lightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(z * (p - y)).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(max(a, 1e-3)), float(b)


#: Bytes of text that a labelled sample has at most.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, only=None, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most `limit` labelled documents with at most `most_bytes` of text in all, in the order of a hash of the id: (doc_id, text, y).

    The ids are chosen among the labels, so that the broadcast side has at most `limit` rows; several documents of one id count each.
    Documents longer than a sixteenth of most_bytes are left out, and all from the one on that would go beyond most_bytes. Null ids and labels other than 0 and 1 are left out; of repeated
    labels the smallest counts.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
    if only is not None:
        chosen = chosen.where(only)
    chosen = chosen.groupBy("doc_id").agg(F.min(target).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text").where(bytes_ <= most_bytes // 16).join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(limit)
    size = F.sum(bytes_).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__bytes", size).where(F.col("__bytes") <= most_bytes).drop("__bytes")
