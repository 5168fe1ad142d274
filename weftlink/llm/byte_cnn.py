"""Operator 7: a byte-level convolutional network in numpy that scores whole documents."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, labelled_sample, map_text, materialize, platt, spans

#: Bytes of a block; a chunk is two adjacent blocks, so that chunks overlap by half.
BLOCK = 256
#: A filter sees WIDTH bytes and moves by STRIDE.
WIDTH, STRIDE, EMBED, FILTERS = 6, 2, 8, 16
PAD = WIDTH - STRIDE
#: Blocks that go through the filters at a time.
AT_ONCE = 256
PREDICT_AT = 0.3
#: Bound of the labelled rows that the network is fitted on.
SAMPLE_ROWS = 3000


@dataclass(frozen=True)
class ByteCnn:
    embed: np.ndarray  # 256, EMBED
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    bias: np.ndarray
    out: np.ndarray  # for the mean and the maximum over chunks
    offset: float
    slope: float = 1.0
    shift: float = 0.0


def blocks_of(text: bytes) -> int:
    return max(1, -(-(len(text) + PAD) // BLOCK))


def windows(embed: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The filters' inputs over rows of bytes: rows, positions, WIDTH * EMBED."""
    pairs = embed[raw].reshape(len(raw), raw.shape[1] // STRIDE, STRIDE * EMBED)
    n = pairs.shape[1] - PAD // STRIDE
    return np.concatenate([pairs[:, k : k + n] for k in range(WIDTH // STRIDE)], axis=2)


def block_rows(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Blocks (rows of raw), each with the PAD bytes its windows reach into: the next block's, after a text's last one zeros."""
    after = np.zeros((len(raw), PAD), np.uint8)
    after[:-1] = raw[1:, :PAD]
    after[last] = 0
    return np.concatenate([raw, after], 1)


@dataclass(frozen=True)
class Pooled:
    """Texts of n blocks each, from their first byte to their last, with what each filter makes of them."""

    rows: np.ndarray
    n: np.ndarray
    at: np.ndarray | None  # where each filter's maximum in a block is, if asked for
    second: np.ndarray  # chunks, named by their first block, whose maximum is in the second one
    h: np.ndarray  # of chunks; 0 where none begins
    keep: np.ndarray
    features: np.ndarray  # mean and maximum over a text's chunks


def pool(net: ByteCnn, raw: np.ndarray, n: np.ndarray, places: bool = False) -> Pooled:
    """raw: the texts' blocks one after another. Each text is cut into overlapping chunks; a text of one block is one chunk."""
    first, last = spans(n)
    rows = block_rows(raw.reshape(-1, BLOCK), last - 1)
    most, at = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.uint8) if places else None
    for k in range(0, len(rows), AT_ONCE):
        z = windows(net.embed, rows[k : k + AT_ONCE]) @ net.filters
        most[k : k + AT_ONCE] = z.max(axis=1)
        if places:
            at[k : k + AT_ONCE] = z.argmax(axis=1)
    chunk = most.copy()
    inner = np.ones(len(most), bool)
    inner[last - 1] = False
    begin = np.flatnonzero(inner)
    chunk[begin] = np.maximum(most[begin], most[begin + 1])
    keep = inner.copy()
    keep[last[n == 1] - 1] = True
    h = np.maximum(chunk + net.bias, 0)
    h[~keep] = 0
    mean, top = np.add.reduceat(h, first) / np.maximum(n - 1, 1)[:, None], np.maximum.reduceat(h, first)
    return Pooled(rows, n, at, chunk > most, h, keep, np.concatenate([mean, top], 1).astype(np.float64))


def logits(net: ByteCnn, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rounded, as matrix products differ in their last digits by what else is in a batch."""
    return np.round(pool(net, raw, n).features @ net.out + net.offset, 4)


def padded(text: bytes) -> bytes:
    return text + bytes(blocks_of(text) * BLOCK - len(text))


def probabilities(net: ByteCnn, batch: list[bytes]) -> np.ndarray:
    """Each text is scored from its first byte to its last; an empty text is one block of padding."""
    n = np.array([blocks_of(t) for t in batch], np.int64)
    z = logits(net, np.frombuffer(b"".join(map(padded, batch)), np.uint8), n)
    return 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -30, 30)))


def gradients(net: ByteCnn, got: Pooled, y: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """Of the log loss over `total` texts, these texts' part: through the block that wins for each filter, in each chunk."""
    first, _ = spans(got.n)
    z = got.features @ net.out + net.offset
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
    dh = np.repeat(d[:, None] * net.out[:FILTERS] / np.maximum(got.n - 1, 1)[:, None], got.n, 0) * got.keep[:, None]
    top = np.where(got.h == np.repeat(np.maximum.reduceat(got.h, first), got.n, 0), np.arange(len(got.h))[:, None], len(got.h))
    dh[np.minimum.reduceat(top, first), np.arange(FILTERS)] += d[:, None] * net.out[FILTERS:]
    dz = (dh * (got.h > 0)).astype(np.float32)
    db = np.where(got.second, 0, dz)
    db[1:] += np.where(got.second, dz, 0)[:-1]
    de, df = np.zeros((256, EMBED)), np.zeros((WIDTH * EMBED, FILTERS))
    for k in range(0, len(db), AT_ONCE):
        part, at = db[k : k + AT_ONCE], got.at[k : k + AT_ONCE].astype(np.int64)
        where = np.take_along_axis(got.rows[k : k + AT_ONCE], (at[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(len(part), -1), 1)
        df += np.einsum("bf,bfi->if", part, net.embed[where].reshape(len(part), FILTERS, -1))
        dx = (part[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        de += np.stack([np.bincount(where.ravel(), dx[:, e], 256) for e in range(EMBED)], 1)
    return {"embed": de, "filters": df, "bias": dz.sum(0), "out": got.features.T @ d, "offset": d.sum(keepdims=True)}


def fit(raw: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the log loss over three quarters of the texts, Platt calibration on the rest. With one label only: a constant.

    raw: the whole texts (padded) of n blocks each; some are read at a time, of about SLICE_BYTES together or a single one.
    """
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, 2 * FILTERS), "offset": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if len(set(y.tolist())) < 2:
        return ByteCnn(p["embed"], p["filters"], p["bias"], np.zeros_like(p["out"]), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    first, last = (x * BLOCK for x in spans(n))
    held = np.arange(len(y)) % 4 == 3

    def made() -> ByteCnn:
        return ByteCnn(p["embed"], p["filters"], p["bias"], p["out"], float(p["offset"][0]))

    def parts(rows: np.ndarray):
        at, ends = 0, np.cumsum(n[rows]) * BLOCK
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            part = rows[at:to]
            yield part, np.concatenate([raw[first[r] : last[r]] for r in part])
            at = to

    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~held))
        for rows in np.array_split(order, max(1, len(order) // 48)):
            net, grads = made(), {k: np.zeros(x.shape) for k, x in p.items()}
            for part, texts in parts(rows):
                for k, g in gradients(net, pool(net, texts, n[part], places=True), y[part], len(rows)).items():
                    grads[k] += g
            t += 1
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net, rows = made(), np.flatnonzero(held)
    z = np.concatenate([np.empty(0), *(logits(net, texts, n[part]) for part, texts in parts(rows))])
    return replace(net, **dict(zip(("slope", "shift"), platt(z, y[rows]), strict=True)))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = SAMPLE_ROWS, only=None) -> ByteCnn:
    """Fit on at most `limit` labelled documents, each of them whole: they come to the driver one by one and lie in a file there."""
    rows = materialize(labelled_sample(docs, labels, target, limit, only), "labelled").orderBy("doc_id", "text", "y")
    n, y = [], []
    with tempfile.TemporaryFile() as file:
        for r in rows.select(F.col("text").cast("binary").alias("text"), "y").toLocalIterator():
            text = bytes(r.text or b"")
            file.write(padded(text))
            n.append(blocks_of(text))
            y.append(r.y)
        file.flush()
        raw = np.memmap(file, np.uint8, "r") if n else np.empty(0, np.uint8)
        return fit(raw, np.array(n, np.int64), np.array(y, np.float64))


def cnn_scores(docs: DataFrame, net: ByteCnn, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Append score, the probability of label 1, and predicted (1 from PREDICT_AT on) to docs.

    The score depends on the text alone: null counts as empty, an empty text has a score as well,
    repeated rows and ties score alike, an empty table gives none. A column of docs named score or predicted is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        net = shared.value
        return lambda batch: [probabilities(net, batch)]

    out = map_text(docs.drop("predicted"), text_col, [T.StructField("score", T.DoubleType())], start, keep_text)
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
