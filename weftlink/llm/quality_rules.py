"""Operator 3: text statistics, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, labelled_sample, map_text, mix, platt, range_sums, spans, window_hashes, words_of

#: Weights a feature group has: words, word pairs, 3 characters, 4 characters.
GROUP = 1 << 13
GROUPS = 4
SYMBOLS = b"#*$%&|<>"
#: 1 for bytes that begin a character other than ASCII whitespace, and for symbols.
CHAR = np.array([0 if x in b" \t\n\r\x0b\x0c" or x & 0xC0 == 0x80 else 1 for x in range(256)], np.uint8)
SYMBOL = np.array([x in SYMBOLS for x in range(256)], np.uint8)
KEEP_AT = 0.4
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Bound on the labelled rows that the model is fitted on.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    slope: float
    offset: float


def inside(total: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Marks the positions among `total` at which a run of `width` stays within its text; starts: of the texts but the first."""
    ok = np.ones(max(total - width + 1, 0), bool)
    for k in range(1, width):
        at = starts - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def text_stats(batch: list[bytes], words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    first, _ = spans(words.n)
    size = np.array([len(t) for t in batch], np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in batch]
    runs, ok = window_hashes(words.hashes, WINDOW), inside(len(words.hashes), first[1:], WINDOW)
    runs = runs ^ mix(np.repeat(np.arange(len(batch), dtype=np.uint64), words.n)[: len(runs)])  # equal within a text only
    order = np.sort(runs[ok])
    often = np.unique(order[1:][order[1:] == order[:-1]])
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, runs), len(often) - 1)
        twice = np.flatnonzero(ok & (often[at] == runs))
        edge[twice] += 1
        edge[twice + WINDOW] -= 1
    return [words.n, range_sums(CHAR[words.raw], words.at, size), range_sums(SYMBOL[words.raw], words.at, size), np.array([len(x) - len(set(x)) for x in lines], np.int64), range_sums(np.cumsum(edge)[:-1] > 0, first, words.n)]


def characters(raw: np.ndarray) -> np.ndarray:
    """The characters of UTF-8 bytes, each as its bytes in one number."""
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32)
    at = np.flatnonzero(raw & 0xC0 != 0x80)
    size = np.diff(np.append(at, len(raw)))
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def n_characters(batch: list[bytes]) -> np.ndarray:
    return np.array([len(t) if t.isascii() else int((np.frombuffer(t, np.uint8) & 0xC0 != 0x80).sum()) for t in batch], np.int64)


def group_indexes(chars: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """For each feature group, the weight that each n-gram of the whole text falls on."""
    mask = np.uint64(GROUP - 1)
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) >> np.uint64(40) & mask
    pairs[hashes[:-1] == hashes[1:]] = 0  # a word that follows itself is one feature, whatever the word
    step, shift = np.uint32(0x01000193), np.uint32(32 - GROUP.bit_length() + 1)
    three = (chars[:-2] * step + chars[1:-1]) * step + chars[2:]
    four = three[:-1] * step + chars[3:]
    return [x.astype(np.int64) for x in (hashes & mask, pairs, *(((x ^ x >> np.uint32(15)) * np.uint32(2654435761)) >> shift for x in (three, four)))]


def features(batch: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The texts' sparse vectors: in each, the frequencies of a group sum to one."""
    out = []
    for t in batch:
        at, val = [], []
        for k, x in enumerate(group_indexes(characters(np.frombuffer(t, np.uint8)), words_of([t]).hashes)):
            if len(x):
                i, n = np.unique(x, return_counts=True)
                at.append(i + k * GROUP)
                val.append(n / len(x))
        out.append((np.concatenate(at), np.concatenate(val)) if at else (np.empty(0, np.int64), np.empty(0)))
    return out


def raw_scores(weights: np.ndarray, batch: list[bytes], words: Words) -> np.ndarray:
    """The model's linear score of each text: as from features(), without building the vectors."""
    first, _ = spans(words.n)
    size = n_characters(batch)
    at = np.cumsum(size + 1) - size - 1  # a space stands after each text
    out = np.full(len(batch), weights[-1])
    for k, (x, a, n) in enumerate(zip(group_indexes(characters(words.raw), words.hashes), (first, first, at, at), (words.n, words.n - 1, size - 2, size - 3), strict=True)):
        out += range_sums(weights[k * GROUP : (k + 1) * GROUP][x], a, n) / np.maximum(n, 1)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 100, l2: float = 1e-6) -> QualityModel:
    """Logistic regression by Adam on three quarters of the rows, Platt calibration on the rest. With one label only: no features."""
    y = np.array([r[2] for r in rows])
    w = np.zeros(GROUPS * GROUP + 1)
    if len(set(y)) < 2:
        return QualityModel(w, 1.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    held = np.arange(len(rows)) % 4 == 3
    rows = [r for r, h in zip(rows, held, strict=True) if not h] + [r for r, h in zip(rows, held, strict=True) if h]  # so that what is fitted on is one slice
    y, held = np.array([r[2] for r in rows]), np.sort(held)
    sizes = [len(r[0]) for r in rows]
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32, copy=False)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    n = sum(sizes[: int((~held).sum())])
    ti, tv, to = index[:n], value[:n], owner[:n]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(to, tv * w[ti], len(rows)) + w[-1]
        g = np.where(held, 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / (~held).sum()
        grad = np.bincount(ti, tv * g[to], len(w)) + l2 * w
        grad[-1] = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.4 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    z = np.bincount(owner, value * w[index], len(rows)) + w[-1]
    return QualityModel(w, *platt(z[held], y[held]))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, only=None) -> QualityModel:
    """Fit on at most `limit` labelled documents; their hashed vectors, of at most GROUPS * GROUP entries, reach the driver."""
    fields = [T.StructField("at", T.BinaryType()), T.StructField("val", T.BinaryType())]

    def start():
        def vectors(batch: list[bytes]) -> list:
            made = features(batch)
            return [pa.array([x[k].astype(t).tobytes() for x in made], pa.binary()) for k, t in ((0, np.uint16), (1, np.float32))]

        return vectors

    rows = map_text(labelled_sample(docs, labels, "quality", limit, only), "text", fields, start, keep_text=False).toPandas()
    rows = rows.sort_values(["doc_id", "y"], kind="stable")
    return fit([(np.frombuffer(a, np.uint16), np.frombuffer(b, np.float32), y) for a, b, y in zip(rows["at"], rows["val"], rows["y"], strict=True)])


def quality_rules(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_at: float = KEEP_AT, keep_text: bool = True) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept to docs.

    Words are runs of non-whitespace (ASCII). A null or empty text has no words and so fails the base rule.
    Rows are independent of each other: repeated rows and ties get equal results; an empty table gives none.
    Columns of docs that bear the name of a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(c, T.LongType()) for c in STATS] + [T.StructField("quality_score", T.DoubleType())]

    def start():
        m = shared.value

        def score(batch: list[bytes]) -> list:
            words = words_of(batch)
            raw = raw_scores(m.weights, batch, words)
            return [*text_stats(batch, words), 1 / (1 + np.exp(-np.clip(m.slope * raw + m.offset, -30, 30)))]

        return score

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = map_text(docs.drop("base_failed", "kept"), text_col, fields, start, keep_text)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= keep_at))
