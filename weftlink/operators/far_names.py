"""The best of all names for names that share too few tokens with others: a search by bounds.

Two names without a common token score 0.15 times the likeness of the whole names and 0.20 times that of their tokens, both by edit distance.
Two texts can't be liker than the letters they have in common, counted with repeats, over the length of the longer one. Names lie in blocks
of similar length and letters; a block's greatest counts of each letter bound what any of its names can score. The blocks with the
highest bounds are looked at first; then, of the others, only those whose bound reaches the last place of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_name_score
from ..storage import Scratch
from .numbering import numbered

#: Names a block, at least; and the most blocks, whose bounds each task gets (64 bytes a block).
BLOCK, MOST_BLOCKS = 256, 1 << 16
#: Letters told apart: a to z, and all others together.
LETTERS = 27
#: Blocks that a name looks at first, at least.
FIRST = 2


def letter_counts(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-16-le"), np.uint16).astype(np.int64) - 97
    return np.minimum(np.bincount(np.where((raw < 0) | (raw > 25), 26, raw), minlength=LETTERS), 255)


def summaries(blocks: DataFrame) -> tuple[np.ndarray, ...]:
    """By block: how many photos, the least and greatest length, and the greatest counts of letters in names and in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("norm").to_pylist(), b.column("tokens").to_pylist(), strict=True)
            counts = [[*letter_counts(n).tolist(), *np.max([letter_counts(t) for t in ts] or [np.zeros(LETTERS, int)], axis=0).tolist()] for n, ts in rows]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), pa.array([len(n.encode("utf-16-le")) // 2 for n in b.column("norm").to_pylist()], pa.int64()), pa.array(counts, pa.list_(pa.int64()))], names=["block", "n", "length", "counts"])

    rows = blocks.select("block", "n", "norm", "tokens").mapInArrow(run, "block long, n long, length long, counts array<long>")
    most = [F.max(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(2 * LETTERS)]
    got = rows.groupBy("block").agg(F.sum("n").alias("n"), F.min("length").alias("low"), F.max("length").alias("high"), *most).orderBy("block").toPandas()
    counts = got[[f"c{k}" for k in range(2 * LETTERS)]].to_numpy().astype(np.uint8)
    return got["n"].to_numpy(), got["low"].to_numpy(), got["high"].to_numpy(), counts[:, :LETTERS], counts[:, LETTERS:]


def block_bounds(norm: str, tokens: list[str], low: np.ndarray, high: np.ndarray, whole: np.ndarray, single: np.ndarray) -> np.ndarray:
    """By block: a score that no name in it, without a token in common, exceeds."""
    def common(text: str, most: np.ndarray) -> np.ndarray:  # a count of 255 stands for any number
        own = letter_counts(text)
        return np.where(most == 255, own, np.minimum(own, most)).sum(axis=1) if own.max(initial=0) < 255 else np.full(len(most), len(text.encode("utf-16-le")) // 2)

    size = lambda text: max(1, len(text.encode("utf-16-le")) // 2)
    names = np.minimum(np.minimum(common(norm, whole), high) / np.maximum(np.maximum(size(norm), low), 1), 1)
    best = np.max([np.minimum(common(t, single) / size(t), 1) for t in tokens], axis=0)
    return np.minimum(0.15 * names + 0.20 * best, 0.35)


def far_pairs(left: DataFrame, right: DataFrame, known: DataFrame, k: int, least: float, gap: float, scratch: Scratch) -> DataFrame:
    """left_name, right_name, score and equal of all pairs that the lists of k may take, for names of `left` that have tokens.

    left and right: id, name, norm, tokens; right also n and cand_seq. known: all their pairs that have a token in common or are nearly the
    same. A list takes what reaches `least` or is within `gap` of its best.
    """
    total = right.count()
    size = max(BLOCK, -(-total // MOST_BLOCKS))
    letters = F.array_join(F.array_sort(F.array_distinct(F.split("norm", ""))), "")
    placed = numbered(right.select("id", "name", "norm", "tokens", "n", "cand_seq", F.length("norm").alias("__length"), letters.alias("__letters")), [], ["__length", "__letters", "id"], "i")
    blocks = scratch.write(placed.withColumn("block", F.floor((F.col("i") - 1) / size)).drop("i", "__length", "__letters"), "blocks")
    of = summaries(blocks)
    have = blocks.select(F.col("name").alias("right_name"), "n")
    found = known.join(left.select(F.col("name").alias("left_name")), "left_name", "left_semi").select("left_name", "right_name", "score", "equal")

    def looked_at(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [b.column(c).to_pylist() for c in ("id", "norm", "tokens", "floor")]
                ids, met = [], []
                for name_id, norm, tokens, floor in zip(*rows, strict=True):
                    bound = block_bounds(norm, tokens, *of[1:])
                    order = np.argsort(-bound, kind="stable")
                    most = max(FIRST, int(np.searchsorted(np.cumsum(of[0][order]), k)) + 1)
                    chosen = order[:most] if first else order[most:][bound[order[most:]] >= floor - 1e-9]
                    ids += [name_id] * len(chosen)
                    met += chosen.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(met, pa.int64())], names=["left_id", "block"])

        return run

    def scored(floors: DataFrame, first: bool) -> DataFrame:
        """Pairs of the names with the blocks they look at, as far as they reach the floor; at most k photos' names of each."""
        pairs = floors.select("id", "norm", "tokens", "floor").mapInArrow(looked_at(first), "left_id long, block long")
        own = floors.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), F.col("norm").alias("left_norm"), F.col("tokens").alias("left_tokens"), "floor")
        names = blocks.select("block", F.col("name").alias("right_name"), F.col("norm").alias("right_norm"), F.col("tokens").alias("right_tokens"), "cand_seq")
        rows = with_name_score(pairs.join(own, "left_id").join(names, "block"), "left_tokens", "left_norm", "right_tokens", "right_norm")
        rows = rows.where(F.col("score") >= F.col("floor") - 1e-9)
        rows = rows.withColumn("j", F.row_number().over(Window.partitionBy("left_name").orderBy(F.desc("score"), "cand_seq"))).where(F.col("j") <= k)
        return scratch.write(rows.select("left_name", "right_name", "score", (F.col("left_norm") == F.col("right_norm")).alias("equal")), "far")

    def floors(pairs: DataFrame) -> DataFrame:
        """left with floor: what a photo has to score to be listed beside those known; below 0 if the list isn't full."""
        each = pairs.join(have, "right_name").withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("left_name").orderBy(F.desc("score"), "right_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
        last = each.groupBy("left_name").agg(F.max("score").alias("top"), F.when(F.sum("n") >= k, F.min("score")).alias("last"))
        needed = F.greatest(F.coalesce("last", F.lit(-1.0)), F.least(F.lit(float(least)), F.coalesce("top", F.lit(-1.0)) - gap))
        rows = left.join(last.withColumnRenamed("left_name", "__name"), F.col("name") == F.col("__name"), "left")
        return scratch.write(rows.withColumn("floor", needed).select("id", "name", "norm", "tokens", "floor"), "floors")

    near = found.unionByName(scored(floors(found), True)).distinct()
    near = scratch.write(near, "near")
    return near.unionByName(scored(floors(near), False)).distinct()
