"""Detections, caches and portrait jobs over tables of pictures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import aspect_trim, with_crop
from ..functions.rules import blank
from ..sources.documents import reusable
from ..storage import Scratch, written
from .numbering import numbered

OVERLAP, MOST_BOXES = 0.3, 5000
#: Boxes that are compared with each other and with the kept ones at a time.
BOXES_AT_ONCE = 256
#: Pictures of more boxes are cut into tiles; a tile is so many times as long as the shortest boxes of its level.
STREAMED_BOXES, TILE_SIDES = 100_000, 64
#: Boxes of a tile that are compared at a time.
TILE_BOXES_AT_ONCE = 128
BOX = ("x", "y", "width", "height")
DETECTORS = {"opencv-dnn": "opencv-dnn", "dnn": "opencv-dnn", "yolov8-face": "opencv-dnn", "opencv-yunet": "opencv-yunet", "yunet": "opencv-yunet", "haar-cascade": "haar-cascade", "haar": "haar-cascade", "apple-vision": "apple-vision", "vision": "apple-vision", "center": "center", "llava": "llava:7b", "llava:7b": "llava:7b", "qwen3-vl": "qwen3-vl:latest"}


def detector_chain(names: str) -> list[str]:
    """The detectors of a comma-separated list, by their own names, in order; unknown ones are models with a tag."""
    out = []
    for name in (n.strip() for n in names.split(",")):
        if name and name.lower() not in DETECTORS and ":" not in name:
            raise ValueError(f"unknown detector {name}")
        if name:
            out.append(DETECTORS.get(name.lower(), name))
    return out


def first_found(detections: DataFrame, chain: list[str], key: str = "path") -> DataFrame:
    """Of each picture's detections (key, detector, face_detected, error, ...) the first in the chain that found a face without an
    error; if none did, one row that says so."""
    rank = F.array_position(F.array(*[F.lit(c) for c in chain]), F.col("detector"))
    good = F.coalesce(F.col("face_detected"), F.lit(False)) & F.col("error").isNull() & (rank > 0)
    cols = [c for c in detections.columns if c != key]
    best = detections.groupBy(key).agg(F.min(F.when(good, F.struct(rank.alias("rank"), *cols))).alias("r"))
    return best.select(key, F.col("r").isNotNull().alias("found"), *[F.coalesce(F.col(f"r.{c}"), F.lit(False)).alias(c) if c == "face_detected" else F.col(f"r.{c}").alias(c) for c in cols])


def cached_or_due(pictures: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """pictures (path, length, modified) with the landmarks that the cache holds for just this file and model; due: to be detected.

    The last entry of a picture and model counts; one of another size or time, or that states a failure, doesn't.
    """
    low = lambda c: F.lower(F.col(c))
    mine = cache.where((low("Model") == model.lower()) & reusable(F.col("Landmarks"), F.col("Model")))
    mine = mine.groupBy(low("ImagePath").alias("__p")).agg(F.max_by(F.struct("FileSize", "LastModified", "Landmarks"), "LastModified").alias("__c"))
    rows = pictures.join(mine, low("path") == F.col("__p"), "left")
    valid = (F.col("__c.FileSize") == F.col("length")) & (F.col("__c.LastModified") == F.col("modified"))
    hit = F.coalesce(valid, F.lit(False))
    return rows.select(*[pictures[c] for c in pictures.columns], F.when(hit, F.col("__c.Landmarks")).alias("landmarks"), (~hit).alias("due"))


def detect(pictures: DataFrame, detector: Callable[[list[bytes]], pd.DataFrame], schema: str, key: str = "path", content: str = "content") -> DataFrame:
    """Run a detector over batches of pictures: it takes their bytes and gives a row for each, in the columns of schema."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.concat([f[[key]].reset_index(drop=True), detector([bytes(x) for x in f[content]]).reset_index(drop=True)], axis=1)

    return pictures.select(key, content).mapInPandas(run, f"{key} string, {schema}")


def clashes(a: np.ndarray, b: np.ndarray, overlap: float) -> np.ndarray:
    """Which boxes of a and b (rows x, y, width, height) overlap by `overlap` or more, as a matrix. A box with a null overlaps none."""
    x, y, w, h = (a[k][:, None] for k in range(4))
    u, v, p, q = (b[k][None, :] for k in range(4))
    inter = (np.minimum(x + w, u + p) - np.maximum(x, u)).clip(min=0) * (np.minimum(y + h, v + q) - np.maximum(y, v)).clip(min=0)
    union = w * h + p * q - inter
    return (union > 0) & (inter >= overlap * union)


class Strip:
    """Boxes (finite ones) in the order of x, of which others are compared only with those in their reach."""

    def __init__(self) -> None:
        self.boxes, self.widest = np.empty((4, 0)), 0.0

    def add(self, more: np.ndarray) -> None:
        if more.shape[1]:
            more = more[:, np.argsort(more[0], kind="stable")]
            self.boxes = np.insert(self.boxes, np.searchsorted(self.boxes[0], more[0]), more, axis=1)
            self.widest = max(self.widest, more[2].max())

    def overlapped(self, part: np.ndarray, overlap: float) -> np.ndarray:
        """Which boxes of part overlap one of these by `overlap` or more, as clashes() has it."""
        x, y, w, h = part
        slack = self.widest * 1e-6 + np.abs(x) * 1e-15
        first = np.searchsorted(self.boxes[0], x - self.widest - slack, "left")
        n = np.searchsorted(self.boxes[0], x + w + slack, "right") - first
        out, mine = np.zeros(len(x), bool), np.repeat(np.arange(len(x)), n)
        u, v, p, q = self.boxes[:, np.arange(len(mine)) + np.repeat(first - (np.cumsum(n) - n), n)]
        x, y, w, h = (c[mine] for c in (x, y, w, h))
        inter = (np.minimum(x + w, u + p) - np.maximum(x, u)).clip(min=0) * (np.minimum(y + h, v + q) - np.maximum(y, v)).clip(min=0)
        union = w * h + p * q - inter
        out[mine[(union > 0) & (inter >= overlap * union)]] = True
        return out


def suppress(boxes: DataFrame, key: str, overlap: float = OVERLAP, most: int = MOST_BOXES, stream: int = STREAMED_BOXES) -> DataFrame:
    """Of each picture's boxes (key, box_id, x, y, width, height, score) those that overlap no kept one of a higher score by `overlap`
    or more, at most `most` of a picture. Equal scores go by box_id, then by place and size; null scores come last.

    Spark sorts the boxes of a picture; they stream through a task, which holds a batch and the picture's kept boxes, however many
    there are of others. Pictures of more than `stream` boxes are cut into tiles instead (in_tiles), with the same result. With an
    overlap of 0 or less every box is in the way of all others, and pictures of any size stream.
    """
    rows = boxes.select(key, "box_id", "x", "y", "width", "height", "score")
    if overlap <= 0:
        return streamed(rows, key, overlap, most)
    large = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > stream)
    if large.isEmpty():
        return streamed(rows, key, overlap, most)
    large = written(large.select("__key"), "large")
    same = F.col(key).eqNullSafe(F.col("__key"))
    small = streamed(rows.join(large, same, "left_anti"), key, overlap, most)
    return small.unionByName(in_tiles(rows.join(large, same, "left_semi"), key, overlap, most))


def by_score() -> Column:
    return F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))


def side_arrays(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in BOX])


def streamed(rows: DataFrame, key: str, overlap: float, most: int) -> DataFrame:
    """suppress() by a stream of each picture's boxes, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = object(), np.empty((4, 0))
        for batch in batches:
            names = batch.column(key).to_pylist()
            box = side_arrays(batch)
            cuts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            taken: list[int] = []
            for first, end in zip(cuts, [*cuts[1:], len(names)], strict=False):
                if names[first] != at:
                    at, kept = names[first], np.empty((4, 0))
                for base in range(first, end, BOXES_AT_ONCE):
                    if kept.shape[1] >= most:
                        break
                    part = box[:, base : min(end, base + BOXES_AT_ONCE)]
                    free, own, mine = ~clashes(kept, part, overlap).any(0), clashes(part, part, overlap), []
                    for k in range(len(free)):
                        if free[k]:
                            mine.append(k)
                            free &= ~own[k]
                    mine = mine[: most - kept.shape[1]]
                    kept = np.concatenate([kept, part[:, mine]], 1)
                    taken += [base + k for k in mine]
            yield batch.take(pa.array(taken, pa.int64()))

    return rows.repartition(key).sortWithinPartitions(key, by_score().desc_nulls_last(), "box_id", *BOX).mapInArrow(run, rows.schema)


def in_tiles(rows: DataFrame, key: str, overlap: float, most: int) -> DataFrame:
    """suppress() for pictures of any number of boxes: tiles decide what they can, in rounds, until no box is open.

    Boxes that overlap by a share t differ in width and height by a factor of 1 / t at most. So boxes lie in levels by their longer
    side, each 1 / t times the one before, and in square tiles of their level by their centre; a box is sent to its own tile and to
    those of its level and the two beside it that have centres within its reach. A tile goes through its boxes, best first: one that
    a kept box overlaps goes; one of its own that no kept or open box overlaps is kept; all others stay open until the tiles beside
    have decided. A round is sent the open boxes and what was kept, for tiles with open boxes only. The best open box of a picture
    is always decided, and chains within a tile are decided at once: there are as many rounds as a chain of overlaps crosses borders.
    """
    scratch = Scratch(rows.sparkSession)
    ordered = rows.withColumn("__last", by_score().isNull()).withColumn("__down", F.lit(0.0) - by_score())
    places = numbered(ordered, [key], ["__last", "__down", "box_id", *BOX], "__place").select(*rows.columns, "__place")
    sides = {c: F.col(c).cast("double") for c in BOX}
    finite = lambda c: F.abs(c) < float("inf")
    whole = finite(sides["width"] * sides["height"])
    for at, side in (("x", "width"), ("y", "height")):
        whole = whole & finite(sides[at] + sides[side]) & (sides[at] + sides[side] > sides[at])
    places = scratch.write(places.withColumn("__whole", F.coalesce(whole, F.lit(False))), "places")
    lone = places.where("NOT __whole")  # overlap nothing, and are kept

    step = max(1.000001 / overlap, 2.0)
    level = F.floor(F.log(F.greatest("width", "height")) / math.log(step)).cast("int")
    spread = lambda at: F.lit(float(TILE_SIDES)) * F.pow(F.lit(step), at)
    middle = {"x": F.col("x") + F.col("width") / 2, "y": F.col("y") + F.col("height") / 2}
    tile = lambda c, at: F.floor(c / spread(at))
    still = places.where("__whole").select(F.col(key).alias("__key"), "__place", *[c.alias(n) for n, c in sides.items()], F.lit(False).alias("kept")).withColumn("level", level)
    still = still.withColumn("i", tile(middle["x"], F.col("level"))).withColumn("j", tile(middle["y"], F.col("level")))

    levels = [r[0] for r in places.where("__whole").select(level.alias("l")).distinct().collect()]  # two thousand at most, as sides are doubles

    def sent(live: DataFrame) -> DataFrame:
        """Boxes with every tile (l, p, q) of a level that has boxes that they can matter to; own: the one that decides them."""
        out = live.withColumn("l", F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)]))).where(F.col("l").isin(levels))
        for n, c, side in (("p", "x", "width"), ("q", "y", "height")):
            longest = F.least(F.col(side) * step, F.pow(F.lit(step), F.col("l") + 1))
            reach = (longest + F.col(side)) * 0.500001 + F.abs(middle[c]) * 1e-15  # of centres of such boxes, and a hair more
            out = out.withColumn(n, F.explode(F.sequence(tile(middle[c] - reach, F.col("l")), tile(middle[c] + reach, F.col("l")))))
        own = (F.col("l") == F.col("level")) & (F.col("p") == F.col("i")) & (F.col("q") == F.col("j")) & ~F.col("kept")
        return out.withColumn("own", own)

    taken, open_tiles, live = [], None, still
    try:
        while True:
            copies = sent(live)
            if open_tiles is not None:
                same = F.col("__key").eqNullSafe(F.col("__k")) & (F.col("l") == F.col("__l")) & (F.col("p") == F.col("__p")) & (F.col("q") == F.col("__q"))
                copies = copies.join(open_tiles, same, "left_semi")
            where = ("__key", "l", "p", "q")
            out = scratch.write(copies.repartition(*where).sortWithinPartitions(*where, "__place").mapInArrow(tile_decisions(overlap), still.schema), "round")
            taken.append(out.where("kept"))
            rest = out.where("NOT kept")
            if rest.isEmpty():
                break
            open_tiles = scratch.write(rest.selectExpr("__key AS __k", "level AS __l", "i AS __p", "j AS __q").distinct(), "open")
            live = reduce(DataFrame.unionByName, taken, rest)
        won = reduce(DataFrame.unionByName, taken).select("__key", F.col("__place").alias("__p"))
        good = places.join(won, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__place") == F.col("__p")), "left_semi").unionByName(lone)
        return written(numbered(good, [key], ["__place"], "__nth").where(F.col("__nth") <= most).select(*rows.columns), "boxes")
    finally:
        scratch.close()


def tile_decisions(overlap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by tile and place to the tiles' own boxes that are kept or still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, still = None, Strip(), Strip()
        for batch in batches:
            tiles = list(zip(*[batch.column(c).to_pylist() for c in ("__key", "l", "p", "q")], strict=True))
            box = side_arrays(batch)
            before, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kept", "own"))
            won, rows = before.copy(), []
            cuts = [k for k in range(len(tiles)) if k == 0 or tiles[k] != tiles[k - 1]]
            for first, end in zip(cuts, [*cuts[1:], len(tiles)], strict=False):
                if tiles[first] != at:
                    at, kept, still = tiles[first], Strip(), Strip()
                for base in range(first, end, TILE_BOXES_AT_ONCE):
                    part = box[:, base : min(end, base + TILE_BOXES_AT_ONCE)]
                    gone, unsure, each = kept.overlapped(part, overlap), still.overlapped(part, overlap), clashes(part, part, overlap)
                    new_kept, new_still = [], []
                    for k in range(part.shape[1]):
                        if before[base + k] or (own[base + k] and not gone[k] and not unsure[k]):
                            won[base + k] = True
                            new_kept.append(k)
                            gone |= each[k]
                        elif not gone[k]:
                            new_still.append(k)
                            unsure |= each[k]
                    kept.add(part[:, new_kept])
                    still.add(part[:, new_still])
                    rows += [base + k for k in (*new_kept, *new_still) if own[base + k]]
            kept_rows = batch.take(pa.array(rows, pa.int64()))
            at_kept = kept_rows.schema.get_field_index("kept")
            kept_rows = kept_rows.set_column(at_kept, "kept", pa.array(won[rows] if rows else [], pa.bool_()))
            yield kept_rows.select(["__key", "__place", *BOX, "kept", "level", "i", "j"])

    return run


def default_variant(variants: DataFrame) -> DataFrame:
    """The variant x200x300, or of that size, or else the first by place."""
    usual = (F.lower("key") == "x200x300") | ((F.col("width") == 200) & (F.col("height") == 300))
    return variants.orderBy((~usual).cast("int"), "place").limit(1)


def fan_out(players: DataFrame, variants: list[tuple], fmt: str = "jpg") -> DataFrame:
    """A row for each player and variant (key, width, height, folder, placeholder): where its portrait goes, where it is cut, and
    which variant is the base, the largest, from which the others are resized; all variants are made, equal sizes too.

    players: PlayerId, path (null: no photo), found, face, left_eye, right_eye, image_w, image_h. status: portrait; placeholder,
    if there is no photo and every variant has one; failed otherwise.
    """
    v = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(d).cast("string").alias("folder"), F.lit(p).cast("string").alias("placeholder")) for k, w, h, d, p in variants])
    base = max(variants, key=lambda x: x[1] * x[2])
    all_placed = all(x[4] and x[4].strip() for x in variants)
    status = F.when(F.col("path").isNotNull(), "portrait").when(F.lit(all_placed), "placeholder").otherwise("failed")
    rows = with_crop(players, base[1], base[2], left="left_eye", right="right_eye", width="image_w", height="image_h")
    crop = aspect_trim(F.col("crop"), base[1], base[2])
    rows = rows.withColumn("status", status).withColumn("crop", F.when(F.col("path").isNotNull(), crop)).withColumn("v", F.explode(v))
    name = F.concat(F.when(~blank(F.col("v.folder")), F.concat(F.col("v.folder"), F.lit("/"))).otherwise(""), F.col("PlayerId").cast("string"), F.lit(f".{fmt}"))
    source = F.when(F.col("path").isNotNull(), F.col("path")).when(F.col("status") == "placeholder", F.col("v.placeholder"))
    return rows.select("PlayerId", F.col("v.key").alias("variant"), "v.width", "v.height", (F.col("v.key") == base[0]).alias("is_base"), "status", source.alias("source"), "crop", name.alias("output"))


def only_player(players: DataFrame, ident: str | None) -> DataFrame:
    """Players with an id; of these, if ident is given, those whose PlayerId or external id it is, in any case."""
    rows = players.where(~blank(F.col("External_Player_ID")))
    if not ident:
        return rows
    same: Column = (F.col("PlayerId").cast("string") == ident) | (F.lower("External_Player_ID") == ident.lower())
    return rows.where(same)


def first_answers(attempts: DataFrame, key: str = "path", most: int = 3) -> DataFrame:
    """(key, attempt, response, error) of attempts (key, attempt from 1, response, error): each picture's first attempt that was answered,
    within the first `most`; without one the last of them, whose error stands. A null response wasn't answered; empty ones were."""
    tried = attempts.where(F.col("attempt") <= most)
    answered = F.col("response").isNotNull()
    best = F.min_by(F.struct("attempt", "response", "error"), F.struct((~answered).cast("int"), F.when(answered, F.col("attempt")).otherwise(-F.col("attempt"))))
    return tried.groupBy(key).agg(best.alias("b")).select(key, "b.attempt", "b.response", F.when(F.col("b.response").isNull(), F.col("b.error")).alias("error"))
