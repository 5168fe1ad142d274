"""The portrait run: whose photo, what is known of the face, where to cut, what to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import cached_or_due, fan_out, only_player
from ..sources.listing import photos_by_id


def portrait_jobs(players: DataFrame, listing: DataFrame, detections: DataFrame, sizes: DataFrame, variants: list[tuple], fmt: str = "jpg", only: str | None = None) -> DataFrame:
    """A row for each portrait to be made (see fan_out). listing: files; detections: path, found, face, left_eye, right_eye; sizes:
    path, image_w, image_h. Pictures of which nothing was detected are cut by the upper part."""
    mine = photos_by_id(only_player(players, only).select("PlayerId", "External_Player_ID"), listing)
    rows = mine.join(detections, "path", "left").join(sizes, "path", "left")
    return fan_out(rows.withColumn("found", F.coalesce("found", F.lit(False))), variants, fmt)


def portrait_report(jobs: DataFrame) -> DataFrame:
    """Counts by variant and status."""
    return jobs.groupBy("variant", "status").agg(F.count("*").alias("n"))


def due_pictures(spark: SparkSession, pictures: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Pictures to run a detector on: those without a valid entry in the cache."""
    return cached_or_due(pictures, cache, model).where("due").drop("landmarks", "due")
