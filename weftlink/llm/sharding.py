"""Operator 5: sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, others, quoted

SHARDS = 16
SEED = 20_241
#: Rows that one window partition is meant to hold.
RUN = 50_000


def interleave(docs: DataFrame, shards: int = SHARDS, source_col: str = "source", tie: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """Append shard (0 to shards - 1) and slot (gapless from 0 in each shard) to docs.

    Rows are ranked within their source in the order of a seeded hash of `tie`; the rank over the source's size, the fractional
    rank, orders all rows, and the order is cut into shards whose counts differ by one at most, so that each shard holds each
    source in proportion. Neither a source nor the whole table is ranked in one task: rows are counted by runs of the hash, and
    then of the fractional rank, the counts are summed up, and only the rows of a run are numbered together.

    A null source is a source of its own; null ids and repeated rows are ranked like others (equal rows are interchangeable).
    Equal texts go their own ways: they are ranked like any rows, and so spread evenly over the shards.
    An empty table gives no rows. Columns of docs named shard or slot are replaced. `tie` should tell all rows apart.
    """
    kept = others(docs.columns, ("shard", "slot"))
    total = docs.count()
    bits = min(40, max(6, math.ceil(math.log2(max(total, 1) / RUN))))
    src, ties = F.col(quoted(source_col)), [F.col(quoted(c)) for c in tie]
    rows = docs.select(*[F.col(quoted(c)) for c in kept]).withColumn("__h", seeded_hash(seed, ties)).withColumn("__run", F.shiftright("__h", 60 - bits))
    runs = rows.groupBy(src.alias("__s"), F.col("__run").alias("__r")).agg(F.count("*").alias("__n"))
    by_source = Window.partitionBy("__s")
    runs = runs.withColumn("__before", F.sum("__n").over(by_source.orderBy("__r")) - F.col("__n")).withColumn("__all", F.sum("__n").over(by_source))
    rows = rows.join(runs, src.eqNullSafe(F.col("__s")) & (F.col("__run") == F.col("__r")))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__s", "__run").orderBy("__h", *ties))
    rows = rows.withColumn("__f", (rank - 0.5) / F.col("__all")).withColumn("__run", F.floor(F.col("__f") * (1 << bits)))
    rows = materialize(rows.select(*[F.col(quoted(c)) for c in kept], "__h", "__f", "__run"), "ranks")
    runs = rows.groupBy(F.col("__run").alias("__r")).agg(F.count("*").alias("__n"))
    runs = runs.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__run").orderBy("__f", src, "__h", *ties)) - 1
    rows = rows.join(runs, F.col("__run") == F.col("__r")).withColumn("__place", place)
    rows = rows.withColumn("shard", F.expr(f"cast(__place * {shards} div {max(total, 1)} as int)"))
    return rows.withColumn("slot", F.expr(f"__place - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).select(*[F.col(quoted(c)) for c in kept], "shard", "slot")


def seeded_hash(seed: int, ties: list[Column]) -> Column:
    """60 bits of an MD5 over the seed and the columns as texts; null counts as the empty text."""
    whole = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in ties])
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def byte_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(quoted(text_col))), F.lit(0)) + 1).cast("long")


def text_crc(text_col: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary"))
