"""Places within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def numbered(rows: DataFrame, keys: list[str], by: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 1, among the rows with equal keys (nulls equal) in the order of `by`.

    Rows are dealt by ranges of keys and `by`, so that a group that holds most rows lies in many ranges; a range counts its own
    rows and is shifted by what the ranges before it hold of the group. The ranges are written first, as they are read twice.
    """
    order = [F.col(c) for c in (*keys, *by)]
    parted = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    group = [F.col(k) for k in keys]
    counts = parted.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    window = Window.partitionBy(*group).orderBy("__range") if keys else Window.orderBy("__range")
    counts = counts.withColumn("__before", F.sum("__n").over(window) - F.col("__n")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), "__before")
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*by))
    return parted.withColumn("__own", own).join(counts, same).withColumn(name, F.col("__before") + F.col("__own")).drop("__own", "__range", "__r", "__before", *[f"__{k}" for k in keys])
