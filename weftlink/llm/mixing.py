"""Operator 1: mixing sources to target weights by hash thresholds, found from histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, others, quoted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: The hash has 60 bits; a histogram goes by BITS of them.
HASH_BITS, BITS = 60, 12
#: Sources up to which a table of one row per source is broadcast, and the salts of a join beyond that.
BROADCAST_ROWS, SALTS = 10_000, 32


def n_words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(quoted(text_col)), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Column:
    """60 bits that depend on the row's id, source and text alone."""
    key = F.concat_ws("|", id_text(quoted(id_col)), F.coalesce(F.col(quoted(source_col)), F.lit("")), F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def join_source(rows: DataFrame, small: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Inner join on keys, nulls equal. `small` is broadcast if its rows are few, else the join is salted, as a source may hold most rows."""
    small = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on).drop(*[f"__{k}" for k in keys])
    salted = small.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return out.join(salted, [*on, F.col("__salt") == F.col("__t")]).drop("__salt", "__t", *[f"__{k}" for k in keys])


def targets(keys: DataFrame, shares: tuple[float, ...], weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(source, source_size, share, target, whole, rest) for each source and share, from keys (source, size).

    Sources by code point, null last, take the weights in turn. The level at which weight * level adds up to the share of
    all sizes, while no source exceeds repeats * its size, is read off the sources in the order in which they reach that cap.
    The windows without a key run over one row per source.
    """
    src = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", repeats * F.col("source_size")).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    every, before = Window.partitionBy("share"), Window.partitionBy("share").orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("share") * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    src = src.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    src = src.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    open_level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "turn", "level"))).over(every)["level"]
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long")
    return src.withColumn("whole", whole).select("source", "source_size", "share", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def thresholds(keys: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with `upto`: of each source, the rows whose hash is at most upto hold the words nearest to the rest.

    keys: (source, h, size). Sizes are summed by source and hash bucket; the bucket in which a rest is reached is refined by the
    next bits, and at last by whole hashes. Rows of other buckets are counted once, and none is sorted.
    """
    rows, bound = keys, goals.select("source", "share", "rest").withColumn("upto", F.lit(-1).cast("long"))
    for level in range(3):
        cell = F.shiftright("h", HASH_BITS - BITS * (level + 1)) if level < 2 else F.col("h")
        if level == 0:
            sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
            sums = join_source(sums, bound, ["source"], F.col("cell"))
        else:
            sums = rows.withColumn("cell", cell).groupBy("source", "share", "rest", "upto", "cell").agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source", "share").orderBy("cell"))
        sums = sums.withColumn("before", run - F.col("words"))
        if level == 2:
            inner = sums.where(F.col("before") + F.col("words") / 2 <= F.col("rest")).groupBy("source", "share").agg(F.max("cell").alias("inner"))
            break
        # the first bucket that reaches beyond the rest; where there is none, every row is in
        width = HASH_BITS - BITS * (level + 1)
        over = sums.where(F.col("before") + F.col("words") > F.col("rest")).groupBy("source", "share").agg(F.min(F.struct("cell", "before", "rest")).alias("b"))
        edge = materialize(over.select("source", "share", F.col("b.cell").alias("edge"), (F.col("b.rest") - F.col("b.before")).alias("rest"), (F.shiftleft("b.cell", width) - 1).alias("upto")), "edges")
        if level == 0:
            first = edge
        cells = join_source(keys.withColumn("edge", F.shiftright("h", width)), edge, ["source", "edge"], F.col("h"))
        rows = cells.select("source", "share", "rest", "upto", "h", "size")
        last = edge
    inner = materialize(inner, "thresholds")
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["share"] == b["share"])
    found = first.select("source", "share", F.col("upto").alias("coarse"))
    found = found.join(last.select("source", "share", F.col("upto").alias("fine")), same(found, last), "left").select(found["source"], found["share"], "coarse", "fine")
    found = found.join(inner, same(found, inner), "left").select(found["source"], found["share"], F.coalesce("inner", "fine", "coarse").alias("upto"))
    return goals.join(found, same(goals, found), "left").select(*[goals[c] for c in goals.columns], F.coalesce("upto", F.lit((1 << HASH_BITS) - 1)).alias("upto"))


def mix(docs: DataFrame, keys: DataFrame, shares: tuple[float, ...] = (SHARE,), weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """docs with source_size, and target and copies of the largest share; copies_by_share: of each share, the smaller ones nested.

    docs needs source, h (0 to 2**60 - 1) and size; keys has these three of the same rows and is read several times.
    A null source is a source of its own. Null or empty texts have size 0 and change nothing; a source of size 0 has target 0,
    and its rows are taken once.
    Rows that are equal in id, source and text share their hash and are taken or left together. An empty table gives no rows.
    Columns of docs with the names of new ones are replaced.
    """
    goals = materialize(targets(keys, shares, weights, repeats), "targets")
    bounds = materialize(thresholds(keys, goals), "mixture")
    wide = bounds.groupBy("source", "source_size").agg(F.max(F.struct("share", "target")).alias("top"), F.array_sort(F.collect_list(F.struct("share", "whole", "upto"))).alias("bounds"))
    new = ["source_size", "target", "copies", "copies_by_share"]
    out = join_source(docs.drop(*new, "top", "bounds"), wide, ["source"], F.col("h"))
    out = out.withColumn("copies_by_share", F.transform("bounds", lambda b: b["whole"] + F.when((F.col("h") <= b["upto"]) & (b["whole"] < repeats), 1).otherwise(0)))
    return out.withColumn("target", F.col("top.target")).withColumn("copies", F.element_at("copies_by_share", -1)).drop("top", "bounds")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs repeated as the mixture takes them: each row 0, 1 or 2 times; columns as before."""
    rows = docs.withColumn("h", mix_hash()).withColumn("size", n_words())
    keys = materialize(rows.select("source", "h", "size"), "sizes")
    own = len(others(docs.columns, ("h", "size", "copies", "source_size", "target", "copies_by_share", "top", "bounds"))) < len(docs.columns)
    named = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), "doc_id", "source", "text") if own else docs
    rows = named.withColumn("h", mix_hash()).withColumn("size", n_words())
    taken = mix(rows, keys).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("__row.*") if own else taken.select(*[F.col(quoted(c)) for c in docs.columns])
