"""Results with what was there before: earlier output, manual edits, photos that are still free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import blank
from .matching import first_of

KEPT = ("External_Player_ID", "ValidMapping", "Confidence")


def merge_prior(players: DataFrame, prior: DataFrame, keys: tuple[str, ...] = ("PlayerId",)) -> DataFrame:
    """players with the id, flag and confidence of earlier output (one row per PlayerId, or per keys) where they have no id now;
    preserved tells where an earlier row was found, even if that had no id either."""
    old = prior.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*KEPT).alias("__old"))
    rows = players.join(old, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    use = (F.coalesce("External_Player_ID", F.lit("")) == "") & F.col("__old").isNotNull()
    out = rows.select(*[F.when(use, F.col("__old")[c]).otherwise(F.col(c)).alias(c) if c in KEPT else F.col(c) for c in players.columns], use.alias("preserved"))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of both tables' rows with equal keys the last by `by`; the new one of equals."""
    cols = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(F.col(by).alias("__by"), F.lit(0).alias("__new")).alias("__o"), *cols).unionByName(new.select(*keys, F.struct(F.col(by).alias("__by"), F.lit(1).alias("__new")).alias("__o"), *cols))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), "__o").alias("__r")).select(*keys, "__r.*").select(*old.columns)


def apply_manual(players: DataFrame, edits: DataFrame) -> DataFrame:
    """players with edits (PlayerId, External_Player_ID) put in: valid, and sure. A blank id is no edit."""
    new = edits.where(~blank(F.col("External_Player_ID"))).groupBy(F.col("PlayerId").alias("__id")).agg(F.max("External_Player_ID").alias("__ext"))
    rows = players.join(new, F.col("PlayerId") == F.col("__id"), "left")
    hit = F.col("__ext").isNotNull()
    put: dict[str, Column] = {"External_Player_ID": F.coalesce("__ext", "External_Player_ID"), "ValidMapping": hit | F.col("ValidMapping"), "Confidence": F.when(hit, 1.0).otherwise(F.col("Confidence"))}
    return rows.select(*[put.get(c, F.col(c)).alias(c) for c in players.columns])


def unmapped_players(players: DataFrame) -> DataFrame:
    return players.where(~F.coalesce("ValidMapping", F.lit(False)) | blank(F.col("External_Player_ID")))


def free_photos(photos: DataFrame, players: DataFrame) -> DataFrame:
    """Photos with an id that no valid player has, in any case."""
    used = players.where(F.coalesce("ValidMapping", F.lit(False)) & ~blank(F.col("External_Player_ID"))).select(F.lower("External_Player_ID").alias("__u"))
    return photos.where(~blank(F.col("external_id"))).join(used, F.lower("external_id") == F.col("__u"), "left_anti")


def photo_states(photos: DataFrame, players: DataFrame) -> DataFrame:
    """photos with the player of their id (the first) and state: matched, not_in_csv or no_id."""
    owner = first_of(players.where(~blank(F.col("External_Player_ID"))), F.lower("External_Player_ID"), "PlayerId")
    owner = owner.select(F.col("__key").alias("__o"), F.col("__first.PlayerId").alias("PlayerId"))
    rows = photos.join(owner, F.lower("external_id") == F.col("__o"), "left").drop("__o")
    return rows.withColumn("state", F.when(blank(F.col("external_id")), "no_id").when(F.col("PlayerId").isNotNull(), "matched").otherwise("not_in_csv"))


def without_photo(players: DataFrame, photos: DataFrame, blank_too: bool = False) -> DataFrame:
    """Players whose id no photo has; with blank_too also those without an id."""
    have = photos.where(~blank(F.col("external_id"))).select(F.lower("external_id").alias("__h"))
    missing = players.where(~blank(F.col("External_Player_ID"))).join(have, F.lower("External_Player_ID") == F.col("__h"), "left_anti")
    return missing.unionByName(players.where(blank(F.col("External_Player_ID")))) if blank_too else missing


def teams_with_folder(teams: DataFrame, folders: DataFrame, there: bool = True) -> DataFrame:
    """Teams whose name, made safe, is (or isn't) a folder's."""
    names = folders.select(F.lower("folder").alias("__f"))
    return teams.join(names, F.lower("SafeTeamName") == F.col("__f"), "left_semi" if there else "left_anti")
