"""The mapping run: players and photos to results, by id, by names, by a scorer; with earlier output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import number
from ..functions.rules import blank
from ..operators.matching import assigned, direct_matches, rankable, top_pairs, with_names
from ..operators.merging import merge_prior
from ..operators.reports import mapping_summary
from ..operators.scorers import Scorer, scorer_pass
from ..storage import Scratch, written


@dataclass(frozen=True)
class Run:
    results: DataFrame  # player_seq, PlayerId, external_id, path, confidence, threshold, method, model_used, pass, reason
    players: DataFrame  # the players with their ids, flags and confidences after the run
    summary: DataFrame
    usage: list[dict[str, int]]


RESULT = ["player_seq", "PlayerId", "cand_seq", "confidence", "method", "model_used", "pass", "reason"]


def map_players(players: DataFrame, photos: DataFrame, threshold: float = 0.8, scorer: Scorer | None = None, second_pass: bool = False, scorer_only: bool = False, prior: DataFrame | None = None, strict_id: bool = False, within: str | None = None, margins: bool = True) -> Run:
    """Match players (player_seq, PlayerId, TeamId, FullName, External_Player_ID, ValidMapping, Confidence) to photos (cand_seq,
    path, external_id, display_name), each photo to one player.

    First by id; players with an id that no photo has stay as they are. Then by names, in rounds; then, with a scorer, one pass or two
    over those who are left; names are normalised and meet once, for all of these. strict_id: an id goes to one player only, even if several photos have it. prior: earlier output, which
    keeps ids for players that have none now. Results say of everybody what came of it. within: a column of both, as TeamId: ids and names
    match, and earlier output is kept, within its values only; by names in rounds over all of them at once. It can't go with a scorer or strict_id.
    margins: whether reasons tell how far the second photo of a name is behind; if not, names that find their equal needn't be compared with all that
    are nearly the same, who gets what stays the same. A scorer needs them.
    """
    if within is not None and (scorer is not None or strict_id):
        raise ValueError("within can't go with a scorer or strict_id")
    if scorer is not None and not margins:
        raise ValueError("a scorer can't go without margins")
    direct = written(direct_matches(players, photos, within).select("player_seq", "PlayerId", "cand_seq", "method", "reason"), "direct")
    free = written(photos.join(direct.where("cand_seq is not null").select("cand_seq"), "cand_seq", "left_anti"), "free")
    if strict_id:
        used = photos.join(direct.select("cand_seq"), "cand_seq", "left_semi").select(F.lower("external_id").alias("__u"))
        free = rankable(free).join(used, F.lower("external_id") == F.col("__u"), "left_anti")
        free = free.join(free.groupBy(F.lower("external_id").alias("__i")).agg(F.min("cand_seq").alias("cand_seq")).select("cand_seq"), "cand_seq", "left_semi")
    scratch = Scratch(players.sparkSession)
    # dealt to all tasks, as tables of few bytes lie in few files
    open_ = scratch.write(with_names(players.where(blank(F.col("External_Player_ID"))).repartition("player_seq"), "FullName", within), "players")
    free = scratch.write(with_names(rankable(free).repartition("cand_seq"), "display_name", within), "photos")
    hit = F.col("method") == "DirectIdMatch"
    parts = [direct.select("player_seq", "PlayerId", "cand_seq", F.when(hit, 1.0).otherwise(0.0).alias("confidence"), "method", F.when(hit, "DirectIdMatch").alias("model_used"), F.lit(0).alias("pass"), "reason")]
    if not scorer_only:
        said = F.concat(F.lit("deterministic_score="), number(F.col("score")), *([F.lit(";margin="), number(F.col("margin"))] if margins else []))
        rows, known = assigned(open_, free, threshold, scratch, margins=margins)
        won = written(rows.select("player_seq", "cand_seq", F.col("score").alias("confidence"), said.alias("reason")), "named")
        parts.append(won.join(open_.select("player_seq", "PlayerId"), "player_seq").select("player_seq", "PlayerId", "cand_seq", "confidence", F.lit("AiNameMatching").alias("method"), F.lit("StringMatching").alias("model_used"), F.lit(0).alias("pass"), "reason"))
        open_, free = open_.join(won, "player_seq", "left_anti"), free.join(won, "cand_seq", "left_anti")
    elif scorer is not None:
        known = top_pairs(open_, free, scratch)
    usage, why = [], "No match" if scorer is None else "No AI match"
    for n in range(0 if scorer is None else 2 if second_pass else 1):
        done = scorer_pass(open_, free, scorer, threshold, n, known)
        usage.append(done.usage)
        if done.quota:
            why = "AI quota exhausted"
            break
        won = written(done.won, "scored")
        said = F.concat(F.lit("ai_confidence="), number(F.col("confidence")), F.lit(";margin="), number(F.col("margin")))
        parts.append(won.join(open_.select("player_seq", "PlayerId"), "player_seq").select("player_seq", "PlayerId", "cand_seq", "confidence", F.lit("AiNameMatching").alias("method"), F.lit(scorer.name).alias("model_used"), F.lit(n + 1).alias("pass"), said.alias("reason")))
        open_, free = open_.join(won, "player_seq", "left_anti"), free.join(won, "cand_seq", "left_anti")
    parts.append(open_.select("player_seq", "PlayerId", F.lit(None).cast("long").alias("cand_seq"), F.lit(0.0).alias("confidence"), F.lit("NoMatch").alias("method"), F.lit(None).cast("string").alias("model_used"), F.lit(0).alias("pass"), F.lit(why).alias("reason")))
    every = parts[0].select(*RESULT)
    for p in parts[1:]:
        every = every.unionByName(p.select(*RESULT))
    told = photos.select("cand_seq", "path", "external_id")
    results = written(every.join(told, "cand_seq", "left").withColumn("threshold", F.lit(float(threshold))), "results")
    scratch.close()
    found = results.where("cand_seq is not null").select("player_seq", F.col("external_id").alias("__ext"), F.col("confidence").alias("__conf"))
    after = players.join(found, "player_seq", "left")
    got = F.col("__ext").isNotNull()
    after = after.withColumn("External_Player_ID", F.coalesce("__ext", "External_Player_ID")).withColumn("ValidMapping", F.when(got, F.col("__conf") >= threshold).otherwise(F.col("ValidMapping")))
    after = after.withColumn("Confidence", F.coalesce("__conf", "Confidence")).drop("__ext", "__conf")
    if prior is not None:
        after = merge_prior(after, prior, ("PlayerId",) if within is None else (within, "PlayerId"))
    return Run(results, after, mapping_summary(results), usage)
