"""Runs over many teams: what is left to do, what each team came to, and how a session is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import teams_with_folder, unmapped_players
from ..schemas import PLAYERS
from ..sources.people import as_players, exists
from ..storage import written
from .mapping import map_players

#: What an output has of a player; TeamId is the folder's name.
OUTPUT = ("PlayerId", "FamilyName", "SurName", "External_Player_ID", "ValidMapping", "Confidence", "FullName")


def team_states(teams: DataFrame, players: DataFrame, folders: DataFrame, disabled: list[int] = (), failed: DataFrame | None = None) -> DataFrame:
    """(TeamId, team, status, message, extracted, mapped, unmapped_names) of each team after a run over all of them at once.

    Teams that are switched off, or have no folder of photos, are Skipped; those in failed (TeamId, message) Failed; all others
    Completed: one team's failure doesn't stop the others. Each team counts once.
    """
    count = players.groupBy("TeamId").agg(F.count("*").cast("int").alias("extracted"), F.count_if("ValidMapping").cast("int").alias("mapped"))
    names = unmapped_players(players).groupBy("TeamId").agg(F.array_sort(F.collect_set("FullName")).alias("unmapped_names"))
    there = teams_with_folder(teams, folders).select("TeamId").withColumn("__there", F.lit(True))
    wrong = failed.select("TeamId", F.col("message").alias("__wrong")) if failed is not None else teams.where("false").select("TeamId", F.lit("").alias("__wrong"))
    rows = teams.join(count, "TeamId", "left").join(names, "TeamId", "left").join(there, "TeamId", "left").join(wrong, "TeamId", "left")
    off = F.col("TeamId").isin(list(disabled)) if disabled else F.lit(False)
    status = F.when(off | F.col("__there").isNull(), "Skipped").when(F.col("__wrong").isNotNull(), "Failed").otherwise("Completed")
    message = F.when(off, "switched off").when(F.col("__there").isNull(), "no folder of photos").otherwise(F.coalesce("__wrong", F.lit("")))
    done = F.when(status == "Completed", F.coalesce("mapped", F.lit(0))).otherwise(0)
    return rows.select("TeamId", F.col("TeamName").alias("team"), status.alias("status"), message.alias("message"), F.coalesce("extracted", F.lit(0)).alias("extracted"), done.alias("mapped"), "unmapped_names")


def left_to_do(teams: DataFrame, outputs: DataFrame) -> DataFrame:
    """Teams and steps (extract, map, generate) without an output (TeamId, step) from earlier: where a run goes on."""
    steps = teams.select("TeamId", F.explode(F.array(*[F.lit(s) for s in ("extract", "map", "generate")])).alias("step"))
    return steps.join(outputs.select("TeamId", "step"), ["TeamId", "step"], "left_anti")


@dataclass(frozen=True)
class Batch:
    states: DataFrame  # TeamId, team, status, message, extracted, mapped, unmapped (how many): a row for each team
    output: DataFrame  # TeamId and OUTPUT, as it lies at the path after the run


def team_outputs(spark: SparkSession, path: str) -> DataFrame:
    """TeamId and OUTPUT of the players in the teams' outputs at path; no rows before there is one."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in PLAYERS if f.name in OUTPUT)}, FullName string, TeamId int"
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return rows.where("PlayerId is not null").select("TeamId", *OUTPUT)


def write_outputs(players: DataFrame, teams: DataFrame, path: str) -> None:
    """Replace the outputs of `teams` (TeamId) by their players, and leave all other teams' outputs as they are.

    A team without players has a row of nulls, which takes the place of what it had before. A team of very many rows goes to
    several tasks, and small teams share one.
    """
    empty = teams.select(F.col("TeamId").cast("int").alias("TeamId")).distinct().join(players.select("TeamId").distinct(), "TeamId", "left_anti")
    rows = players.join(teams.select("TeamId").distinct(), "TeamId", "left_semi").select("TeamId", *OUTPUT)
    rows = rows.unionByName(empty, allowMissingColumns=True)
    rows.hint("rebalance", "TeamId").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("TeamId").parquet(path)


def row_errors(rows: DataFrame) -> DataFrame:
    """(TeamId, message) of the teams with rows whose PlayerId isn't a whole number: the first of them, by its text, and how many more
    there are. Rows whose TeamId isn't one belong to no team, and are nobody's error."""
    wrong = rows.select(F.expr("try_cast(TeamId as int)").alias("TeamId"), F.col("PlayerId").cast("string").alias("p")).where("TeamId is not null and try_cast(p as int) is null")
    each = wrong.groupBy("TeamId").agg(F.min("p").alias("p"), F.count("*").alias("n"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(", and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return each.select("TeamId", F.concat(F.lit("PlayerId isn't a number: "), F.coalesce("p", F.lit("null")), more).alias("message"))


def run_teams(teams: DataFrame, rows: DataFrame, photos: DataFrame, path: str, disabled: list[int] = (), failed: DataFrame | None = None, threshold: float = 0.8, keep_prior: bool = False, skip_existing: bool = False) -> Batch:
    """Extract and map the players of all teams in one run, and put them down by team at path.

    teams: TeamId, TeamName, SafeTeamName, each team once; rows: players as texts (PlayerId, TeamId, names, ids); photos: folder, path,
    external_id, display_name, of which a team has those in the folder of its SafeTeamName, in any case. Ids and names match within teams;
    of equals the first, by seq where rows and photos have one, else as they come. Other columns are of no account.

    What goes wrong is data: a team that has rows which aren't players (row_errors), or that is in failed (TeamId, message; from steps
    before this one), is Failed, with its message, and keeps the output it had; all others go on. Teams that are switched off are
    Skipped before anything is read of them, teams without a folder after their players were. With keep_prior, players without an id
    keep the one of their team's output; with skip_existing, teams that have an output keep it as it is, and count as Completed.
    Null and empty names match nothing; rows without a team, and photos in no team's folder, belong to no output; no rows give states only.
    """
    spark = teams.sparkSession
    wrong = row_errors(rows)
    if failed is not None:
        wrong = wrong.unionByName(failed.select("TeamId", "message")).groupBy("TeamId").agg(F.min("message").alias("message"))
    folders = photos.select("folder").distinct()
    there = teams_with_folder(teams, folders).select("TeamId", F.lit(True).alias("there"))
    old = team_outputs(spark, path)
    had = old.select("TeamId", F.lit(skip_existing).alias("kept")).distinct()
    off = F.col("TeamId").isin(list(disabled)) if disabled else F.lit(False)
    state = teams.select("TeamId", F.col("TeamName").alias("team"), F.lower("SafeTeamName").alias("__folder")).join(wrong, "TeamId", "left").join(there, "TeamId", "left").join(had, "TeamId", "left")
    kept = F.coalesce("kept", F.lit(False))
    status = F.when(off, "Skipped").when(F.col("message").isNotNull() & ~kept, "Failed").when(F.col("there").isNull(), "Skipped").otherwise("Completed")
    told = F.when(off, "switched off").when(F.col("message").isNotNull() & ~kept, F.col("message")).when(F.col("there").isNull(), "no folder of photos").when(kept, "output was there").otherwise("")
    state = written(state.select("TeamId", "team", "__folder", status.alias("status"), told.alias("message"), off.alias("off"), kept.alias("kept")), "states")
    go = state.where("status = 'Completed' and not kept").select("TeamId", "__folder")

    whole = [F.expr(f"try_cast({c} as int)") for c in ("TeamId", "PlayerId")]
    players = as_players(rows.where(whole[0].isNotNull()).withColumns({"TeamId": whole[0], "PlayerId": whole[1]}))
    players = written(players.withColumn("player_seq", F.col("seq") if "seq" in players.columns else F.monotonically_increasing_id()), "extracted")
    place = F.col("seq") if "seq" in photos.columns else F.monotonically_increasing_id()
    shown = photos.select("folder", "path", "external_id", "display_name", place.alias("cand_seq")).join(go, F.lower("folder") == F.col("__folder"))
    shown = written(shown.drop("folder", "__folder"), "photos")
    ours = players.join(go, "TeamId", "left_semi")
    prior = old.groupBy("TeamId", "PlayerId").agg(F.max(F.struct("Confidence", "ValidMapping", "External_Player_ID")).alias("r")).select("TeamId", "PlayerId", "r.*") if keep_prior else None
    after = written(map_players(ours, shown, threshold, prior=prior, within="TeamId", margins=False).players.select("TeamId", *OUTPUT), "mapped")
    extracted = written(players.groupBy("TeamId").agg(F.count("*").alias("n")), "counts")
    write_outputs(after, go, path)

    output = team_outputs(spark, path)
    done = output.join(state.where("status = 'Completed'").select("TeamId"), "TeamId", "left_semi")
    mapped = done.groupBy("TeamId").agg(F.count("*").alias("rows"), F.count_if("ValidMapping").alias("mapped"))
    names = unmapped_players(done).groupBy("TeamId").agg(F.count("*").alias("unmapped"))
    states = state.join(extracted, "TeamId", "left").join(mapped, "TeamId", "left").join(names, "TeamId", "left")
    read = F.when(F.col("off") | (F.col("status") == "Failed"), 0).when(F.col("kept"), F.col("rows")).otherwise(F.coalesce("n", F.lit(0)))
    states = states.select("TeamId", "team", "status", "message", read.cast("int").alias("extracted"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("mapped", "unmapped")])
    return Batch(written(states, "states"), output)
