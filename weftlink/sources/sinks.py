"""Outputs: CSV and JSON tables, written by all executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAYER_COLUMNS = ("PlayerId", "TeamId", "FamilyName", "SurName", "External_Player_ID", "ValidMapping", "Confidence", "FullName")


def spelled(flag: Column) -> Column:
    """Booleans as True and False."""
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))


def mapped_name(input_path: str, folder: str = ".") -> str:
    stem = input_path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem[: stem.rfind(".")] if "." in stem else stem
    return f"{folder.rstrip('/')}/mapped_{stem}.csv"


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """Replace the table at path. single brings all rows into one file, for tables that people open."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_players(players: DataFrame, path: str, single: bool = False) -> None:
    rows = players.sort("seq") if "seq" in players.columns else players
    write_csv(rows.withColumn("ValidMapping", spelled(F.coalesce("ValidMapping", F.lit(False)))).select(*PLAYER_COLUMNS), path, single)


def write_teams(teams: DataFrame, path: str, single: bool = False) -> None:
    write_csv(teams.select("TeamId", "TeamName", "DisplayName", "SafeTeamName"), path, single)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def benchmark_path(folder: str, stamp: str) -> str:
    return f"{folder.rstrip('/')}/benchmark-{stamp}.json"


def write_cache(entries: DataFrame, changed: DataFrame, path: str) -> bool:
    """Write a cache's entries, but only if there is a change."""
    if changed.isEmpty():
        return False
    write_json(entries, path)
    return True


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A report of the first `most` rows as text; the table itself is for write_csv."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    for r in rows.limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "/").replace("\n", " ") for v in r) + " |")
    return "\n".join(lines) + "\n"
