"""Players and teams from SQL, CSV and file names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import full_name, is_blank
from ..operators.numbering import numbered
from ..schemas import PLAYERS, TEAMS

IDS = ("External_Player_ID", "ExternalId")


def folded(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns `names` that df has, in any case; null if it has none."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`").cast("string") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def as_players(rows: DataFrame, keep_flags: bool = False) -> DataFrame:
    """rows in the columns of a player, and FullName. Without keep_flags, ValidMapping and Confidence follow from the ID alone:
    true and 1.0 where there is one. Missing names are empty texts; seq, if rows has it, stays as the order of the input."""
    ident = folded(rows, IDS)
    given = ~is_blank(ident)
    have = {c.lower() for c in rows.columns}
    flags = [given, F.when(given, 1.0).otherwise(0.0)]
    if keep_flags:
        flags = [F.coalesce(folded(rows, ["ValidMapping"]).try_cast("boolean"), F.lit(False)), F.coalesce(folded(rows, ["Confidence"]).try_cast("double"), F.lit(0.0))]
    family, sur = (F.coalesce(folded(rows, [c]), F.lit("")) for c in ("FamilyName", "SurName"))
    ints = [folded(rows, [c]).cast("int").alias(c) for c in ("PlayerId", "TeamId")]
    seq = [F.col("seq")] if "seq" in have else []
    return rows.select(*ints, family.alias("FamilyName"), sur.alias("SurName"), ident.alias("External_Player_ID"), flags[0].alias("ValidMapping"), flags[1].alias("Confidence"), full_name(family, sur).alias("FullName"), *seq)


def as_teams(rows: DataFrame) -> DataFrame:
    name = F.coalesce(folded(rows, ["TeamName"]), F.lit(""))
    ident = folded(rows, ["TeamId"]).cast("int")
    safe = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")
    return rows.select(ident.alias("TeamId"), name.alias("TeamName"), F.concat(ident.cast("string"), F.lit(" - "), name).alias("DisplayName"), safe.alias("SafeTeamName"))


def sql_rows(spark: SparkSession, query: str, params: dict | None = None, jdbc: dict[str, str] | None = None, parts: tuple[str, int] | None = None, **tables: DataFrame) -> DataFrame:
    """A query's rows: over the session's tables, or tables given as {name}; or, with jdbc options, in the database.

    Parameters stand in the query as :name, @name or {name}, in any case; or as ?, one after another in the order of params. They stand
    for numbers and texts. parts: a column with numbers and how many partitions its range is read in; by default a database is
    read by one task.
    """
    if jdbc is None:
        return spark.sql(bound_query(query, params or {}), **tables)
    query = bound_query(query, params or {})
    reader = spark.read.format("jdbc").options(**jdbc)
    if parts is None:
        return reader.option("query", query).load()
    column, n = parts
    low, high = reader.option("query", f"SELECT MIN(q.{column}) AS low, MAX(q.{column}) AS high FROM ({query}) q").load().first()
    if low is None:  # no rows, or none with a number
        return reader.option("query", query).load()
    return spark.read.format("jdbc").options(**jdbc).option("dbtable", f"({query}) q").options(partitionColumn=column, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(n)).load()


#: What isn't looked into for parameters: texts, quoted names, comments, casts; then the parameters' forms.
MARKS = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|(?P<next>\?)|[:@](?P<name>[A-Za-z_]\w*)|\{(?P<braced>[A-Za-z_]\w*)\}""", re.DOTALL)


def bound_query(query: str, params: dict) -> str:
    """The query with the parameters' values in place of their marks; marks without a parameter stay, as {name} can be a table.
    More ? than parameters are an error."""
    values, order = {k.lower(): v for k, v in params.items()}, iter(params.values())

    def put(m: re.Match) -> str:
        name = (m["name"] or m["braced"] or "").lower()
        if m["next"]:
            return literal(next(order))
        return literal(values[name]) if name in values else m[0]

    try:
        return MARKS.sub(put, query)
    except StopIteration:
        raise ValueError("the query has more ? than parameters") from None


def literal(value: str | int | float | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, int | float):
        return "'" + str(value).replace("'", "''") + "'"
    return str(value)


def sql_players(spark: SparkSession, query: str, params: dict | None = None, jdbc: dict[str, str] | None = None, parts: tuple[str, int] | None = None, **tables: DataFrame) -> DataFrame:
    return as_players(sql_rows(spark, query, params, jdbc, parts, **tables))


def sql_teams(spark: SparkSession, query: str, params: dict | None = None, jdbc: dict[str, str] | None = None, parts: tuple[str, int] | None = None, **tables: DataFrame) -> DataFrame:
    return as_teams(sql_rows(spark, query, params, jdbc, parts, **tables))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV's rows as text, in columns named by its header, blank lines left out. Columns are matched by name, so the
    header may hold more, or other orders.

    seq grows in the order of the rows: of a folder's files by name, of a file's blocks by where they begin, of a block's rows as they come.
    Spark hands files to tasks by size; only within a block, which lies in one task, do its row numbers follow the file. A text
    may go on in the next line within quotes; files with such texts aren't split, so that each is read by one task.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=broken, escape='"', ignoreLeadingWhiteSpace=True)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    blocks = rows.select(*place).distinct().withColumn("__rank", F.row_number().over(Window.orderBy("__file", "__block")))
    rows = rows.select("*", *place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
    seq = F.shiftleft(F.col("__rank").cast("long"), 33) + F.col("__row")
    return rows.join(blocks, ["__file", "__block"]).withColumn("seq", seq).drop("__file", "__block", "__rank", "__row")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def csv_players(spark: SparkSession, path: str) -> DataFrame:
    return as_players(csv_rows(spark, path))


def csv_mapped(spark: SparkSession, path: str) -> DataFrame:
    """Earlier output with its own flags, in order; no rows if there is no such file."""
    if not exists(spark, path):
        return as_players(spark.createDataFrame([], PLAYERS).withColumn("seq", F.lit(0).cast("long")), keep_flags=True)
    return as_players(csv_rows(spark, path), keep_flags=True)


def last_by_player(rows: DataFrame) -> DataFrame:
    """Of rows with the same PlayerId the last in order (seq)."""
    last = rows.groupBy("PlayerId").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "PlayerId"]), "seq").alias("r"))
    return last.select("PlayerId", "r.*").select(*rows.columns)


def csv_teams(spark: SparkSession, path: str) -> DataFrame:
    return as_teams(csv_rows(spark, path))


def sample_teams(spark: SparkSession) -> DataFrame:
    """Made-up teams, for trying things out without a database. Readers never fall back to them by themselves."""
    return as_teams(spark.createDataFrame([(k, f"Team {k}") for k in range(1, 6)], TEAMS))


# The made-up players of the first team, and how many the next ones have.
FIRST_TEAM = ((1, "Rodríguez", "Sánchez"), (2, "Ramos", "Sergio"), (3, "Iniesta", "Andrés"))
TEAM_SIZES = {2: 10, 3: 25}


def stand_ins(teams: DataFrame) -> DataFrame:
    """Made-up players for each row of teams (TeamId): 3, 10 and 25 for the teams 1 to 3, else none."""
    fixed = F.array(*[F.struct(F.lit(k).alias("PlayerId"), F.lit(family).alias("FamilyName"), F.lit(sur).alias("SurName")) for k, family, sur in FIRST_TEAM])
    size = F.coalesce(*[F.when(F.col("TeamId") == t, n) for t, n in TEAM_SIZES.items()])
    first = teams.where("TeamId = 1").select(F.col("TeamId").cast("int").alias("TeamId"), F.explode(fixed).alias("p"))
    k = F.col("k").cast("string")
    more = teams.where(size.isNotNull()).select(F.col("TeamId").cast("int").alias("TeamId"), F.explode(F.sequence(F.lit(1), size)).alias("k"))
    each = first.unionByName(more.select("TeamId", F.struct(F.col("k").alias("PlayerId"), F.concat(F.lit("Family"), k).alias("FamilyName"), F.concat(F.lit("Sur"), k).alias("SurName")).alias("p")))
    return as_players(each.select("p.PlayerId", "TeamId", "p.FamilyName", "p.SurName"))


def sample_players(spark: SparkSession, team: int) -> DataFrame:
    """The made-up players of one team."""
    return stand_ins(spark.createDataFrame([(team,)], "TeamId int"))


def players_from_names(listing: DataFrame, first_is_sur: bool = False, base: int = 900_000_000) -> DataFrame:
    """Players made up from file names (path, name): the last word is the surname, or, first_is_sur, the first one.

    The number of a file among all files of its folder, images or not, gives the id, so ids have gaps.
    """
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"[_-]+", " "), r"\d+", ""))
    words = F.filter(F.split(stem, r"\s+"), lambda w: w != "")
    image = F.lower("name").rlike(r"\.(png|jpg|jpeg|bmp)$")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    rows = numbered(listing.select("path", "name", words.alias("w"), folder.alias("folder")), ["folder"], ["path"], "k").withColumn("k", F.col("k") - 1)
    rows = rows.where(image & (F.size("w") > 0))
    most = F.array_join(F.expr("slice(w, 1, greatest(size(w) - 1, 1))"), " ")
    rest = F.array_join(F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), " ")
    family, sur = (rest, F.col("w")[0]) if first_is_sur else (most, F.when(F.size("w") > 1, F.element_at("w", -1)).otherwise(F.lit("")))
    ident = F.regexp_extract("name", r"(\d+)", 1)
    return rows.select((base + F.col("k")).cast("int").alias("PlayerId"), family.alias("FamilyName"), sur.alias("SurName"), F.when(ident != "", ident).alias("External_Player_ID"), full_name(family, sur).alias("FullName"), "folder")


def first_with_rows(*choices: DataFrame) -> DataFrame:
    """The first of several sources that has rows; none is an error."""
    for rows in choices:
        if not rows.isEmpty():
            return rows
    raise ValueError("none of the sources has rows")


def reference_mapping(rows: DataFrame, id_col: str = "ExternalId") -> DataFrame:
    """Rows with a real external id: not blank and not 0."""
    return rows.where((F.coalesce(F.trim(id_col), F.lit("")) != "") & (F.trim(id_col) != "0"))
