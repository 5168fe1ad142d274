"""JSON and small CSV inputs: manifests, benchmark results, caches, size profiles, configuration layers, test pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BENCHMARK, CACHE_ENTRY, MANIFEST, VARIANT
from ..storage import written
from .json_parts import json_entries
from .people import exists

#: Bytes of manifests whose entries one task sorts by file name.
TASK_BYTES = 1 << 25
ID_SPELLINGS = ("External_Player_ID", "external_player_id", "externalId", "ExternalId", "id")


def manifest_entries(text: Column) -> Column:
    """The map of file names to entries in a manifest's JSON text; empty if it lists no photos, an error if it is no JSON."""
    entries = F.from_json(text, T.StructType([T.StructField("photos", MANIFEST)]), {"mode": "FAILFAST"})["photos"]
    return F.coalesce(entries, F.create_map().cast(MANIFEST))


def manifest_rows(texts: DataFrame, col: str = "value") -> DataFrame:
    """(file, external_id, full_name, family_name, sur_name, team_id) of each photo that the manifests list."""
    return photo_rows(texts.select(F.explode(manifest_entries(F.col(col))).alias("file", "e")))


def photo_rows(rows: DataFrame, *more: str) -> DataFrame:
    get = lambda k: F.element_at("e", k)
    full = F.coalesce(get("fullName"), F.nullif(F.concat_ws(" ", get("familyName"), get("surName")), F.lit("")))
    return rows.select(*more, "file", F.coalesce(*[get(k) for k in ID_SPELLINGS]).alias("external_id"), full.alias("full_name"), get("familyName").alias("family_name"), get("surName").alias("sur_name"), get("teamId").try_cast("int").alias("team_id"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What manifests of any size list, as manifest_rows; of a file that one names twice the last entry counts. A malformed one is an error."""
    entries, found = json_entries(spark, path, 2)
    said = F.from_json("outer", "map<string,string>")
    bad = ~F.col("whole") | (~F.col("outer").isin("", "null") & said.isNull())
    seen = found.agg(F.min(F.when(bad, F.col("document"))).alias("bad"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if seen.bad:
        raise ValueError(f"malformed manifest: {seen.bad}")
    pairs = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), MANIFEST, {"mode": "FAILFAST"})
    rows = entries.where("section = 'photos'").select("document", F.struct("block", "n").alias("at"), F.explode(pairs).alias("file", "e"))
    rows = photo_rows(rows, "document", "at")
    tasks = max(spark.sparkContext.defaultParallelism, -(-seen.bytes // TASK_BYTES))
    return rows.repartition(tasks, "document", "file").groupBy("document", "file").agg(F.max_by(F.struct(*rows.columns[3:]), "at").alias("r")).select("file", "r.*")


def benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=BENCHMARK, multiLine=True, mode="FAILFAST")


def reusable(landmarks: Column, model: Column) -> Column:
    """A cached detection can be used again if it states no failure, and its model is the one asked for or not stated."""
    failed = F.exists(F.coalesce(F.map_keys(landmarks["metadata"]), F.array().cast("array<string>")), lambda k: k.isin("error", "exception", "parse_error", "validation_error"))
    used = F.lower(F.coalesce(F.trim(landmarks["model_used"]), F.lit("")))
    return ~failed & ((used == "") | (used == F.lower(model)))


def face_cache(spark: SparkSession, path: str) -> DataFrame:
    """The reusable entries of a cache of any size, a list of objects; without a file, or from one that isn't such JSON, none."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE_ENTRY)
    entries, found = json_entries(spark, path, 1)
    fields = T.StructType([*CACHE_ENTRY.fields, T.StructField("__bad", T.StringType())])
    rows = written(entries.select("document", F.from_json("text", fields, {"columnNameOfCorruptRecord": "__bad"}).alias("e")), "entries")
    good = found.where(F.col("whole") & F.col("outer").rlike(r"^\[\s*\]$")).select("document")
    good = good.join(rows.where("e IS NULL OR e.__bad IS NOT NULL"), "document", "left_anti")
    rows = rows.join(good, "document", "left_semi").select("e.*").select(*CACHE_ENTRY.names)
    return rows.where(F.col("ImagePath").isNotNull() & F.col("Landmarks").isNotNull()).where(reusable(F.col("Landmarks"), F.col("Model")))


def plain_json(text: str) -> object:
    """JSON with comments and commas at the end of lists."""
    text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text))


def size_profile(spark: SparkSession, path: str) -> DataFrame:
    """The variants of a size profile, keys in any case, checked: at least one, each with a key of its own and a positive size."""
    said = plain_json(spark.read.text(path, wholetext=True).first()[0])
    low = {k.lower(): v for k, v in said.items()}
    variants = [{k.lower(): v for k, v in x.items()} for x in low.get("variants") or []]
    keys = [(x.get("key") or "").strip().lower() for x in variants]
    if not variants or "" in keys or len(set(keys)) < len(keys):
        raise ValueError("a size profile needs variants, each with a key of its own")
    if any((x.get("width") or 0) <= 0 or (x.get("height") or 0) <= 0 for x in variants):
        raise ValueError("a variant's width and height are positive")
    return spark.createDataFrame([(x["key"], x["width"], x["height"], x.get("outputsubfolder"), x.get("placeholderpath")) for x in variants], VARIANT)


def layered(*layers: dict) -> dict:
    """Settings of several files, the later ones on top, section by section."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def first_section(layers: Sequence[dict], name: str) -> object | None:
    """A section from the first file that has it."""
    return next((x[name] for x in layers if name in x), None)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def name_pairs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(name1, name2, expected) from the first of the files that is there; without one, four made-up pairs. Bad flags are errors."""
    path = first_existing(spark, paths)
    if path is None:
        made = [("Rodríguez Sánchez", "Rodriguez Sanchez", True), ("Ramos Sergio", "Sergio Ramos", True), ("Iniesta Andrés", "Torres Fernando", False), ("Smith John", "Doe Jane", False)]
        return spark.createDataFrame(made, "name1 string, name2 string, expected boolean")
    rows = spark.read.text(path).select(F.split("value", ",").alias("p"), F.monotonically_increasing_id().alias("k"))
    rows = rows.where((F.size("p") >= 3) & (F.lower(F.trim(F.col("p")[2])) != "expectedmatch"))
    return rows.select(F.trim(F.col("p")[0]).alias("name1"), F.trim(F.col("p")[1]).alias("name2"), F.trim(F.col("p")[2]).cast("boolean").alias("expected"))


def expected_faces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, faces) from the first of the files that is there; rows that aren't numbers are left out, the last of a file counts."""
    path = first_existing(spark, paths)
    if path is None:
        return spark.createDataFrame([], "file string, faces int")
    rows = spark.read.csv(path, schema="file string, faces string").withColumn("k", F.monotonically_increasing_id())
    rows = rows.select(F.trim("file").alias("file"), F.trim("faces").try_cast("int").alias("faces"), "k").where("file is not null and faces is not null")
    return rows.groupBy("file").agg(F.max_by("faces", "k").alias("faces"))


def with_expected_faces(listing: DataFrame, expected: DataFrame, top: str, default: int = 1) -> DataFrame:
    """listing (path, name) with the faces expected: by file name, else by path below `top`, else below a folder FaceDetection, else default."""
    short = F.expr(f"substring(path, position({top!r} in path) + {len(top) + 1})")
    rows = listing.withColumn("__rel", short).withColumn("__face", F.concat(F.lit("FaceDetection/"), F.regexp_extract("path", r"FaceDetection/(.*)$", 1)))
    for k, key in enumerate(("name", "__rel", "__face")):
        one = expected.select(F.col("file").alias(f"__f{k}"), F.col("faces").alias(f"__n{k}"))
        rows = rows.join(one, F.col(key) == F.col(f"__f{k}"), "left").drop(f"__f{k}")
    return rows.withColumn("expected_faces", F.coalesce("__n0", "__n1", "__n2", F.lit(default))).drop("__n0", "__n1", "__n2", "__rel", "__face")
