"""Photo files: listings, lookups by id, names that carry ids, and image headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filenames import auto_detect, best_record, stem, with_template
from ..functions.text import display_name
from ..operators.numbering import numbered
from ..storage import written

IMAGES = ("png", "jpg", "jpeg", "bmp")

#: Bytes of an image that are looked at first.
HEAD = 1 << 16


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, name, depth, length, modified) of every file that isn't empty; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    inner = F.expr("substring(path, position(:top in path) + length(:top) + 1)".replace(":top", repr(folder.rstrip("/").removeprefix("file://"))))
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), (F.size(F.split(inner, "/")) - 1).alias("depth"), "length", "modified")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def images(listing: DataFrame, kinds: tuple[str, ...] = IMAGES) -> DataFrame:
    return listing.where(extension(F.col("name")).isin(*kinds))


def merged_listings(*listings: DataFrame) -> DataFrame:
    """Files of several folders, each path once whatever its case, with webp among the images."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    least = out.groupBy(F.lower("path").alias("__k")).agg(F.min_by(F.struct(*out.columns), "path").alias("r")).select("r.*")
    return images(least, (*IMAGES, "webp"))


def photos_by_id(ids: DataFrame, listing: DataFrame, id_col: str = "External_Player_ID", prefixed: bool = False) -> DataFrame:
    """ids with the photo of each: a file named by the id in the top folder, else one whose name ends in _id, anywhere;
    with prefixed also one that begins with id_. The first path wins; without a photo path is null.

    Keys are taken from the names, so that this is an equality join however many files there are.
    """
    kept = images(listing).withColumn("s", stem(F.col("name")))
    choices = [
        F.when(F.col("depth") == 0, F.struct(F.col("s").alias("key"), F.lit(1).alias("rank"))),
        F.when(F.col("s").contains("_"), F.struct(F.regexp_extract("s", r"_([^_]*)$", 1).alias("key"), F.lit(2).alias("rank"))),
    ]
    if prefixed:
        choices.append(F.when(F.col("s").contains("_"), F.struct(F.regexp_extract("s", r"^([^_]*)_", 1).alias("key"), F.lit(3).alias("rank"))))
    keyed = kept.select("path", F.explode(F.filter(F.array(*choices), lambda x: x.isNotNull())).alias("k")).select("path", "k.key", "k.rank")
    first = keyed.groupBy("key").agg(F.min(F.struct("rank", "path")).alias("first"))
    return ids.join(first, ids[id_col] == first["key"], "left").select(*[ids[c] for c in ids.columns], F.col("first.path").alias("path"))


def photo_records(listing: DataFrame, template: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """(path, name, cand_seq, metadata, display_name) of each file: what the manifest, the template or the layouts say of its name.

    cand_seq, the order of candidates, is a row's place by path. Files that no rule fits stay, without id and names.
    """
    rows = listing.select("path", "name")
    none = F.lit(None).cast("struct<external_id:string,full_name:string,family_name:string,sur_name:string,source:string,pattern_used:string>")
    known = none
    if manifest is not None:
        listed = manifest.select(F.col("file").alias("__file"), F.struct(*[F.col(c) for c in ("external_id", "full_name", "family_name", "sur_name")], F.lit("Manifest").alias("source"), F.lit(None).cast("string").alias("pattern_used")).alias("__listed"))
        rows, known = rows.join(listed, rows["name"] == listed["__file"], "left"), F.col("__listed")
    by_template = with_template(F.col("name"), template) if template else none
    rows = rows.withColumn("metadata", best_record(known, by_template, auto_detect(F.col("name"))))
    shown = display_name(F.col("metadata.full_name"), stem(F.col("name")))
    return numbered(rows.select("path", "name", "metadata", shown.alias("display_name")), [], ["path"], "cand_seq")


def photo_names(listing: DataFrame) -> DataFrame:
    """(external_id, photo_name) from names like Last_First_123; of several files with an id the last path counts."""
    s = stem(F.col("name"))
    found = images(listing, ("png", "jpg", "jpeg", "bmp")).where(s.rlike(r"_\d+$"))
    rows = found.select(F.regexp_extract(s, r"_(\d+)$", 1).alias("external_id"), F.translate(F.regexp_extract(s, r"^(.*)_\d+$", 1), "_", " ").alias("photo_name"), "path")
    return rows.groupBy("external_id").agg(F.max_by("photo_name", "path").alias("photo_name"))


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG's or a JPEG's header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
        elif 0xC0 <= data[at + 1] <= 0xC3:
            high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
            return wide, high
        elif data[at + 1] == 0xFF:
            at += 1
        elif data[at + 1] in (0x01, *range(0xD0, 0xDA)):
            at += 2
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, width, height) of the images below folder; null where the header isn't one of a PNG or JPEG.

    A JPEG's size may stand behind other segments, of any length: files whose first HEAD bytes don't tell are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [header_size(x.as_py() or b"") or (None, None) for x in batch.column("head")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], names=["path", "length", "width", "height"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.where(F.lower("path").rlike(r"\.(png|jpg|jpeg|bmp)$"))
    kinds = "path string, length long, width int, height int"
    told = written(rows.select("path", "length", F.substring("content", 1, HEAD).alias("head")).mapInArrow(run, kinds), "sizes")
    untold = F.col("width").isNull() & (F.col("length") > HEAD)
    whole = rows.join(told.where(untold).select("path"), "path", "left_semi").select("path", "length", F.col("content").alias("head"))
    return told.where(~untold).unionByName(whole.mapInArrow(run, kinds))


def content_hashes(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """(run, id, digest) of each file below folder, id from its name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.lit(run).alias("run"), stem(F.regexp_extract("path", r"([^/]*)$", 1)).alias("id"), F.sha2("content", 256).alias("digest"))
