"""The entries of JSON documents of any size, each document read by many tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

#: A bracket, or a text; a text that a piece breaks off has no quote at its end.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("|\\?$)|[{\[\]]', re.S)
TEXT_END = re.compile(r'(?:[^"\\]|\\.)*("|\\?$)', re.S)
#: Characters of entries that a task hands on at a time.
HELD = 1 << 22
#: Bytes of documents that a task of the second pass reads, at least, if there are more than one for each core.
BLOCK_BYTES = 1 << 27


def tokens(piece: str, inside: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the brackets and texts in what comes before a closing brace; inside: it begins within a text.

    kind is the bracket; a quote for a text; `open` for a text that goes on behind the piece.
    """
    at = 0
    if inside:
        at = (m := TEXT_END.match(piece)).end()
        yield 0, at, '"' if m[1] == '"' else "open"
    for m in TOKEN.finditer(piece, at):
        yield m.start(), m.end(), m[0] if m[1] is None else '"' if m[1] == '"' else "open"


def effect(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a text goes on behind the piece, and by how much it changes the depth, its own brace at the end left out."""
    kinds = [kind for _, _, kind in tokens(piece, inside)]
    return kinds[-1:] == ["open"], sum(k in "{[" for k in kinds) - kinds.count("]")


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: pieces, bytes, and for both ways it can begin, outside or within a text, how it ends and changes the depth.
    bare: its depth if no brace ended its last piece."""
    at, got = None, {}
    for batch in batches:
        files, blocks, sizes, lengths, texts = (batch.column(c).to_pylist() for c in ("document", "block", "size", "length", "value"))
        for place, size, length, text in zip(zip(files, blocks, strict=True), sizes, lengths, texts, strict=True):
            s = got.setdefault(place, {"size": size, "n": 0, "bytes": 0, "ends": [False, True], "depth": [0, 0], "bare": [0, 0]})
            at = place
            s["n"], s["bytes"] = s["n"] + 1, s["bytes"] + length + 1
            for k in (0, 1):
                s["ends"][k], change = effect(text, s["ends"][k])
                s["bare"][k] = s["depth"][k] + change
                s["depth"][k] = s["bare"][k] - (not s["ends"][k])
        if len(got) > 1:  # a task's blocks come one after the other
            yield packed({k: v for k, v in got.items() if k != at})
            got = {at: got[at]}
    if got:
        yield packed(got)


SUMMARY = "document string, block long, size long, n long, bytes long, ends_0 boolean, ends_1 boolean, depth_0 long, depth_1 long, bare_0 long, bare_1 long"


def packed(got: dict) -> pa.RecordBatch:
    rows = [(*place, s["size"], s["n"], s["bytes"], *s["ends"], *s["depth"], *s["bare"]) for place, s in got.items()]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [c.split() for c in SUMMARY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def begins(blocks: DataFrame) -> DataFrame:
    """(document, block, inside, depth, bare, whole, bytes) of each block: how it begins, which of its pieces no brace ends (-1: none),
    whether its document closes all it opens, and how large that is.

    Whether a block begins within a text follows from the blocks before it: one whose two ways end alike settles it, all others
    keep or turn what they are given.
    """
    order = Window.partitionBy("document").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("ends_0") == F.col("ends_1")
    turns = ~settles & F.col("ends_0")
    rows = blocks.withColumn("__seen", F.sum(settles.cast("int")).over(order) - settles.cast("int"))
    # blocks since the last one that settled, and what that one said
    rows = rows.withColumn("__said", F.coalesce(F.last(F.when(settles, F.col("ends_0")), ignorenulls=True).over(before), F.lit(False)))
    since = Window.partitionBy("document", "__seen").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(turns.cast("int")).over(since), F.lit(0)) % 2 == 1
    rows = rows.withColumn("inside", F.col("__said") != turned)
    own = lambda name: F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    rows = rows.withColumn("depth", F.coalesce(F.sum(own("depth")).over(before), F.lit(0)))
    last = F.col("block") == F.max("block").over(Window.partitionBy("document"))
    rows = rows.withColumn("__bytes", F.sum("bytes").over(Window.partitionBy("document"))).withColumn("__ends", F.col("depth") + own("depth"))
    # sizes tell whether a brace is the last character; those of compressed files don't, of which the depth does
    bare = last & ((F.col("__bytes") == F.col("size") + 1) | ((F.col("__bytes") != F.col("size")) & (F.col("__ends") != 0)))
    whole = F.when(last, (F.when(bare, F.col("depth") + own("bare")).otherwise(F.col("__ends")) == 0) & ~own("ends"))
    rows = rows.withColumn("bare", F.when(bare, F.col("n") - 1).otherwise(-1)).withColumn("whole", whole)
    return rows.select("document", "block", "inside", "depth", "bare", F.max("whole").over(Window.partitionBy("document")).alias("whole"), F.col("__bytes").alias("bytes"))


PART = "document string, block long, n long, section string, kind string, text string"


def parts(level: int):
    """Pieces, a block's one after the other, to parts (PART): `entry`, what closes back to the level; `tail`, what is left when
    the level itself closes; `open`, what a block ends within; `outer`, all text above the level. `first` marks an entry or tail that
    goes on from the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, inside, depth, held, outer, section, n, row, on, size = None, False, 0, [], [], None, 0, 0, False, 0

        def emit(kind: str, text: str) -> None:
            nonlocal n, on, size
            out.append((*at, n, section, f"first {kind}" if on and kind != "outer" else kind, text))
            n, size, on = n + 1, size + len(text), on and kind == "outer"

        def ended() -> None:
            if at is not None:
                if outer:
                    emit("outer", "".join(outer))
                if depth >= level:
                    emit("open", "".join(held))

        def batch_of() -> pa.RecordBatch:
            nonlocal out, size
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in PART.split(", ")])
            out, size = [], 0
            return done

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("document", "block", "inside", "depth", "bare", "value")]
            for document, block, starts_inside, starts_deep, bare, piece in zip(*cols, strict=True):
                if (document, block) != at:
                    if starts_deep is None:
                        raise ValueError(f"{document} was cut into other blocks when it was read again")
                    ended()
                    at, inside, depth, held, outer, section, n, row = (document, block), starts_inside, starts_deep, [], [], None, 0, 0
                    on = depth >= level
                start, key, unfinished = 0, None, False
                for a, b, kind in tokens(piece, inside):
                    unfinished = kind == "open"
                    if kind == '"':
                        key = (a, b)
                    elif kind in ("{", "["):
                        depth += 1
                        if depth == level:
                            named = kind == "{" and key and piece[key[1] : a].strip() == ":" and piece[key[0]] == '"'
                            section = kind if level == 1 else json.loads(piece[slice(*key)], strict=False) if named else ""
                            outer.append(piece[start:b])
                            start, held = b, []
                    elif kind == "]":
                        if depth == level:
                            emit("tail", "".join([*held, piece[start:a]]))
                            start, held = a, []
                        depth -= 1
                inside = unfinished
                (held if depth >= level else outer).append(piece[start:])
                if row != bare:
                    closes = not inside
                    if closes and depth == level:
                        emit("tail", "".join(held))
                        held = []
                    depth -= closes
                    (held if depth >= level else outer).append("}")
                    if closes and depth == level:
                        emit("entry", "".join(held))
                        held = []
                row += 1
                if size > HELD:
                    yield batch_of()
        ended()
        yield batch_of()

    return run


def json_entries(spark: SparkSession, path: str, level: int) -> tuple[DataFrame, DataFrame]:
    """(entries, documents) of the JSON documents at path, which Spark reads in blocks, however large one is.

    entries (document, block, n, section, text): the members of the list or object at depth `level`, whose text is an object, or a
    pair of a name and an object; plain values beside them come with the next object, or by themselves at the end. With level 1
    section is the bracket of the document itself; with level 2 the name of the object that holds them, empty for a list.
    Members are in order of (block, n). documents (document, whole, bytes, outer): whether a document closes what it opens, its size, and
    its text without the members, which is short if they make up the document.

    Blocks are cut at closing braces. One pass sums up what each block does to depth and texts, from either state it can begin in;
    their running sums tell how each begins, which goes to all tasks (a short row for each block); a second pass reads the blocks again and
    cuts out the members, without a shuffle or a sort of the text. What blocks break apart is put together. A task holds one member at a
    time; each is to fit in memory.
    """
    at = [F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_block_start").alias("block")]
    pieces = spark.read.option("lineSep", "}").text(path).select(*at, F.col("_metadata.file_size").alias("size"), F.octet_length("value").cast("long").alias("length"), F.make_valid_utf8("value").alias("value"))
    starts = written(begins(written(pieces.mapInArrow(summaries, SUMMARY), "blocks")), "starts")
    placed = pieces.select("document", "block", "value").join(F.broadcast(starts), ["document", "block"], "left").select("document", "block", "inside", "depth", "bare", "value")
    # small blocks one after the other in a task, so that what is written lies in few files
    size = starts.select("document", "bytes").distinct().agg(F.sum("bytes")).first()[0] or 0
    cut = written(placed.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))).mapInArrow(parts(level), PART), "parts")

    order = Window.partitionBy("document").orderBy("block")
    # by section first, which takes no sort of a block's rows
    named = cut.where("section IS NOT NULL").groupBy("document", "block", "section").agg(F.max("n").alias("n")).groupBy("document", "block").agg(F.max_by("section", "n").alias("__named"))
    before = F.last("__named", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    said = starts.select("document", "block").join(named, ["document", "block"], "left").select("document", "block", before.alias("__before"))
    cut = cut.join(F.broadcast(said), ["document", "block"]).withColumn("section", F.coalesce("section", "__before")).drop("__before")

    edges = cut.where("kind LIKE '%open' OR kind LIKE 'first %'").withColumn("__closes", (~F.col("kind").endswith("open")).cast("int"))
    edges = edges.withColumn("__group", F.sum("__closes").over(Window.partitionBy("document").orderBy("block", "n")) - F.col("__closes"))
    place = F.struct("block", "n")
    joined = edges.groupBy("document", "__group").agg(F.min(place).alias("p"), F.min_by("section", place).alias("section"), F.max_by("kind", place).alias("kind"), in_order().alias("text"))
    joined = joined.select("document", "p.block", "p.n", "section", F.regexp_replace("kind", "^first ", "").alias("kind"), "text")
    whole_parts = cut.where("kind IN ('entry', 'tail')").select(*joined.columns).unionByName(joined.where("kind IN ('entry', 'tail')"))
    members = whole_parts.where((F.col("kind") == "entry") | (F.trim(F.regexp_replace("text", r"\s", " ")) != ""))
    entries = members.select("document", "block", "n", "section", F.regexp_replace("text", r"^\s*,?\s*", "").alias("text"))
    outer = cut.where("kind = 'outer'").groupBy("document").agg(in_order().alias("outer"))
    documents = starts.select("document", "whole", "bytes").distinct().join(outer, "document", "left")
    return entries, documents.withColumn("outer", F.trim(F.regexp_replace(F.coalesce("outer", F.lit("")), "^\ufeff", "")))


def in_order() -> Column:
    return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]))
