"""Operator 4: WARC archives written and read as tables of records and chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

BREAK = b"\r\n\r\n"
#: Bytes of a block that one record holds; longer ones go on in continuation records.
CHUNK_BYTES = 1 << 18
#: A record is a gzip member, whose last byte is 0 as long as the record is shorter than 2**24 bytes. It is left to Spark's writer,
#: which puts it after each value.
MEMBER_END = b"\0"
#: Equal payloads from which on a group is joined without a shuffle; a 5,000th of all pages, if that is more, so that few groups can be.
HOT_COPIES, HOT_GROUPS = 10_000, 5000
#: Payloads from this size on are stored once; equal ones become revisits.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
CHUNKS = "file string, record_id string, page_id long, record_type string, refers_to long, chunk_no long, payload_bytes long, payload_digest string, last boolean, payload binary"


def header(**fields: object) -> bytes:
    lines = [f"{k.replace('_', '-')}: {' '.join(str(v).split())}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode()


def pieces(block: bytes, size: int) -> Iterator[bytes]:
    """Cut at most size bytes each, between characters; an empty block is one piece."""
    view, at = memoryview(block), 0
    while True:
        to = min(at + size, len(block))
        while to < len(block) and block[to] & 0xC0 == 0x80:
            to -= 1
        yield bytes(view[at:to])
        at = to
        if at >= len(block):
            return


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, chunk: int) -> Iterator[bytes]:
    """The WARC records of one page, each without the line breaks at its end."""
    name = f"<urn:page:{page_id}:{hashlib.sha1(f'{page_id} {url} {digest}'.encode()).hexdigest()}>"
    common = {"WARC_Date": DATE, "WARC_Target_URI": url, "X_Page_Id": page_id}
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield header(WARC_Type="revisit", WARC_Record_ID=name, **common, WARC_Profile=profile, WARC_Payload_Digest=f"sha1:{digest}", X_Refers_To_Page=refers_to, X_Payload_Bytes=size, Content_Length=0) + BREAK
        return
    block = HTTP + f"\r\nContent-Length: {len(payload)}".encode() + BREAK
    many, grown, written = len(payload) > chunk, hashlib.sha1(), 0
    for k, part in enumerate(pieces(payload, chunk)):  # one piece at a time, and never a second copy of the payload
        grown.update(part)
        written += len(part)
        last = written == len(payload)
        if last and base64.b32encode(grown.digest()).decode() != digest:
            raise ValueError(f"page {page_id}: the pieces don't add up to the payload")
        body = block + part if k == 0 else part
        if k == 0:
            head = header(WARC_Type="response", WARC_Record_ID=name, **common, WARC_Payload_Digest=f"sha1:{digest}", Content_Type="application/http; msgtype=response", WARC_Segment_Number=1 if many else None, Content_Length=len(body))
        else:
            total = len(block) + len(payload) if last else None
            head = header(WARC_Type="continuation", WARC_Record_ID=f"{name[:-1]}:{k + 1}>", WARC_Date=DATE, WARC_Segment_Origin_ID=name, WARC_Segment_Number=k + 1, WARC_Segment_Total_Length=total, Content_Length=len(body))
        yield head + BREAK + body


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own, without its last byte."""
    out = gzip.compress(record + BREAK, 6, mtime=0)
    if not out.endswith(MEMBER_END):
        raise ValueError("a record is too long for a gzip member")
    return out[:-1]


def marked(rows: DataFrame) -> DataFrame:
    """rows (page_id, sha1, size, ...) with top, the largest page_id of the rows with the same payload if there are several.

    Large groups of copies, an empty page's or an error page's, aren't brought together: their few digests are broadcast.
    """
    best = rows.groupBy(F.col("sha1").alias("s"), F.col("size").alias("b")).agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where(F.col("c") > 1)
    best = materialize(best, "copies")
    many = max(HOT_COPIES, rows.count() // HOT_GROUPS)
    hot, cold = best.where(F.col("c") > many).select("s", "b", "top"), best.where(F.col("c") <= many).select("s", "b", "top")
    same = (F.col("sha1") == F.col("s")) & (F.col("size") == F.col("b"))
    if hot.isEmpty():
        return rows.join(cold, same, "left").drop("s", "b")
    others = rows.join(F.broadcast(hot.drop("top")), same, "left_anti").join(cold, same, "left").drop("s", "b")
    return rows.join(F.broadcast(hot), same).drop("s", "b").unionByName(others)


def write_archives(pages: DataFrame, folder: str, chunk: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) into WARC files in folder, each record a gzip member.

    Of rows with equal payloads of at least revisit_bytes, those with the largest page_id are responses and the others
    revisits; a null id counts as the smallest, and if all are null, all are responses. A null html is an empty payload.
    Rows go as they come, repeated or not; an empty table writes files without pages. Columns but the three aren't read.
    A payload is a value of its row and so in memory once; it is written, and its digest checked, piece by piece.
    Spark's text writer writes the files, which the driver then names .warc.gz.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("body")).withColumn("sha1", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long"))
    rows = marked(rows)
    revisit = F.coalesce((F.col("size") >= revisit_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("body")).alias("body"), "sha1", "size", "top", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = b"software: weftlink\r\nformat: WARC File Format 1.1\r\n"
        out = [member(header(WARC_Type="warcinfo", WARC_Record_ID="<urn:weftlink:info>", WARC_Date=DATE, Content_Type="application/warc-fields", Content_Length=len(said)) + BREAK + said)]
        held = 0
        for batch in batches:
            for part in slices(batch, "body"):
                cols = [part.column(c) for c in ("page_id", "url", "body", "sha1", "size", "top", "revisit")]
                for k in range(len(part)):
                    page, url, body, sha1, size, top, again = (c[k].as_py() for c in cols)
                    for r in records(page, url, body or b"", base64.b32encode(bytes.fromhex(sha1)).decode(), size, top, again, chunk):
                        out.append(member(r))
                        held += len(out[-1])
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", MEMBER_END.decode()).option("maxRecordsPerFile", 100_000).text(folder)
    path = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for file in fs.listStatus(path):
        if file.getPath().getName().endswith(".txt"):
            fs.rename(file.getPath(), path.suffix("/" + file.getPath().getName().removesuffix(".txt") + ".warc.gz"))


class Reader:
    """Takes a WARC file's bytes part by part, and gives its payloads chunk by chunk with digests that grow along."""

    def __init__(self, file: str) -> None:
        self.file, self.phase, self.buffer, self.gap = file, "header", b"", 0
        self.fields: dict[str, str] = {}
        self.need, self.open = 0, None

    def feed(self, data: bytes, is_break: bool) -> Iterator[tuple]:
        while data:
            if self.phase == "gap":
                n = min(self.gap, len(data))
                self.gap, data = self.gap - n, data[n:]
                if not self.gap:
                    self.phase, self.buffer = "header", b""
            elif self.phase == "header":
                if is_break and self.buffer:
                    yield from self.begin()
                else:
                    self.buffer += data
                data = b""
            elif self.phase == "http":
                n = min(self.need, len(data))
                self.need -= n
                ended, data = is_break, data[n:]
                if ended or not self.need:
                    self.phase = "payload"
                    yield from self.close_block()
            else:
                n = min(self.need, len(data))
                self.need -= n
                yield self.chunk(data[:n])
                data = data[n:]
                yield from self.close_block()

    def begin(self) -> Iterator[tuple]:
        lines = self.buffer.decode("utf-8", "replace").split("\r\n")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.need = int(self.fields.get("content-length", 0))
        kind = self.fields.get("warc-type")
        if kind != "continuation":
            f = self.fields
            number = lambda k: int(f[k]) if f.get(k) else None
            self.open = {"id": f.get("warc-record-id"), "page": number("x-page-id"), "type": kind, "refers": number("x-refers-to-page"), "sha1": hashlib.sha1(), "bytes": 0, "no": 0, "said": f.get("warc-payload-digest", "").removeprefix("sha1:"), "size": number("x-payload-bytes")}
        self.phase = "http" if kind == "response" else "payload"  # a response's payload comes after its HTTP header
        yield from self.close_block()

    def chunk(self, data: bytes, last: bool = False) -> tuple:
        o = self.open
        o["sha1"].update(data)
        o["bytes"] += len(data)
        revisit = o["type"] == "revisit"
        digest = o["said"] if revisit else base64.b32encode(o["sha1"].digest()).decode()
        row = (self.file, o["id"], o["page"], o["type"], o["refers"] if revisit else None, o["no"], o["size"] if revisit else o["bytes"], digest, last, data)
        o["no"] += 1
        return row

    def close_block(self) -> Iterator[tuple]:
        if self.need:
            return
        self.phase, self.gap = "gap", len(BREAK)
        if "warc-segment-total-length" in self.fields or "warc-segment-number" not in self.fields:
            yield self.chunk(b"", last=True)


def read_chunks(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The archives in folder as rows of record and chunk number, in the columns CHUNKS.

    payload_bytes and payload_digest (base32 SHA-1) cover the record's payload up to and with the chunk; a record's last row has
    no bytes of its own and the whole record's values (a revisit's are those its header states). A warcinfo record has rows, too,
    without a page. No record of an archive of write_archives is held whole: what is read at a time reaches to the next empty line or
    the end of a record, which has at most the writer's chunk size. In an archive from elsewhere a long payload without an empty line
    comes as one piece. gzip files aren't split, so one task reads a file in order.
    """
    source = spark.read.option("lineSep", BREAK.decode()).text(folder).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        cols = [*cols[:-1], cols[-1] if with_payload else [None] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, held = None, [], 0
        for batch in batches:
            values, files = batch.column(0), batch.column(1)
            for k in range(len(batch)):
                file, data = files[k].as_py(), values[k].as_py()
                if reader is None or reader.file != file:
                    if reader:
                        out += reader.feed(BREAK, True)
                    reader = Reader(file)
                else:
                    out += reader.feed(BREAK, True)
                out += reader.feed(data, False)
                held += len(data)
                if held > 4 << 20:
                    yield table(out)
                    out, held = [], 0
        if reader:
            out += reader.feed(BREAK, True)
        yield table(out)

    return source.mapInArrow(run, CHUNKS)
