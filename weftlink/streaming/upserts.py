"""Tables that are kept up to date by a stream: each batch of rows is put into a keyed table, of which only what it touches is rewritten.

Keys lie in hash buckets. A batch writes the buckets it touches anew, as data/version=N/bucket__=K, and then a manifest, N, of each
bucket's version; what the last two manifests don't name is removed. The manifest is as long as there are buckets, whatever the rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merging import upsert
from ..storage import Scratch

#: Buckets of a new table; one that is there keeps its number.
BUCKETS = 64


class Store:
    """The files of a table at folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *filter(None, parts))))

    def names(self, *parts: str) -> list[str]:
        where = self.path(*parts)
        return [x.getPath().getName() for x in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("manifest") if n.endswith(".json"))

    def manifest(self, number: int | None) -> dict:
        """buckets, how many there are, and versions, of those that have rows; an empty table's, if there is none."""
        if number is None:
            return {"buckets": BUCKETS, "versions": {}}
        stream = self.fs.open(self.path("manifest", f"{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_manifest(self, number: int, manifest: dict) -> None:
        """Written aside, then renamed, so that readers see all of it or nothing."""
        aside = self.path("manifest", f"{uuid.uuid4().hex}.part")
        stream = self.fs.create(aside)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not self.fs.rename(aside, self.path("manifest", f"{number}.json")):
            raise OSError(f"manifest {number} of {self.folder} can't be put in place")

    def rows(self, versions: dict[str, int], schema) -> DataFrame:
        places = [f"{self.folder}/data/version={v}/bucket__={k}" for k, v in versions.items()]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def clean(self) -> None:
        """Remove what the last two manifests don't name: the last one's readers, and a batch that runs again, need no more."""
        numbers = self.manifests()
        named = {(v, k) for n in numbers[-2:] for k, v in self.manifest(n)["versions"].items()}
        for version in self.names("data"):
            v = int(version.split("=")[1])
            kept = [k for k in self.names("data", version) if k.startswith("bucket__=") and (v, k.split("=")[1]) in named]
            for k in self.names("data", version):
                if k.startswith("bucket__=") and k not in kept:
                    self.fs.delete(self.path("data", version, k), True)
            if not kept:
                self.fs.delete(self.path("data", version), True)
        for n in numbers[:-2]:
            self.fs.delete(self.path("manifest", f"{n}.json"), False)


def current(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the last manifest; none before there is one. They stay readable while one more batch is put in."""
    store = Store(spark, folder)
    return store.rows(store.manifest(max(store.manifests(), default=None))["versions"], schema)


def put_batch(batch: DataFrame, folder: str, number: int, keys: list[str], by: str) -> list[int]:
    """Put the batch's rows into the table: of equal keys the last by `by`; the buckets that were rewritten.

    Batches have growing numbers. One that is there already isn't put in again; one that failed on its way is, from the same rows before
    it, so that no row counts twice. Null keys are keys like others. A batch without rows changes nothing.
    """
    spark = batch.sparkSession
    store, scratch = Store(spark, folder), Scratch(spark)
    numbers = store.manifests()
    if number in numbers:
        return []
    before = store.manifest(max((n for n in numbers if n < number), default=None))

    def bucket() -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(before["buckets"])).cast("int")

    last = scratch.write(upsert(batch.where("false"), batch, keys, by), "batch")
    touched = sorted(r[0] for r in last.select(bucket()).distinct().collect())
    if touched:
        old = store.rows({str(k): before["versions"][str(k)] for k in touched if str(k) in before["versions"]}, batch.schema)
        rows = upsert(old, last, keys, by).withColumn("bucket__", bucket())
        rows.hint("rebalance", "bucket__").write.mode("overwrite").partitionBy("bucket__").parquet(f"{folder}/data/version={number}")
    store.put_manifest(number, {"buckets": before["buckets"], "versions": before["versions"] | {str(k): number for k in touched}})
    store.clean()
    scratch.close()
    return touched


def keep_upserted(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], by: str, **trigger) -> StreamingQuery:
    """Put the stream's rows into the table at folder, batch by batch (put_batch)."""
    name = f"upsert-{uuid.uuid4().hex[:8]}"
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: put_batch(batch, folder, number, keys, by)).trigger(**(trigger or {"availableNow": True})).start()
