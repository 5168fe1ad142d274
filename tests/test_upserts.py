"""Keyed tables in buckets: only what a batch touches is written again."""

from weftlink.streaming import upserts

SCHEMA = "k int, v string, t long, bucket string"


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = str(tmp_path / "table")
    put = lambda number, rows: upserts.put_batch(spark.createDataFrame(rows, SCHEMA), table, number, ["k"], "t")
    read = lambda: {r.k: (r.v, r.bucket) for r in upserts.current(spark, table, spark.createDataFrame([], SCHEMA).schema).collect()}
    assert read() == {}
    want = {k: (f"a{k}", "x") for k in range(500)} | {None: ("n", None)}
    assert len(put(0, [(k, v, 1, b) for k, (v, b) in want.items()])) == upserts.BUCKETS and read() == want

    held = upserts.current(spark, table, spark.createDataFrame([], SCHEMA).schema)
    touched = put(1, [(7, "new", 5, "x"), (7, "old", 2, "x"), (8, "late", 0, "x"), (None, "m", 2, None)])
    want |= {7: ("new", "x"), None: ("m", None)}
    assert 1 <= len(touched) <= 3 and read() == want
    store = upserts.Store(spark, table)
    assert {n for n in store.names("data", "version=1") if n.startswith("bucket__=")} == {f"bucket__={k}" for k in touched}
    assert len(held.collect()) == 501  # the batch before is still readable

    assert put(1, [(7, "again", 9, "x")]) == [] and read() == want  # a batch counts once
    assert put(2, []) == [] and read() == want
    assert put(3, [(7, "last", 9, "x")]) and read() == want | {7: ("last", "x")}
    versions = store.manifest(3)["versions"] | {f"{k} before": v for k, v in store.manifest(2)["versions"].items()}
    assert store.manifests() == [2, 3] and {int(n.split("=")[1]) for n in store.names("data")} == set(versions.values())
    old = {n for n in store.names("data", "version=0") if n.startswith("bucket__=")}
    assert len(old) == upserts.BUCKETS - len(touched)  # what nothing names is gone


def test_a_batch_that_failed_is_put_in_from_the_same_rows(spark, tmp_path):
    table, rows = str(tmp_path / "table"), spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, None)], SCHEMA)
    upserts.put_batch(rows, table, 0, ["k"], "t")
    rows.withColumn("bucket__", rows.k * 0).write.partitionBy("bucket__").parquet(f"{table}/data/version=1")  # no manifest came of it
    upserts.put_batch(spark.createDataFrame([(2, "c", 2, None)], SCHEMA), table, 1, ["k"], "t")
    assert {r.k: r.v for r in upserts.current(spark, table, rows.schema).collect()} == {1: "a", 2: "c"}
