"""Operator 2: similarity self-join of documents on word n-gram sets, by MinHash banding with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialize, mix, quoted, range_sums, spans, window_hashes, words_of
from .components import components

NGRAM = 5
SIMILAR = 0.8
#: The chance that banding finds a pair of just the similarity asked for.
RECALL = 0.9999
ROWS = 5
#: N-grams of the texts that one side of a verification task holds, and how many texts, and blocks up to which a whole component is
#: verified together in any case; the members of larger ones meet bucket by bucket, if that brings fewer texts together.
BLOCK_LOAD, BLOCK_ROWS = 1 << 20, 400
MOST_BLOCKS = 8


def band_count(similar: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` minima each that a pair of similarity `similar` needs to share one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


def shingles(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, one text after another; how many each text has. Fewer words than n: one n-gram."""
    w = words_of(batch, lower=True)
    first, _ = spans(w.n)
    grams, own = [], []
    full = np.maximum(w.n - NGRAM + 1, 0)
    runs = window_hashes(w.hashes, NGRAM)
    owner = np.repeat(np.arange(len(batch)), full)
    if len(owner):
        at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + first[owner]
        grams.append(runs[at])
        own.append(owner)
    short = np.flatnonzero((w.n > 0) & (w.n < NGRAM))
    grams.append(np.array([window_hashes(w.hashes[first[k] : first[k] + w.n[k]], int(w.n[k]))[0] ^ np.uint64(w.n[k]) for k in short], np.uint64))
    own.append(short)
    g, o = np.concatenate(grams), np.concatenate(own)
    by = np.argsort(g)
    by = by[np.argsort(o[by], kind="stable")]
    g, o = g[by], o[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    return g[new], np.bincount(o[new], minlength=len(batch))


def signatures(g: np.ndarray, n: np.ndarray, bands: int) -> np.ndarray:
    """Band hashes (texts, bands) of the n-gram sets; texts without n-grams have zeros."""
    out = np.zeros((len(n), bands), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        start = (np.cumsum(n) - n)[some]
        low = (g >> np.uint64(32)).astype(np.uint32)
        salt = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).astype(np.uint32).reshape(2, bands, ROWS)
        for b in range(bands):
            for r in range(ROWS):
                out[some, b] = mix(out[some, b] + np.minimum.reduceat((low ^ salt[0, b, r]) * (salt[1, b, r] | np.uint32(1)), start))
    return out


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int) -> DataFrame:
    """(k1, k2, id, set1, set2, n, bands) of each document; k1 and k2 identify its id and text, set1 and set2 its n-gram set."""
    fields = [T.StructField("set1", T.LongType()), T.StructField("set2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def start():
        def made(batch: list[bytes]) -> list:
            g, n = shingles(batch)
            at = np.cumsum(n) - n
            one, two = (range_sums((mix(g ^ np.uint64(k)) >> np.uint64(1)).view(np.int64), at, n) for k in (1, 2))
            rows = signatures(g, n, bands).view(np.int64)
            return [one, two, n.astype(np.int64), pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * bands, pa.array(rows.ravel()))]

        return made

    keyed = docs.select(*row_keys(id_col, text_col), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return map_text(keyed, "text", fields, start, keep_text=False)


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, as k1 and k2: with 64, some of ten billion rows would share them."""
    ident, text = F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return [F.xxhash64(ident, text).alias("k1"), F.xxhash64(F.lit(7), text, ident).alias("k2")]


def candidate_pairs(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Which rows of a and b share a band; band >= 0: which share that one and none before it."""
    if band < 0:
        out = np.zeros((len(a), len(b)), bool)
        for k in range(a.shape[1]):
            out |= a[:, k, None] == b[None, :, k]
        return out
    out = a[:, band, None] == b[None, :, band]
    for k in range(band):
        out &= a[:, k, None] != b[None, :, k]
    return out


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Common n-grams of sets[left[i]] and sets[right[j]], right at least where mask is set.

    A few pairs are intersected one by one. Else the pairs share a matrix product over the n-grams that occur more than once.
    """
    out = np.zeros(mask.shape, np.int64)
    pairs = np.argwhere(mask)
    if len(pairs) <= 4 * (len(left) + len(right)):
        for i, j in pairs.tolist():
            x, y = sorted((sets[left[i]], sets[right[j]]), key=len)
            at = np.searchsorted(y, x)
            out[i, j] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        return out
    used = np.unique(np.concatenate([left, right]))
    lengths = [len(sets[k]) for k in used]
    _, col, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), lengths)
    often = times > 1
    number = np.cumsum(often) - 1
    row, col = row[often[col]], number[col[often[col]]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    width = max(64, (1 << 22) // max(len(used), 1))
    l, r = np.searchsorted(used, left), np.searchsorted(used, right)
    for base in range(0, int(often.sum()), width):
        a, b = np.searchsorted(col, [base, base + width])
        grid = np.zeros((len(used), min(width, int(often.sum()) - base)), np.float32)
        grid[row[a:b], col[a:b] - base] = 1
        out += np.rint(grid[l] @ grid[r].T).astype(np.int64)
    return out


def verified(keys: np.ndarray, blocks: np.ndarray, copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], task: tuple[int, int, int], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Over one task's texts: the smallest key that verified links lead to, and the documents linked to, for each."""
    first, second, band = task
    left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
    n, links = np.array([len(s) for s in sets], np.int64), np.zeros(len(keys), np.int64)
    label = np.arange(len(keys))
    for base in range(0, len(left), 256):
        part = left[base : base + 256]
        mask = candidate_pairs(bands[part], bands[right], band)
        if first == second:
            mask &= part[:, None] < right[None, :]
        if not mask.any():
            continue
        both = shared_counts(sets, part, right, mask)
        i, j = np.nonzero(mask & (both >= np.ceil(similar * (n[part][:, None] + n[right][None, :] - both) - 1e-9)))
        i, j = part[i], right[j]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while True:  # the least label spreads over the links
            low = np.minimum(label[i], label[j])
            was = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (was == label).all():
                break
    return keys[label], links


def verify_tasks(rows: DataFrame, similar: float) -> DataFrame:
    """rows (route, i, j, band, block, key, copies, bands, grams), brought together by task and sorted: (key, label, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            keys, at = np.unique(t["key"].to_numpy(), return_index=True)  # a repeated row comes twice
            bands = np.stack(t["bands"].to_pandas().to_numpy()[at])
            grams = t["grams"].combine_chunks()
            grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
            flat, off = grams.values.to_numpy(zero_copy_only=False).view(np.uint64), grams.offsets.to_numpy()
            task = tuple(t[c][0].as_py() for c in ("i", "j", "band"))
            label, links = verified(keys, t["block"].to_numpy()[at], t["copies"].to_numpy()[at], bands, [flat[off[k] : off[k + 1]] for k in at], task, similar)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(label), pa.array(links)], names=["key", "label", "links"])

        last = None
        for batch in batches:
            tasks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("route", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]).any(1)) + 1).tolist(), len(tasks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tuple(tasks[a]) != last:
                    yield done()
                    held.clear()
                last = tuple(tasks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    spread = rows.repartition("route", "i", "j").sortWithinPartitions("route", "i", "j")
    return spread.mapInArrow(run, "key long, label long, links long")


def routed(reps: DataFrame, members: DataFrame, load: int, most: int, rows: int) -> DataFrame:
    """Which texts meet in which verification task: (key, routes: [(route, i, j, band, block)]).

    reps: (key, n); members: (band, hash, key) of buckets with several texts. The texts of a component of buckets form a route, in
    blocks of at most about `load` n-grams and `rows` texts; where that is more than `most` blocks, each bucket is a route, if so
    fewer texts are sent. A route of several blocks has a task for each two blocks: however many texts are alike, a task holds two.
    """
    heads = members.groupBy("band", "hash").agg(F.min("key").alias("b"))
    groups = materialize(components(members.join(heads, ["band", "hash"]).select(F.col("key").alias("a"), "b")), "groups")
    share = F.greatest(F.ceil(F.sum("n") / load), F.ceil(F.count("*") / rows)).alias("blocks")
    sized = groups.join(reps, groups.node == reps.key).select("key", "root", "n")
    whole = sized.groupBy("root").agg(share, F.count("*").alias("c"))
    large = whole.where(F.col("blocks") > most).select("root", (F.col("c") * F.col("blocks")).alias("sent"))
    wide = members.join(sized.join(large, "root"), "key")
    buckets = wide.groupBy("root", "sent", "band", "hash").agg(share, F.count("*").alias("c"))
    split = buckets.groupBy("root", "sent").agg(F.sum(F.col("c") * F.col("blocks")).alias("apart")).where(F.col("apart") < F.col("sent")).select("root")
    split = materialize(split, "split")
    together = sized.join(whole.select("root", "blocks"), "root").join(split, "root", "left_anti").select("key", F.col("root").alias("route"), "blocks", F.lit(-1).alias("band"))
    parts = wide.join(split, "root", "left_semi").join(buckets.select("band", "hash", "blocks"), ["band", "hash"]).select("key", F.xxhash64("band", "hash").alias("route"), "blocks", "band")
    placed = together.union(parts).withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), "blocks"))
    each = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.struct("route", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "band", "block")
    return each.groupBy("key").agg(F.collect_list(task).alias("routes"))


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, recall: float = RECALL, load: int = BLOCK_LOAD, most: int = MOST_BLOCKS, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: k1, k2, id, class_id, n_copies, n_links, first.

    Documents are linked if the Jaccard similarity of their sets of word n-grams (A-Z in lower case, words by ASCII whitespace,
    a text of fewer words is one n-gram) is at least `similar`. n_links: how many other documents a document is linked to;
    n_copies: those of the very same set among them. class_id: the smallest id that links lead to. first marks the documents
    of a class whose id is class_id (rows repeated as a whole are all marked). Copies count by their sets and are compared once;
    n_links is exact, so that different texts which share a bucket are compared each with each, spread over many tasks.

    Null and empty texts have no n-grams: each is its own class, without links. A null id counts as the largest; a class of
    null ids only has class_id null. An empty table gives no rows. Columns other than the id and the text aren't read.
    """
    bands = band_count(similar, recall)
    signs = materialize(signed(docs, id_col, text_col, bands), "signatures")
    some = signs.where(F.col("n") > 0)
    sets = some.groupBy("set1", "set2").agg(F.min(F.struct("k1", "k2", "n", "bands")).alias("r"), F.count("*").alias("copies"), F.min("id").alias("least"))
    reps = materialize(sets.select("set1", "set2", "r.*", "copies", "least", F.monotonically_increasing_id().alias("key")), "sets")
    spots = reps.select("key", F.posexplode("bands").alias("band", "hash"))
    full = spots.groupBy("band", "hash").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("band", "hash")
    members = materialize(spots.join(full, ["band", "hash"]), "buckets")
    routes = routed(reps.select("key", "n"), members, load, most, rows).join(reps.select("key", "k1", "k2", "copies", "bands"), "key")

    def start():
        def made(batch: list[bytes]) -> list:
            g, n = shingles(batch)
            return [pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(g.view(np.int64)))]

        return made

    found = docs.select(*row_keys(id_col, text_col), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).join(routes, ["k1", "k2"]).drop("k1", "k2")
    rows_ = map_text(found, "text", [T.StructField("grams", T.ArrayType(T.LongType()))], start, keep_text=False)
    checked = materialize(verify_tasks(rows_.select("key", "copies", "bands", "grams", F.inline("routes")), similar), "links")
    linked = checked.groupBy("key").agg(F.sum("links").alias("links")).where(F.col("links") > 0)
    roots = components(checked.select(F.col("key").alias("a"), F.col("label").alias("b")))
    named = reps.select("set1", "set2", F.col("key").alias("node"), "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(linked.withColumnRenamed("key", "node"), "node", "left")
    tops = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(tops, "root").select("set1", "set2", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id")
    alone = signs.where(F.col("n") == 0).select("k1", "k2", "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    joined = some.join(named, ["set1", "set2"]).select("k1", "k2", "id", "class_id", (F.col("copies") - 1).alias("n_copies"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("id").eqNullSafe(F.col("class_id")).alias("first"))
    return joined.union(alone)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class of linked documents: that with the smallest id (of rows that share it, one). Columns as before.

    Documents without words are all kept, as they are linked to nothing; rows repeated as a whole are kept once, words or not.
    """
    names = [F.col(quoted(c)) for c in docs.columns]
    classes = materialize(ngram_classes(docs, id_col, text_col), "classes")
    linked = classes.where("n_copies + n_links > 0").withColumn("key", F.struct("k1", "k2"))
    firsts = linked.where("first").groupBy("class_id").agg(F.min("key").alias("least"))
    gone = linked.join(firsts, linked.class_id.eqNullSafe(firsts.class_id)).where(F.col("key") != F.col("least")).select("k1", "k2").distinct()
    twice = materialize(classes.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "repeated")
    left = docs.select(F.struct(*names).alias("row"), *row_keys(id_col, text_col)).join(gone, ["k1", "k2"], "left_anti")
    if not twice.isEmpty():
        once = left.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        left = left.join(twice, ["k1", "k2"], "left_anti").unionByName(once)
    return left.select("row.*")
