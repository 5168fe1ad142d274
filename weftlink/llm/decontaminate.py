"""Operator 6: benchmark decontamination by suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, materialize, others, quoted, slices, spans, texts, words_of

WINDOW = 10
#: Words of a shard, each with a suffix array of its own, and of the benchmark items searched in one pass.
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 19
#: Tasks that a text's later results are sent to.
SALTS = 8
#: Occurrences handled at a time.
AT_ONCE = 1 << 18
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_starts", T.ArrayType(T.LongType())), T.StructField("hit_ends", T.ArrayType(T.LongType())),
    T.StructField("longest", T.LongType()), T.StructField("longest_item", T.StringType()), T.StructField("longest_at", T.LongType()),
]


@dataclass(frozen=True)
class Items:
    """Benchmark items as one run of word hashes; from each word on, how many words its item still has, and its window's width."""

    ids: list[str]
    hashes: np.ndarray
    owner: np.ndarray
    left: np.ndarray
    width: np.ndarray  # 0 where no window begins


def items_of(ids: list[str], item_texts: list[bytes]) -> Items:
    w = words_of(item_texts, ALNUM, lower=True)
    first, last = spans(w.n)
    owner = np.repeat(np.arange(len(ids)), w.n)
    at = np.arange(len(w.hashes))
    left = np.repeat(last, w.n) - at
    width = np.where(left >= WINDOW, WINDOW, np.where(at == np.repeat(first, w.n), left, 0))
    return Items(ids, w.hashes, owner, left, width)


def suffix_array(ids: np.ndarray, top: int, depth: int) -> np.ndarray:
    """Positions of ids (each from 0 to top) in the order of their suffixes, as far as `depth` words decide it.

    The first sort goes by as many words as fit 63 bits; prefix doubling then re-sorts only suffixes that are still tied.
    """
    n, bits = len(ids), max(1, int(top).bit_length())
    reach = max(1, 63 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate([ids.astype(np.int64), np.zeros(reach, np.int64)])
    for k in range(reach):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    place = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    while reach < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        pair = rank[at] * (n + 2) + rank[np.minimum(at + reach, n)] + 1
        by = np.argsort(pair)
        order[tied], pair = at[by], pair[by]
        new[tied[1:]] |= pair[1:] != pair[:-1]
        rank[order[tied]] = np.maximum.accumulate(np.where(new, place, 0))[tied]
        reach *= 2
    return order


def compared(query: np.ndarray, q: np.ndarray, text: np.ndarray, t: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared words of query[q:] and text[t:], up to depth, and the sign of the first difference (text after query: 1; none: 0)."""
    same, sign = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    on, k = np.flatnonzero(depth > 0), 0
    while len(on):
        a, b = query[q[on] + k], text[np.minimum(t[on] + k, len(text) - 1)]  # text ends with a separator
        sign[on] = np.sign(b - a)
        on = on[a == b]
        k += 1
        same[on] = k
        on = on[depth[on] > k]
    return same, sign


def bound(query: np.ndarray, q: np.ndarray, text: np.ndarray, order: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
    """The first place in order whose suffix isn't before (after: comes after) the query's words, for each query by binary search."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order))
    on = np.arange(len(q)) if len(order) else np.empty(0, np.int64)
    while len(on):
        mid = (low[on] + high[on]) // 2
        _, sign = compared(query, q[on], text, order[mid], depth[on])
        right = sign <= 0 if after else sign < 0
        low[on[right]], high[on[~right]] = mid[right] + 1, mid[~right]
        on = on[low[on] < high[on]]
    return low


def search(items: Items, hashes: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over one shard: marks of hit words; pairs (document, item); for each document its longest match (words, item, where)."""
    known, ids = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    text = np.zeros(len(hashes) + len(n_words) + 1, np.int64)  # a separator, 0, stands after each document
    spot = np.arange(len(hashes)) + doc
    text[spot] = ids + 1
    back = np.full(len(text), -1)
    back[spot] = np.arange(len(hashes))
    at = np.minimum(np.searchsorted(known, items.hashes), max(len(known) - 1, 0))
    query = np.where(known[at] == items.hashes, at + 1, -1) if len(known) else np.full(len(items.hashes), -1)
    hit, longest = np.zeros(len(hashes) + 1, np.int64), np.zeros((len(n_words), 3), np.int64)
    pairs: list[np.ndarray] = []
    if len(items.hashes) and len(hashes):
        order = suffix_array(text, len(known), int(items.left.max()))
        q = np.arange(len(query))
        place = bound(query, q, text, order, items.left, after=False)
        most = np.maximum(*(compared(query, q, text, order[np.clip(place - k, 0, len(order) - 1)], items.left)[0] for k in (0, 1)))
        q = np.flatnonzero((items.width > 0) & (most >= items.width))
        low = bound(query, q, text, order, items.width[q], after=False)
        high = bound(query, q, text, order, items.width[q], after=True)
        ends = np.cumsum(high - low)
        for base in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            n = np.arange(base, min(base + AT_ONCE, ends[-1]))
            k = np.searchsorted(ends, n, side="right")
            where = order[low[k] + n - (ends[k] - (high - low)[k])]
            word = back[where]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + items.width[q[k]], -1)
            owner, item = doc[word], items.owner[q[k]]
            pairs.append(np.unique(owner * len(items.ids) + item))
            length, _ = compared(query, q[k], text, where, items.left[q[k]])
            first = word - (np.cumsum(n_words) - n_words)[owner]
            by = np.lexsort((first, item, -length, owner))
            by = by[np.append(True, owner[by][1:] != owner[by][:-1])]
            by = by[length[by] > longest[owner[by], 0]]
            longest[owner[by]] = np.stack([length[by], item[by], first[by]], 1)
    both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return np.cumsum(hit)[:-1] > 0, np.stack([both // max(len(items.ids), 1), both % max(len(items.ids), 1)], 1), longest


def found(items: Items, batch: list[bytes]) -> list[pa.Array]:
    """The columns FIELDS of a shard."""
    w = words_of(batch, ALNUM, lower=True)
    hit, pairs, longest = search(items, w.hashes, w.n)
    first, last = spans(w.n)
    of: list[set] = [set() for _ in batch]
    for d, i in pairs.tolist():
        of[d].add(items.ids[i])
    n_hit, starts, ends = [], [], []
    for d in range(len(batch)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[d] : last[d]].astype(np.int8), [0]])))
        starts.append(edge[::2])
        ends.append(edge[1::2])
        n_hit.append(int((edge[1::2] - edge[::2]).sum()))
    top = [(int(n), items.ids[i], int(at)) if n else (0, None, None) for n, i, at in longest.tolist()]
    lists = pa.list_(pa.int64())
    return [
        pa.array(w.n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in of], pa.list_(pa.string())), pa.array(starts, lists), pa.array(ends, lists),
        pa.array([x[0] for x in top], pa.int64()), pa.array([x[1] for x in top], pa.string()), pa.array([x[2] for x in top], pa.int64()),
    ]


def one_pass(docs: DataFrame, items: Items, text_col: str, keep_text: bool) -> DataFrame:
    """docs with FIELDS, searched for the items in shards, each with a suffix array of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = [f.name for f in FIELDS]
    passed = [c for c in others(docs.columns, names) if c != text_col]
    source = docs.select(*[F.col(quoted(c)) for c in passed], F.col(quoted(text_col)))
    kept = passed + [text_col] * keep_text
    schema = T.StructType([source.schema[c] for c in kept] + FIELDS)

    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([rows.column(c) for c in kept] + found(shared.value, texts(rows, text_col)), names=kept + names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, text_col):
                parts.append(part)
                size += part.column(text_col).nbytes
                if size >= 6 * SHARD_WORDS:
                    yield shard(parts)
                    parts, size = [], 0
        if parts:
            yield shard(parts)

    return source.mapInArrow(run, schema)


def joined_passes(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    """first, the first block's pass over all documents with the keys __t1 and __t2 of their texts, joined with the later blocks' narrow
    results of the texts that hold something: hit runs united, items merged, the longest match of all (of equals the earliest block's)."""
    rest = more[0]
    for x in more[1:]:
        rest = rest.unionByName(x)
    rest = rest.groupBy("__t1", "__t2").agg(F.array_sort(F.collect_list(F.struct("__block", *[F.col(f.name) for f in FIELDS[2:]]))).alias("__r")).select(F.col("__t1").alias("__k1"), F.col("__t2").alias("__k2"), "__r")
    rest = materialize(rest, "found")
    # a text that a third of all documents share: its key is dealt over tasks with the documents
    salted = rest.withColumn("__s0", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = [F.col(quoted(f.name)) for f in first.schema.fields if f.name not in {x.name for x in FIELDS} and "map<" not in f.dataType.simpleString()]
    out = first.withColumn("__s", F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")).join(salted, (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2")) & (F.col("__s") == F.col("__s0")), "left")
    runs = lambda starts, ends: F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    every = F.array_sort(F.concat(runs(F.col("hit_starts"), F.col("hit_ends")), F.flatten(F.transform("__r", lambda x: runs(x["hit_starts"], x["hit_ends"])))))
    # runs in order of their starts: one that begins within the last one, or right after it, makes it longer
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    last = lambda u: F.element_at(u, -1)
    longer = lambda u, x: F.concat(F.slice(u, 1, F.size(u) - 1), F.array(F.struct(last(u)["a"].alias("a"), F.greatest(last(u)["b"], x["b"]).alias("b"))))
    united = F.aggregate(every, none, lambda u, x: F.when((F.size(u) > 0) & (F.get(u, F.size(u) - 1)["b"] >= x["a"]), longer(u, x)).otherwise(F.concat(u, F.array(x))))
    top = F.aggregate("__r", F.struct("longest", "longest_item", "longest_at"), lambda t, x: F.when(x["longest"] > t["longest"], F.struct(x["longest"].alias("longest"), x["longest_item"].alias("longest_item"), x["longest_at"].alias("longest_at"))).otherwise(t))
    more_found = F.col("__r").isNotNull()
    out = out.withColumns({"__u": F.when(more_found, united), "__t": F.when(more_found, top)})
    new = {
        "n_hit": F.when(more_found, F.aggregate("__u", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])).otherwise(F.col("n_hit")),
        "items": F.when(more_found, F.array_sort(F.array_union("items", F.flatten(F.col("__r.items"))))).otherwise(F.col("items")),
        "hit_starts": F.when(more_found, F.col("__u.a")).otherwise(F.col("hit_starts")), "hit_ends": F.when(more_found, F.col("__u.b")).otherwise(F.col("hit_ends")),
        **{c: F.when(more_found, F.col(f"__t.{c}")).otherwise(F.col(c)) for c in ("longest", "longest_item", "longest_at")},
    }
    return out.withColumns(new).drop("__t1", "__t2", "__k1", "__k2", "__r", "__s0", "__s", "__u", "__t")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep_text: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Append to docs what of the benchmark they hold: n_words, n_hit, items (ids), hit_starts and hit_ends (runs of hit words),
    and the longest verbatim match: its words, item and word position.

    benchmark has item_id and text. Its items are searched block_words at a time, one pass over the texts for each block; of the
    passes after the first only what they find is written, by text, and joined.
    A null or empty text has no words; an item without words is never found, a null item_id reads as the empty text, and
    repeated ids count once. Repeated documents get equal results. Columns of docs with the names of new ones are replaced.
    """
    keyed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))

    def items(k: int) -> Items:
        rows = (keyed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else keyed).distinct().toPandas()
        rows = rows.sort_values(["item_id", "text"])
        return items_of(rows["item_id"].tolist(), [t.encode() for t in rows["text"]])

    if blocks == 1:
        return one_pass(docs, items(0), text_col, keep_text)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    keys = [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(7), text).alias("__t2")]
    more = []
    for k in range(1, blocks):
        narrow = one_pass(docs.select(*keys, text.alias("text")), items(k), "text", keep_text=False).where(F.col("n_hit") > 0)
        more.append(materialize(narrow.dropDuplicates(["__t1", "__t2"]).withColumn("__block", F.lit(k)), "leaks"))
    return joined_passes(one_pass(docs.select("*", *keys), items(0), text_col, keep_text), more)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the documents that hold any window of a benchmark item; columns as before."""
    return find_leaks(docs, benchmark, text_col).where(F.col("n_hit") == 0).select(*[F.col(quoted(c)) for c in docs.columns])
