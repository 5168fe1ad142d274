"""Operator 10: a log-bilinear language model, trained by noise-contrastive estimation, over counts of the whole corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, id_text, map_text, materialize, mix, quoted, range_sums, slices, spans, texts, words_of

#: Words with an output and an input of their own, the most frequent ones; by frequency they form CLASSES of SLOTS words each.
CLASSES, SLOTS = 64, 64
HEAD = CLASSES * SLOTS
#: All other words: as outputs in classes by their last two bytes, as inputs by their last three.
TAIL, ENDINGS = 64, 1024
#: Outputs of the first step: the end, the head's classes, the tail's.
STEPS = 1 + CLASSES + TAIL
CONTEXT, DIM, NOISE, SLOT_NOISE, BATCH = 3, 16, 24, 6, 2048
RATE = 0.1
#: Counts that are broadcast (the most frequent words); all others are joined.
KNOWN_WORDS = 1 << 17
#: Training texts are dealt by a hash into ROUNDS parts, and each part into shards of about SHARD_TOKENS tokens over all rounds; the
#: models of a round's shards are averaged, and sent and summed in PIECES.
ROUNDS, SHARD_TOKENS, PIECES = 4, 1 << 21, 16
END = np.uint64(0x5E7D5E7D5E7D5E7D)


@dataclass
class Lbl:
    embed: np.ndarray  # inputs, DIM
    turn: np.ndarray  # CONTEXT * DIM, DIM
    out: np.ndarray  # STEPS, DIM and the bias
    word: np.ndarray  # HEAD, DIM and the bias: of a word within its class

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


@dataclass(frozen=True)
class Corpus:
    """What the counts say: totals, the head's and the broadcast words, and each first output's tokens and words."""

    tokens: int
    words: int
    ends: int
    head: np.ndarray  # sorted hashes of the head's words
    rank: np.ndarray  # their places by frequency
    head_counts: np.ndarray  # by place
    known: np.ndarray  # sorted hashes of the broadcast words
    known_counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray


def endings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A scrambled number of the last n bytes of each word (A-Z in lower case)."""
    out = np.zeros(len(end), np.uint64)
    for k in range(1, n + 1):
        at = end - k
        b = raw[np.maximum(at, 0)].astype(np.uint64)
        b = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
        out = out << np.uint64(8) | np.where(at >= begin, b, 0)
    return mix(out)


def tail_class(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (1 + CLASSES + (endings(raw, begin, end, 2) >> np.uint64(40)) % np.uint64(TAIL)).astype(np.int64)


def place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted table each x is, and whether."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


@dataclass
class Tokens:
    hashes: np.ndarray
    n: np.ndarray  # tokens of each text, the end with them
    inputs: np.ndarray
    outputs: np.ndarray  # of the first step
    words: np.ndarray  # places of the head's words; -1: others


def tokens(batch: list[bytes], head: np.ndarray, rank: np.ndarray) -> Tokens:
    """The tokens of all texts, one after another, each text's end last, as inputs and outputs of the model."""
    w = words_of(batch, lower=True)
    at, is_head = place(head, w.hashes)
    word = np.where(is_head, rank[at], -1) if len(head) else np.full(len(at), -1)
    out = np.where(is_head, 1 + word // SLOTS, tail_class(w.raw, w.begin, w.end))
    into = np.where(is_head, 1 + word, 1 + HEAD + (endings(w.raw, w.begin, w.end, 3) >> np.uint64(40)).astype(np.int64) % ENDINGS)
    last = np.cumsum(w.n)
    return Tokens(np.insert(w.hashes, last, END), w.n + 1, np.insert(into, last, 0), np.insert(out, last, 0), np.insert(word, last, -1))


def contexts(t: Tokens) -> np.ndarray:
    """The inputs of the CONTEXT tokens before each token; before the first ones stands an end."""
    out = np.zeros((CONTEXT, len(t.inputs)), np.int64)
    first, _ = spans(t.n)
    for k in range(CONTEXT):
        out[k, k + 1 :] = t.inputs[: len(t.inputs) - k - 1]
        for j in range(k + 1):
            at = first + j
            out[k, at[at < first + t.n]] = 0
    return out


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(hash, class, c) of every word: counted within a task's batches first, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 8 << 20):
                w = words_of(texts(part, text_col), lower=True)
                known, first, c = np.unique(w.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(tail_class(w.raw, w.begin[first], w.end[first]).astype(np.int32)), pa.array(c)], names=["hash", "class", "c"])

    return docs.select(F.col(quoted(text_col))).mapInArrow(run, "hash long, class int, c long").groupBy("hash").agg(F.min("class").alias("class"), F.sum("c").alias("c"))


def steps_down(counts: DataFrame) -> list[tuple[int, int]]:
    """(step, words) from the most frequent words down: a step is an eighth of a doubling of the count, so that there are few."""
    return [(r["step"], r["n"]) for r in counts.groupBy(frequency_step().alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()]


def frequency_step() -> Column:
    return F.floor(8 * F.log2(F.col("c").cast("double"))).cast("int")


def corpus_of(counts: DataFrame, ends: int, known_words: int = KNOWN_WORDS) -> Corpus:
    """Only one row per step and class, the steps of frequent words that hold known_words at most, and the head reach the driver;
    they are filtered before they are collected, and only where one step holds too many words is the head sorted out by Spark."""
    by_class = {r["class"]: r for r in counts.groupBy("class").agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect()}
    steps = steps_down(counts)
    reach = np.cumsum([n for _, n in steps])
    within = int(np.searchsorted(reach, known_words, side="right"))
    known = counts.where(frequency_step() >= steps[within - 1][0]).toPandas() if within else counts.limit(0).toPandas()
    if within and reach[within - 1] >= min(HEAD, reach[-1]):
        head = known.sort_values(["c", "hash"], ascending=[False, True])[:HEAD]
    else:
        least = steps[min(int(np.searchsorted(reach, HEAD)), len(steps) - 1)][0] if steps else 0
        head = counts.where(frequency_step() >= least).orderBy(F.desc("c"), "hash").limit(HEAD).toPandas()
    tokens, words = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
    for k, r in by_class.items():
        tokens[k], words[k] = r["t"], r["v"]
    total, distinct = int(tokens.sum()), int(words.sum())
    for place, (k, n) in enumerate(zip(head["class"], head["c"], strict=True)):
        tokens[k] -= n
        words[k] -= 1
        tokens[1 + place // SLOTS] += n
    of = lambda rows: (rows["hash"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64))
    (top, top_c), (near, near_c) = of(head), of(pd.concat([known, head]).drop_duplicates("hash"))
    by, order = np.argsort(top), np.argsort(near)
    tokens[0], some = ends, int(ends > 0)
    return Corpus(total + ends, distinct + some, ends, top[by], by, top_c, near[order], near_c[order], tokens, words)


#: The bias of a place in a class without a word.
NO_WORD = -30.0


def new_model(corpus: Corpus, seed: int = 5) -> Lbl:
    """Small random vectors; biases by the counts: of each class, and of each word within its class."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    share = (corpus.class_tokens + 0.5) / (corpus.class_tokens + 0.5).sum()
    counts = np.zeros(HEAD)
    counts[: len(corpus.head_counts)] = corpus.head_counts
    own = counts / np.maximum(np.repeat(counts.reshape(CLASSES, SLOTS).sum(1), SLOTS), 1)
    word_bias = np.where(counts > 0, np.log(np.maximum(own, 1e-12)), NO_WORD)
    turn = np.concatenate([np.eye(DIM, dtype=np.float32) / (k + 1) for k in range(CONTEXT)])
    biased = lambda rows, bias: np.concatenate([rows, bias[:, None]], 1).astype(np.float32)
    return Lbl(draw(1 + HEAD + ENDINGS, DIM), turn, biased(draw(STEPS, DIM), np.log(share)), biased(draw(HEAD, DIM), word_bias))


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, in order, and the sums of their rows."""
    by = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[by]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.add.reduceat(rows[by], first, axis=0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -30, 30)
    np.exp(-z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def train_on(model: Lbl, t: Tokens, share: np.ndarray, memory: list[np.ndarray], rng: np.random.Generator, rate: float = RATE) -> None:
    """One pass of noise-contrastive estimation over the tokens, by Adagrad. A batch shares its noise: first outputs drawn from
    `share`; and for the words within their classes, places in the class, all alike."""
    before, odds, slot_odds = np.ascontiguousarray(contexts(t).T), np.log(NOISE * share).astype(np.float32), np.float32(np.log(SLOT_NOISE / SLOTS))
    noises = rng.choice(len(share), (-(-len(t.outputs) // BATCH), NOISE), p=share)
    for number, noise in enumerate(noises):
        own = slice(number * BATCH, (number + 1) * BATCH)
        ctx, y, w = before[own], t.outputs[own], t.words[own]
        slots, unit = rng.integers(0, SLOTS, SLOT_NOISE), np.float32(1 / len(y))
        x = model.embed[ctx].reshape(len(y), -1)
        r = np.ones((len(y), DIM + 1), np.float32)  # the last column takes the bias
        np.matmul(x, model.turn, out=r[:, :DIM])
        mine, other = model.out[y], model.out[noise]
        g = (sigmoid((r * mine).sum(1) - odds[y]) - 1) * unit
        gn = sigmoid(r @ other.T - odds[noise]) * unit
        dr = g[:, None] * mine + gn @ other
        changes = [(2, *summed(np.concatenate([y, noise]), np.concatenate([g[:, None] * r, gn.T @ r])))]
        on = np.flatnonzero(w >= 0)
        if len(on):
            on = on[np.argsort(w[on].astype(np.uint16), kind="stable")]
            w, r = w[on], r[on]
            first = np.flatnonzero(np.append(True, w[1:] // SLOTS != w[:-1] // SLOTS))  # of each class in the batch
            others = (w[first] // SLOTS)[:, None] * SLOTS + slots
            mine, far = model.word[w], np.repeat(model.word[others], np.diff(np.append(first, len(w))), axis=0)
            h = (sigmoid((r * mine).sum(1) - slot_odds) - 1) * unit
            hn = sigmoid((far @ r[:, :, None])[:, :, 0] - slot_odds) * unit
            dr[on] += h[:, None] * mine + (hn[:, None, :] @ far)[:, 0]
            wide = np.add.reduceat((hn[:, :, None] * r[:, None, :]).reshape(len(on), -1), first, axis=0)
            each, d_word = summed(np.concatenate([w, others.ravel()]), np.concatenate([h[:, None] * r, wide.reshape(-1, DIM + 1)]))
            changes.append((3, each, d_word))
        dr = dr[:, :DIM]
        changes += [(0, *summed(ctx.ravel(), (dr @ model.turn.T).reshape(-1, DIM))), (1, slice(None), x.T @ dr)]
        parts = model.parts()
        for k, at, d in changes:
            m = memory[k][at] + d * d
            memory[k][at] = m
            parts[k][at] -= rate * d / (np.sqrt(m) + 1e-6)


def fresh_memory(model: Lbl, start: float = 1e-6) -> list[np.ndarray]:
    return [np.full_like(p, start) for p in model.parts()]


def flat(model: Lbl, memory: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in (*model.parts(), *memory)]).astype(np.float32)


def unflat(model: Lbl, values: np.ndarray) -> tuple[Lbl, list[np.ndarray]]:
    """The model and the memory that flat() made one row of; shapes as in `model`."""
    shapes = [p.shape for p in model.parts()] * 2
    parts = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(values, np.cumsum([math.prod(s) for s in shapes])[:-1]), shapes, strict=True)]
    return Lbl(*parts[: len(parts) // 2]), parts[len(parts) // 2 :]


def trained(docs: DataFrame, corpus: Corpus, id_cols: tuple[str, ...] = (), text_col: str = "text") -> Lbl:
    """One pass over all of docs, in rounds: in each, every shard trains a copy of the model on its texts, and the copies are
    averaged by their tokens.

    Shards and rounds go by a hash of id and text and by the number of tokens alone, and a shard takes its texts in the order of
    their hashes: how docs is partitioned changes nothing. A shard streams through a task; rows that are wholly equal fall to one.
    """
    share = (corpus.class_tokens + 1) / (corpus.class_tokens + 1).sum()
    shards = max(1, -(-corpus.tokens // SHARD_TOKENS))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.xxhash64(*[F.col(quoted(c)) for c in id_cols], text).alias("key"), text.alias("text"))
    rows = rows.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright("key", 40), F.lit(ROUNDS)).alias("round"), "key", "text")
    model = new_model(corpus)
    memory, sc = fresh_memory(model), docs.sparkSession.sparkContext
    for number in range(ROUNDS if corpus.tokens else 0):
        shared = sc.broadcast((model, memory, corpus.head, corpus.rank, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            start, kept, head, rank, share = shared.value

            def trainer(shard: int):
                """Takes texts, and gives at None what came of all of them."""
                own, mine, rng = Lbl(*(p.copy() for p in start.parts())), [m.copy() for m in kept], np.random.default_rng((number, shard))
                seen, held, size = 0, [], 0
                while True:
                    text = yield
                    if text is not None:
                        held.append(text)
                        size += len(text)
                    if held and (text is None or size >= SLICE_BYTES):
                        t = tokens(held, head, rank)
                        train_on(own, t, share, mine, rng)
                        seen, held, size = seen + len(t.outputs), [], 0
                    if text is None:
                        values = np.array_split(flat(own, mine), PIECES)
                        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([shard] * PIECES, pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=["piece", "shard", "n", "sum"])

            at, one = None, None
            for batch in batches:
                for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text"), strict=True):
                    if shard != at:
                        if one:
                            yield one.send(None)
                        at, one = shard, trainer(shard)
                        next(one)
                    one.send(text.as_py().encode())
            if one:
                yield one.send(None)

        part = rows.where(F.col("round") == number).select("shard", "key", "text")
        dealt = part.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "text").select("shard", "text")
        copies = dealt.mapInArrow(run, "piece int, shard int, n long, sum binary")
        pieces = copies.repartition(PIECES, "piece").sortWithinPartitions("piece", "shard").mapInArrow(weighed, "piece int, sum binary").collect()
        if pieces:
            model, memory = unflat(model, np.concatenate([np.frombuffer(p["sum"], np.float64) for p in sorted(pieces, key=lambda p: p["piece"])]))
        shared.unpersist()
    return model


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The means of each piece's rows (piece, shard, n, sum), weighed by n, in the order in which they come."""

    def mean(piece: int, n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(total / n).tobytes()], pa.binary())], names=["piece", "sum"])

    at, n, total = None, 0, None
    for batch in batches:
        for piece, count, values in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), batch.column("sum"), strict=True):
            x = np.frombuffer(values.as_py(), np.float32).astype(np.float64) * count
            if piece != at:
                if at is not None:
                    yield mean(at, n, total)
                at, n, total = piece, 0, 0.0
            n, total = n + count, total + x
    if at is not None:
        yield mean(at, n, total)


def log_softmax(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of z, which is overwritten, the entry y, normalised."""
    z -= z.max(1)[:, None]
    own = z[np.arange(len(y)), y]
    return own - np.log(np.exp(z, out=z).sum(1))


def log_probabilities(model: Lbl, t: Tokens) -> np.ndarray:
    """The natural logarithm of each token's first output given its context, normalised over all of them; and for a word of the
    head also of its place, normalised over its class."""
    before, out = contexts(t), np.zeros(len(t.outputs))
    r = np.ones((len(out), DIM + 1), np.float32)
    r[:, :DIM] = sum((model.embed @ m)[c] for m, c in zip(np.split(model.turn, CONTEXT), before, strict=True))
    for base in range(0, len(out), BATCH):
        to = base + BATCH
        out[base:to] = log_softmax(r[base:to] @ model.out.T, t.outputs[base:to])
    on = np.flatnonzero(t.words >= 0)
    on = on[np.argsort(t.words[on].astype(np.uint16), kind="stable")]
    edges = np.searchsorted(t.words[on] // SLOTS, np.arange(CLASSES + 1))
    for k in range(CLASSES):
        at = on[edges[k] : edges[k + 1]]
        if len(at):
            out[at] += log_softmax(r[at] @ model.word[k * SLOTS : (k + 1) * SLOTS].T, t.words[at] - k * SLOTS)
    return out


def lm_scores(docs: DataFrame, learn: Column, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), known_words: int = KNOWN_WORDS) -> DataFrame:
    """(id_cols, learned, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    learn tells the rows that counts and model are learned from: all of them are counted and trained on. The log-bilinear model
    gives the probability of the end, of each of the HEAD most frequent words (of its class, and of the word in it), and of each
    class of other words, which is shared out by the counts, one added to each word and one word more for all unknown ones. Scores
    are log10 of whole texts.

    A null or empty text is one token, its end. Without rows to learn from, all words are unknown. Repeated rows and ties score
    alike, an empty table gives no rows. Columns other than id_cols and the text aren't read.
    """
    rows = docs.select(*[F.col(quoted(c)) for c in id_cols], F.coalesce(learn, F.lit(False)).alias("learned"), F.col(quoted(text_col)).alias("text"))
    training = rows.where("learned")
    counts = materialize(counted(training, "text"), "counts")
    corpus = corpus_of(counts, training.count(), known_words)
    model = trained(training, corpus, id_cols)
    shared = docs.sparkSession.sparkContext.broadcast((model, corpus))
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("n_near", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("own", T.DoubleType()), T.StructField("rest", T.ArrayType(T.LongType()))]

    def start():
        model, corpus = shared.value
        inner = np.where(np.arange(STEPS) > CLASSES, np.log10(corpus.class_tokens + corpus.class_words + 1), 0)

        def score(batch: list[bytes]) -> list:
            t = tokens(batch, corpus.head, corpus.rank)
            first, _ = spans(t.n)
            at, near = place(corpus.known, t.hashes)
            end = t.hashes == END
            c = np.where(near, corpus.known_counts[at] if len(corpus.known) else 0, 0)
            c[end] = corpus.ends
            log_c = np.log10(c + 1.0)
            tail = t.outputs > CLASSES
            own = log_probabilities(model, t) / np.log(10) - inner[t.outputs] - np.where(tail, 0, log_c)
            far = ~near & ~end
            size = range_sums(far, first, t.n)
            rest = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(t.hashes[far].view(np.int64)))
            return [t.n, range_sums(c > 0, first, t.n), range_sums(log_c, first, t.n), range_sums(own, first, t.n), rest]

        return score

    scored = materialize(map_text(rows, "text", made, start, keep_text=False).withColumn("row", F.monotonically_increasing_id()), "scores")
    more = scored.select("row", F.explode("rest").alias("hash")).join(counts.select("hash", "c"), "hash")
    more = more.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("found"))
    out = scored.drop("rest").join(more, "row", "left").withColumn("counted", F.col("base") + F.coalesce("more", F.lit(0.0)))
    unit = math.log10(corpus.tokens + corpus.words + 1)
    return out.select(
        *[F.col(quoted(c)) for c in id_cols], "learned", "n_tokens", (F.col("n_near") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("own") + F.col("counted")).alias("score"),
    )


def split(modulus: int = 7) -> Column:
    return F.crc32(id_text().cast("binary")) % modulus
