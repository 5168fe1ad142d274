"""External name scorers: who answers, in which batches, and what is taken from the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import PROVIDERS
from ..schemas import BATCH, CLOSE, PASSES, SCORER_SURE
from ..storage import written
from .matching import listed_pairs, rankable, ranked_candidates, winners, with_names

ANSWER = "confidence double, reason string, error string, calls int, prompt int, completion int, total int"
QUOTA = "quota"


@dataclass(frozen=True)
class Answer:
    confidence: float
    reason: str = ""
    error: str | None = None
    calls: int = 0
    prompt: int = 0
    completion: int = 0
    total: int = 0


class QuotaExceeded(Exception):
    """The service takes no more calls. Other errors count for their pair alone, with a confidence of 0."""


class Scorer(Protocol):
    """Runs inside tasks. many() may leave pairs out (None) or fail as a whole; such pairs are asked one by one."""

    name: str

    def one(self, a: str, b: str) -> Answer: ...

    def many(self, pairs: list[tuple[str, str]]) -> list[Answer | None]: ...


@dataclass
class StubScorer:
    """Answers by a function of the two names, for tests and dry runs; calls no service."""

    score: Callable[[str, str], float]
    batch_score: Callable[[str, str], float | None] | None = None
    name: str = "stub"
    quota: bool = False
    tokens: int = 7
    extra: dict = field(default_factory=dict)

    def one(self, a: str, b: str) -> Answer:
        if self.quota:
            raise QuotaExceeded(self.name)
        return Answer(self.score(a, b), "stub", calls=1, prompt=self.tokens, total=self.tokens)

    def many(self, pairs: list[tuple[str, str]]) -> list[Answer | None]:
        if self.quota:
            raise QuotaExceeded(self.name)
        said = [(self.batch_score or self.score)(a, b) for a, b in pairs]
        return [None if s is None else Answer(s, "stub", calls=int(k == 0), prompt=self.tokens, total=self.tokens) for k, s in enumerate(said)]


#: Makers of scorers by provider; services are added by register(). None is called unless it is asked for by name.
REGISTRY: dict[str, Callable[[str], Scorer]] = {}


def register(provider: str, make: Callable[[str], Scorer]) -> None:
    REGISTRY[provider.lower()] = make


def make_scorer(name: str) -> Scorer:
    """The scorer of provider:model; claude is anthropic, a name without a known provider is a model of ollama."""
    first, colon, rest = name.partition(":")
    provider, model = (first.strip().lower(), rest.strip()) if colon and first.strip().lower() in (*PROVIDERS, *REGISTRY) else ("ollama", name)
    provider = {"claude": "anthropic"}.get(provider, provider)
    if not model:
        raise ValueError(f"no model for provider {provider}")
    if provider not in REGISTRY:
        raise ValueError(f"no scorer for provider {provider}")
    return REGISTRY[provider](model)


def answered(pairs: list[tuple[str, str]], scorer: Scorer, batched: bool) -> list[Answer]:
    """An answer for each pair: of a batch first, then one by one for what is left; errors are answers of 0."""
    out: list[Answer | None] = [None] * len(pairs)
    try:
        if batched:
            try:
                out = [*scorer.many(pairs), *out][: len(pairs)]
            except QuotaExceeded:
                raise
            except Exception:  # what a batch can't answer is asked again
                out = [None] * len(pairs)
        for k, (a, b) in enumerate(pairs):
            if out[k] is None:
                try:
                    out[k] = scorer.one(a, b)
                except QuotaExceeded:
                    raise
                except Exception as e:
                    out[k] = Answer(0.0, error=str(e) or type(e).__name__)
    except QuotaExceeded:
        return [Answer(0.0, error=QUOTA) for _ in pairs]
    return [x or Answer(0.0, error="missing_batch_result") for x in out]


def asked(pairs: DataFrame, scorer: Scorer, batched: bool, team: str = "TeamId", batch: int = BATCH) -> DataFrame:
    """pairs (team, player_seq, place, name1, name2, ...) with ANSWER: in batches of at most `batch` of one team, or one by one.

    Pairs are dealt by ranges of team and player, so that a large team lies in several tasks; a pair whose tokens are the same on
    both sides is answered 0.99 without a call. The result is written, as a call shouldn't be made twice.
    """
    known = pairs.columns
    ready = pairs.withColumn("__same", F.array_sort("tokens1") == F.array_sort("tokens2")).drop("tokens1", "tokens2")
    kept = [c for c in known if c not in ("tokens1", "tokens2")]

    def table(rows: pa.Table, said: list[Answer]) -> pa.RecordBatch:
        cols = [rows[c].combine_chunks() for c in kept]
        kinds = dict(confidence=pa.float64(), reason=pa.string(), error=pa.string(), calls=pa.int32(), prompt=pa.int32(), completion=pa.int32(), total=pa.int32())
        more = [pa.array([getattr(x, k) for x in said], t) for k, t in kinds.items()]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols] + more, names=kept + list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_batches([b])
            teams = rows[team].to_pylist()
            at = 0
            while at < len(teams):
                to = at + 1
                while to < len(teams) and to - at < batch and teams[to] == teams[at]:
                    to += 1
                part = rows.slice(at, to - at)
                names, same = list(zip(part["name1"].to_pylist(), part["name2"].to_pylist(), strict=True)), part["__same"].to_pylist()
                open_ = [k for k, s in enumerate(same) if not s]
                said = [Answer(0.99, "same tokens")] * len(names)
                for k, x in zip(open_, answered([names[k] for k in open_], scorer, batched) if open_ else [], strict=True):
                    said[k] = x
                yield table(part, said)
                at = to

    dealt = ready.repartitionByRange(team, "player_seq", "place").sortWithinPartitions(team, "player_seq", "place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*kept).schema.fields) + ", " + ANSWER
    return written(dealt.mapInArrow(run, schema), "answers")


def judged(answers: DataFrame, threshold: float, margin: float) -> DataFrame:
    """What each player's answers come to: the best one (the first of equals), margin to the second, and the reason: accepted,
    below_threshold, ambiguous (close behind, unless alone or sure)."""
    order = Window.partitionBy("player_seq").orderBy(F.desc("confidence"), "place")
    rows = answers.withColumn("k", F.row_number().over(order))
    best = F.min_by(F.struct("cand_seq", "confidence", "name2", "error"), "k")
    out = rows.groupBy("player_seq").agg(best.alias("b"), F.max(F.when(F.col("k") == 2, F.col("confidence"))).alias("second"), F.count("*").alias("n"))
    ahead = F.col("b.confidence") - F.coalesce("second", F.lit(0.0))
    reason = F.when(F.col("b.confidence") < threshold, "below_threshold").when((F.col("n") > 1) & (ahead < margin) & (F.col("b.confidence") < SCORER_SURE), "ambiguous").otherwise("accepted")
    return out.select("player_seq", "b.cand_seq", "b.confidence", "b.error", ahead.alias("margin"), F.col("n").cast("int").alias("comparisons"), reason.alias("reason"))


def best_of_many(answers: DataFrame, close: float = CLOSE) -> DataFrame:
    """(player_seq, cand_seq, confidence, ahead, close) of one name asked against many: the best answer (the first of equals), how far
    it is ahead of the second (of nothing: its confidence), and whether that is so little that the two can't be told apart."""
    first = answers.groupBy("player_seq").agg(F.max_by(F.struct("cand_seq", "place"), F.struct("confidence", -F.col("place"))).alias("b"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    rest = answers.join(first.select("player_seq", "b.place"), ["player_seq", "place"], "left_anti").groupBy("player_seq").agg(F.max("confidence").alias("second"))
    rows = first.join(rest, "player_seq", "left").withColumn("ahead", F.col("confidence") - F.coalesce("second", F.lit(0.0)))
    return rows.select("player_seq", "b.cand_seq", "confidence", "ahead", ((F.col("n") > 1) & (F.col("ahead") < close)).alias("close"))


def preferred(batch: DataFrame, single: DataFrame) -> DataFrame:
    """Of a player's two attempts the better one: an accepted single one, else that with the higher confidence, the batch's if equal."""
    cols = [c for c in batch.columns if c != "player_seq"]
    both = batch.select("player_seq", F.struct(*cols).alias("b")).join(single.select("player_seq", F.struct(*cols).alias("s")), "player_seq", "left")
    use = F.col("s").isNotNull() & (F.col("b.reason") != "accepted") & ((F.col("s.reason") == "accepted") | (F.col("s.confidence") > F.col("b.confidence")))
    return both.select("player_seq", F.when(use, F.col("s")).otherwise(F.col("b")).alias("x")).select("player_seq", "x.*")


def shortlists(players: DataFrame, photos: DataFrame, number: int, known: DataFrame | None = None) -> DataFrame:
    """(TeamId, player_seq, cand_seq, place, score, name1, name2, tokens1, tokens2): what a scorer is asked in pass `number`.

    Each player's best of all photos by the deterministic score, also those that share nothing with the player's name; the first
    k, then of photos shown by the same name the best. known: what listed_pairs knows of their names by now; players and photos that can be
    ranked then come as tables with their names (with_names).
    """
    p, people, left = PASSES[number], players, photos
    if known is None:
        people, left = written(with_names(players, "FullName"), "players"), written(with_names(rankable(photos), "display_name"), "photos")
    pairs = listed_pairs(people, left, p["k"], p["least"], p["gap"], known)
    ranked = ranked_candidates(pairs, left, p["k"], p["least"], p["gap"]).join(left.select("cand_seq", "display_name", F.col("tokens").alias("tokens2")), "cand_seq")
    once = ranked.groupBy("left_name", F.lower("display_name").alias("__shown")).agg(F.min_by(F.struct("cand_seq", "score", "place", F.col("display_name").alias("name2"), "tokens2"), "place").alias("r"))
    return people.select("TeamId", "player_seq", F.col("FullName").alias("name1"), F.col("tokens").alias("tokens1"), F.col("name").alias("left_name")).join(once, "left_name").select("TeamId", "player_seq", "r.cand_seq", "r.place", "r.score", "name1", "r.name2", "tokens1", "r.tokens2")


@dataclass(frozen=True)
class Pass:
    won: DataFrame  # player_seq, cand_seq, confidence, margin
    attempts: DataFrame
    usage: dict[str, int]
    quota: bool


def scorer_pass(players: DataFrame, photos: DataFrame, scorer: Scorer, threshold: float, number: int, known: DataFrame | None = None) -> Pass:
    """One pass over unresolved players: batches, then single questions for those that were refused, then one photo for each.

    If the service's quota ends, the pass takes nothing. known: as shortlists takes it.
    """
    listed = written(shortlists(players, photos, number, known), "asked")
    margin = PASSES[number]["margin"]
    first = asked(listed, scorer, batched=True)
    batch = written(judged(first, threshold, margin), "attempts")
    again = listed.join(batch.where("reason <> 'accepted'").select("player_seq"), "player_seq", "left_semi")
    second = asked(again, scorer, batched=False)
    every = first.unionByName(second)
    totals = every.agg(F.count("*").alias("comparisons"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "prompt", "completion", "total")], F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error") == QUOTA).alias("quota")).first().asDict()
    attempts = written(preferred(batch, judged(second, threshold, margin)), "attempts")
    quota = totals.pop("quota") > 0
    taken = attempts.where("reason = 'accepted'") if not quota else attempts.where("false")
    won = winners(taken.select(F.lit("").alias("left_name"), "player_seq", "cand_seq", F.col("confidence").alias("score"), "margin", F.lit(False).alias("equal")))
    return Pass(won.select("player_seq", "cand_seq", F.col("score").alias("confidence"), "margin"), attempts, totals, quota)
