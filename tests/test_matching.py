"""Matching against a plain simulation of the rounds over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftlink import schemas
from weftlink.functions.text import with_name_score
from weftlink.operators import far_names, matching, merging, numbering, scorers
from weftlink.plans import mapping, queries
from weftlink.storage import Scratch


def frames(spark, players, photos):
    p = spark.createDataFrame([(k, k, 1, name, ext, bool(ext), 1.0 if ext else 0.0) for k, (name, ext) in enumerate(players)], "player_seq long, PlayerId int, TeamId int, FullName string, External_Player_ID string, ValidMapping boolean, Confidence double")
    c = spark.createDataFrame([(k, f"/{k}.png", ext, name) for k, (ext, name) in enumerate(photos)], "cand_seq long, path string, external_id string, display_name string")
    return p, c


def all_scores(players, photos):
    """Every pair's score, by a join of all with all: for small tables only."""
    a, b = matching.with_names(players, "FullName"), matching.with_names(matching.rankable(photos), "display_name")
    rows = a.select("player_seq", F.col("norm").alias("n1"), F.col("tokens").alias("t1")).join(b.select("cand_seq", F.col("norm").alias("n2"), F.col("tokens").alias("t2")))
    return {(r.player_seq, r.cand_seq): r.score for r in with_name_score(rows, "t1", "n1", "t2", "n2").collect()}


def rounds(scores, threshold):
    """The rounds as told: each open player proposes its best photo, then proposals are taken from the highest confidence on."""
    people, photos = sorted({p for p, _ in scores}), sorted({c for _, c in scores})
    out = {}
    while True:
        asked = []
        for p in people:
            ranked = sorted(((-scores[p, c], c) for c in photos))
            if ranked:
                best, second = -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else 0.0
                if best >= threshold and not (best - second < 0.07 and best < 0.98):
                    asked.append((p, ranked[0][1], best))
        taken = 0
        for p, c, s in sorted(asked, key=lambda x: -x[2]):
            if p in people and c in photos:
                out[p] = (c, s)
                people.remove(p)
                photos.remove(c)
                taken += 1
        if not taken:
            return out


FIRST, LAST = ["ann", "anna", "annabel", "john", "jon", "steve", "stephen", "maria", "mario", "rodri", "rodrigo", "lee"], ["garcia", "garcias", "smith", "smyth", "clark", "clarke", "lopez", "lee", "van", "de"]


def name(rng):
    parts = [rng.choice(FIRST), *rng.sample(LAST, rng.choice([0, 1, 1, 1, 2])), *([rng.choice(FIRST)] if rng.random() < 0.2 else [])]
    rng.shuffle(parts)
    return " ".join(parts)


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.8), (3, 0.72), (4, 0.6)])
def test_rounds_equal_the_simulation(spark, seed, threshold):
    rng = random.Random(seed)
    players = [(name(rng), None) for _ in range(60)] + [(None, None), ("", None), ("12", None)]
    photos = [(f"x{k}", name(rng)) for k in range(70)] + [("", "Ann Lee"), (None, "Ann Lee"), ("y", None), ("z", "")]
    p, c = frames(spark, players, photos)
    want = rounds(all_scores(p, c), threshold)
    got = {r.player_seq: (r.cand_seq, r.score) for r in matching.assign(p, c, threshold).collect()}
    assert got == want and len(want) > 5


def test_rounds_without_margins_take_the_same(spark):
    """What equal names take is known beforehand; names without an equal photo ask for what is left, and lose what isn't."""
    rng = random.Random(5)
    pool = [name(rng) for _ in range(25)]
    pick = lambda: rng.choice(pool) if rng.random() < 0.7 else name(rng)
    p, c = frames(spark, [(pick(), None) for _ in range(50)] + [("", None), (None, None)], [(f"x{k}", pick()) for k in range(50)] + [("y", None)])
    want = rounds(all_scores(p, c), 0.72)
    got = {r.player_seq: (r.cand_seq, r.confidence) for r in mapping.map_players(p, c, 0.72, margins=False).results.where("cand_seq is not null").collect()}
    assert got == want and sum(s == 1 for _, s in got.values()) > 10 and sum(s < 1 for _, s in got.values()) > 5
    with pytest.raises(ValueError):
        mapping.map_players(p, c, scorer=scorers.StubScorer(lambda a, b: 0.5), margins=False)


def test_many_of_one_name_pair_off(spark):
    players = [("Ann Lee", None)] * 40 + [("Bob Ray", None)] * 3 + [("Anna Lee", None)]
    photos = [(f"x{k}", "Ann Lee") for k in range(25)] + [(f"y{k}", "Bob Ray") for k in range(5)] + [("z", "Lee Ann")] * 3
    p, c = frames(spark, players, photos)
    got = {r.player_seq: r.cand_seq for r in matching.assign(p, c, 0.8).collect()}
    assert got == {k: v for k, (v, _) in rounds(all_scores(p, c), 0.8).items()}
    assert len(got) >= 28


def test_pairs_left_out_cannot_matter(spark):
    rng = random.Random(9)
    longer = lambda: " ".join([name(rng), *rng.sample(["marian", "marien", "clara", "klara", "steven", "stefen"], rng.choice([0, 1, 2]))])
    p, c = frames(spark, [(longer(), None) for _ in range(150)], [(f"x{k}", longer()) for k in range(150)])
    scores = all_scores(p, c)
    a, b = matching.with_names(p, "FullName"), matching.with_names(c, "display_name")
    for threshold, bound in ((0.8, matching.STRICT), (0.45, matching.LOOSE)):
        rows = matching.name_pairs(a, b, threshold).join(a.select("player_seq", F.col("name").alias("left_name")), "left_name").join(b.select("cand_seq", F.col("name").alias("right_name")), "right_name")
        found = {(r.player_seq, r.cand_seq): r.score for r in rows.collect()}
        assert all(scores[k] == s for k, s in found.items())
        assert max(s for k, s in scores.items() if k not in found) <= bound + 1e-9
    with pytest.raises(ValueError):
        matching.name_pairs(a, b, 0.3)


def lists(scores, k, least, gap):
    """Each player's first k photos of all, by score and then by order, of those that reach least or are within gap of the best."""
    out = set()
    for p in {p for p, _ in scores}:
        ranked = sorted((-s, c) for (q, c), s in scores.items() if q == p)
        out |= {(p, c, i + 1, -s) for i, (s, c) in enumerate(ranked[:k]) if -s >= least or s - ranked[0][0] <= gap}
    return out


@pytest.mark.parametrize(("k", "least", "gap"), [(3, 0.0, 1.0), (8, 0.40, 0.30), (12, 0.25, 0.40)])
def test_lists_hold_the_best_of_all(spark, monkeypatch, k, least, gap):
    """Also photos that share nothing with a player, and names without tokens; one player's list is full by strict keys."""
    monkeypatch.setattr(far_names, "BLOCK", 5)
    rng = random.Random(4)
    people = [(name(rng), None) for _ in range(30)] + [("Zyxwv Qqq", None), ("Billy", None), ("123", None), (None, None), ("Ann Lee", None)]
    shown = [name(rng) for _ in range(25)] + ["William", "Wilhelm Kraus", "77", "Юрий"] + ["Ann Lee"] * 13
    p, c = frames(spark, people, [(f"x{i}", x) for i, x in enumerate(shown)])
    a, b = matching.with_names(p, "FullName"), matching.with_names(matching.rankable(c), "display_name")
    got = matching.ranked_candidates(matching.listed_pairs(a, b, k, least, gap), b, k, least, gap)
    rows = got.join(a.select("player_seq", F.col("name").alias("left_name")), "left_name").collect()
    want = lists(all_scores(p, c), k, least, gap)
    assert len(rows) == len(want) and {(r.player_seq, r.cand_seq, r.place, r.score) for r in rows} == want
    assert {r.player_seq for r in rows} == {p for p, *_ in want} and any(r.score <= matching.LOOSE for r in rows)


def test_known_cases(spark):
    def run(players, photos, **more):
        p, c = frames(spark, players, photos)
        out = mapping.map_players(p, c, 0.8, **more)
        return {r.player_seq: (r.external_id, r.method, round(r.confidence, 2), r.reason) for r in out.results.collect()}, out.summary.first()

    got, s = run([("Smith John", None), ("Doe Jane", None)], [("501", "Smith John"), ("502", "Doe Jane")])
    assert [got[k][:3] for k in (0, 1)] == [("501", "AiNameMatching", 1.0), ("502", "AiNameMatching", 1.0)] and (s.string, s.direct, s.matched) == (2, 0, 2)
    got, s = run([("Any", "501"), ("Name", "502"), ("Third", "501"), ("Fourth", "9")], [("501", "Any Name"), ("502", "Any Name")])
    assert (s.direct, s.unmapped) == (2, 2) and got[2][3] == got[3][3] == "External_Player_ID not found in photos"
    got, _ = run([("Conceicao Chico", None)], [("901", "Francisco Fernandes Conceição"), ("902", "Rafael Alexandre Conceição Leão")])
    assert got[0][:3] == ("901", "AiNameMatching", 0.93)
    got, _ = run([("Clark Zander", None), ("Clarke Steve", None)], [("250051123", "Alexander Clark"), ("8961", "Stephen Clarke")])
    assert got[0][0] == "250051123" and got[1][:3] == ("8961", "AiNameMatching", 0.84)
    single = scorers.StubScorer(lambda a, b: 0.96, batch_score=lambda a, b: 0.2)
    got, s = run([("Pepe", None)], [("901", "Kepler Laveran")], scorer=single)
    assert got[0][:3] == ("901", "AiNameMatching", 0.96) and (s.string, s.ai_pass_1) == (0, 1)
    got, s = run([("Coach Sylvinho", None)], [("901", "Mendes De Campo Sylvio")], scorer=scorers.StubScorer(lambda a, b: 1.0, quota=True))
    assert got[0][3] == "AI quota exhausted" and s.matched == 0
    got, _ = run([("Ann Lee", None), ("Bob", None)], [("1", "Ann Lee"), ("1", "Ann Lee")], strict_id=True)
    assert got[0][0] == "1" and got[1][1] == "NoMatch"
    got, s = run([], [])
    assert got == {} and s.processed == 0


def test_scorer_details(spark):
    class Broken:
        name = "broken"

        def one(self, a, b):
            if b == "Ann Ley":
                raise RuntimeError("down")
            return scorers.Answer(0.85)

        def many(self, pairs):
            raise ValueError("no JSON")

    p, c = frames(spark, [("Ann Lee", None), ("Lee Ann", None)], [("1", "Ann Ley"), ("2", "Ann Leigh"), ("3", "ANN LEIGH")])
    listed = scorers.shortlists(p, c, 0)
    assert {(r.player_seq, r.name2.lower()) for r in listed.collect()} == {(k, n) for k in (0, 1) for n in ("ann ley", "ann leigh")}
    answers = scorers.asked(listed, Broken(), batched=True)
    assert {(r.name2, r.error) for r in answers.collect()} == {("Ann Ley", "down"), ("Ann Leigh", None)}
    assert {(r.player_seq, r.reason) for r in scorers.judged(answers, 0.8, 0.08).collect()} == {(0, "accepted"), (1, "accepted")}
    same = scorers.asked(scorers.shortlists(*frames(spark, [("Ann Lee", None)], [("1", "Lee Ann")]), 0), scorers.StubScorer(lambda a, b: 0.0), batched=True).first()
    assert same.confidence == 0.99 and same.calls == 0
    with pytest.raises(ValueError):
        scorers.make_scorer("openai:")
    scorers.register("mine", lambda model: scorers.StubScorer(lambda a, b: 1.0, name=model))
    assert scorers.make_scorer("mine:x").name == "x"


def test_numbered_places(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN null ELSE cast(id % 5 AS string) END AS k", "(id * 7919) % 3000 AS v")
    got, want = defaultdict(dict), defaultdict(list)
    for r in numbering.numbered(rows, ["k"], ["v"]).collect():
        got[r.k][r.v] = r.place
    for r in rows.collect():
        want[r.k].append(r.v)
    assert got == {k: {v: i for i, v in enumerate(sorted(vs), 1)} for k, vs in want.items()}
    assert numbering.numbered(rows.where("false"), ["k"], ["v"]).count() == 0


def test_merging(spark):
    kinds = "PlayerId int, External_Player_ID string, ValidMapping boolean, Confidence double"
    now = spark.createDataFrame([(1, None, False, 0.0), (2, "n", True, 0.9), (3, "", False, 0.0), (4, None, False, 0.0)], kinds)
    old = spark.createDataFrame([(1, "o", True, 1.0), (2, "o", True, 1.0), (3, None, False, 0.0)], kinds)
    got = {r.PlayerId: (r.External_Player_ID, r.Confidence, r.preserved) for r in merging.merge_prior(now, old).collect()}
    assert got == {1: ("o", 1.0, True), 2: ("n", 0.9, False), 3: (None, 0.0, True), 4: (None, 0.0, False)}
    edits = spark.createDataFrame([(4, "m"), (1, " "), (9, "x")], "PlayerId int, External_Player_ID string")
    got = {r.PlayerId: (r.External_Player_ID, r.ValidMapping) for r in merging.apply_manual(now, edits).collect()}
    assert got == {1: (None, False), 2: ("n", True), 3: ("", False), 4: ("m", True)}
    both = merging.upsert(old.withColumn("t", F.lit(1)), now.withColumn("t", F.lit(1)), ["PlayerId"], "t")
    assert {r.PlayerId: r.Confidence for r in both.collect()} == {1: 0.0, 2: 0.9, 3: 0.0, 4: 0.0}


def test_entry_runs_whole(spark):
    players, _ = queries.people_and_photos(spark, "/root/testdata/sf0.001")
    rows = queries.map_run(spark, "/root/testdata/sf0.001")
    assert rows.count() == players.count() == rows.select("player_seq").distinct().count()
    taken = [r.cand_seq for r in rows.where("cand_seq is not null").collect()]
    assert len(taken) == len(set(taken)) > 50


def test_rank_query_lists_three_of_all(spark):
    p, c = queries.people_and_photos(spark, "/root/testdata/sf0.001")
    want = {(a, b, place, round(s, 9)) for a, b, place, s in lists(all_scores(p, c), 3, 0.0, 1.0)}
    assert {tuple(r) for r in queries.rank_topk_margin(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("number", [0, 1])
def test_shortlists_take_the_best_of_all(spark, number):
    """A nickname or another script shares no token with the photo it stands for, and is asked about all the same."""
    people = [("Billy Zz", None), ("Дмитро Іваненко", None), ("Ann Lee", None), ("John Smith", None)]
    shown = ["William Kraus", "Dmytro Ivanenko", "Lee Ann", "Jon Smyth", "Mario Garcia"]
    p, c = frames(spark, people, [(f"x{i}", x) for i, x in enumerate(shown)])
    want = lists(all_scores(p, c), *[schemas.PASSES[number][k] for k in ("k", "least", "gap")])
    got = {(r.player_seq, r.cand_seq, r.place, r.score) for r in scorers.shortlists(p, c, number).collect()}
    assert got == want and {r[0] for r in got} == {0, 1, 2, 3}


def test_a_run_brings_names_together_once(spark, monkeypatch):
    """The rounds and both passes of a scorer go by the same pairs, and list what each would list by itself."""
    met, real = [], matching.met_pairs
    monkeypatch.setattr(matching, "met_pairs", lambda both, left, bound: met.append(bound) or real(both, left, bound))
    names = [f"{a} {b}" for a in ("Ann", "Anne", "Lee") for b in ("Garcia", "Garcias", "Smith")]
    p, c = frames(spark, [(x, None) for x in [*names, "Billy Zz", ""]], [(f"x{i}", f"{x} {y}".strip()) for i, (x, y) in enumerate((x, y) for x in names for y in ("", "Mia"))])
    run = mapping.map_players(p, c, 0.8, scorer=scorers.StubScorer(lambda a, b: 0.5), second_pass=True)
    assert met.count(matching.TOP) == 1 and run.results.count() == p.count()
    a, b = matching.with_names(p, "FullName"), matching.with_names(matching.rankable(c), "display_name")
    known = matching.top_pairs(a, b, Scratch(spark))
    some, left = F.col("player_seq") % 3 > 0, F.col("cand_seq") % 4 > 0
    for number in (0, 1):
        want = {tuple(r) for r in scorers.shortlists(p.where(some), c.where(left), number).drop("tokens1", "tokens2").collect()}
        met.clear()
        got = {tuple(r) for r in scorers.shortlists(a.where(some), b.where(left), number, known).drop("tokens1", "tokens2").collect()}
        assert got == want and len({r[1] for r in got}) > 5 and matching.TOP not in met


def test_short_lists_are_filled_again(spark, monkeypatch):
    """Names that ask for photos which others win, one after another, until looser keys have to bring more."""
    monkeypatch.setattr(matching, "LISTED", 2)
    people = [(x, None) for x in ["Ann Lee Garcia", "Anna Lee Garcia", "Ann Lea Garcia", "Ann Leo Garcia", "Lee Garcia", "Garcia Ann", "Ann Clarke", "Ann Clark", "Ann Clarks"]]
    shown = ["Ann Lee Garcia", "Lee Ann Garcia Xy", "Garcia Lee", "Ann Garcia", "Ann Leo Garcia", "Ann Clark", "Ann Clarkes", "Ann Smith Clark", "Ann Lea Garcias"]
    p, c = frames(spark, people, [(f"x{i}", x) for i, x in enumerate(shown)])
    got = {r.player_seq: (r.cand_seq, r.score) for r in matching.assign(p, c, 0.72).collect()}
    assert got == rounds(all_scores(p, c), 0.72) and len(got) > 3


def test_keys_of_long_names_are_few():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for tokens in ([word(7) for _ in range(40)], [word(7) for _ in range(400)], [word(5000), "ann"]):
        for bound in (matching.TOP, matching.STRICT, matching.LOOSE):
            letters = sum(map(len, tokens))
            assert len(matching.keys_of_name(" ".join(tokens), tokens, "L", "R", bound)) < 60 + 4 * letters
    assert len(matching.keys_of_name("x", [word(7) for _ in range(24)], "L", "R", matching.STRICT)) < 10_000


def test_nearly_same_names_share_a_key_and_others_hardly():
    rng = random.Random(8)
    letters = "abcdefghij"
    for _ in range(3000):
        size = rng.randint(1, 20)
        a = [rng.choice(letters) for _ in range(size)]
        b = [*a, *(rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 2])))]
        differ = (1 if len(b) <= 10 else 2) - (len(b) - len(a))
        for k in rng.sample(range(size), max(0, min(size, differ))):
            b[k] = rng.choice(letters)
        if differ >= 0:
            assert matching.near_keys("".join(a)) & matching.near_keys("".join(b))
    # numbered people: whoever meets differs in three of the places at most, not in two thirds of them
    names = [f"hot gear {k:06d}x".translate(str.maketrans("0123456789", letters)) for k in range(0, 400_000, 97)]
    met = defaultdict(set)
    for n in names:
        for k in matching.near_keys(n):
            met[k].add(n)
    pairs = {(a, b) for ns in met.values() for a in ns for b in ns if a < b}
    assert pairs and max(sum(x != y for x, y in zip(a, b, strict=True)) for a, b in pairs) <= 3


def test_best_pairs_propose_what_all_pairs_do(spark, monkeypatch):
    """Names with two photos above TOP don't meet by looser keys; what is proposed stays the same."""
    rng = random.Random(12)
    people, shown = [name(rng) for _ in range(60)] + ["Rod Rolando Garcia"], [name(rng) for _ in range(90)] + ["Rolando Garcia"] * 2
    p, c = frames(spark, [(x, None) for x in people], [(f"x{i}", x) for i, x in enumerate(shown)])
    a, b = matching.with_names(p, "FullName"), matching.with_names(matching.rankable(c), "display_name")
    want = {tuple(r) for r in matching.proposals(a, b, matching.name_pairs(a, b, 0.8), 0.8).collect()}
    asked, met = [], matching.met_pairs

    def seen(both, left, bound):
        asked.append((bound, {r[0] for r in left.select("name").collect()}))
        return met(both, left, bound)

    monkeypatch.setattr(matching, "met_pairs", seen)
    got = {tuple(r) for r in matching.proposals(a, b, matching.best_pairs(a, b, 0.8), 0.8).collect()}
    assert got == want and len(want) > 5
    assert [x for x, _ in asked] == [matching.TOP, matching.STRICT] and asked[1][1] < asked[0][1]
    assert not any(x.startswith("rod rolando garcia") for x in asked[1][1])


def test_no_join_of_all_with_all(spark):
    """Nothing but equality joins, also where lists are filled by bounds."""
    p, c = frames(spark, [("Zyxwv Qqq", None), ("Ann Lee", None)], [(f"x{i}", x) for i, x in enumerate(["Bob Ray", "Ann Lee", "Jo Sutton"])])
    a, b = matching.with_names(p, "FullName"), matching.with_names(matching.rankable(c), "display_name")
    plans, write = [], matching.Scratch.write

    def seen(self, df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, tag)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching.Scratch, "write", seen)
        assert matching.listed_pairs(a, b, 3, 0.0, 1.0).count() == 6
    assert len(plans) > 20 and not any("Cartesian" in x or "NestedLoop" in x for x in plans)
