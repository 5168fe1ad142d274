"""Runs over teams: what goes wrong stays with its team, and names and ids match within teams only."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftlink.functions import text
from weftlink.operators import matching
from weftlink.plans import batches, mapping, queries

ROWS = "PlayerId string, TeamId string, FamilyName string, SurName string, External_Player_ID string, folder string, seq long"
PHOTOS = "folder string, path string, external_id string, display_name string, TeamId int, seq long"
TEAMS = "TeamId int, TeamName string, SafeTeamName string"


def rows(spark, *players):
    return spark.createDataFrame([(*p, "x", n) for n, p in enumerate(players)], ROWS)


def photos(spark, *shown):
    return spark.createDataFrame([(f, f"/{f}/{n}.png", i, name, 99, n) for n, (f, i, name) in enumerate(shown)], PHOTOS)


def teams(spark, *names):
    return spark.createDataFrame([(k + 1, n, n) for k, n in enumerate(names)], TEAMS)


def states(batch):
    return {r.TeamId: (r.status, r.message, r.extracted, r.mapped, r.unmapped) for r in batch.states.collect()}


def output(rows):
    return {(r.TeamId, r.PlayerId): r.External_Player_ID for r in rows.collect()}


def test_errors_stay_with_their_team(spark, tmp_path):
    path, every = str(tmp_path / "out"), teams(spark, "Red", "Blue", "Green", "Grey", "Off", "Late")
    first = rows(spark, ("1", "1", "Anna", "Berg", "A1"), ("2", "2", "Anna", "Berg", None), ("3", "2", "Carl", "Dahl", None), ("4", "3", "Eva", "Falk", None), ("5", "4", "Olga", "Holm", "h"), ("6", "5", "Ivo", "Juhl", None), ("7", "6", "Kim", "Lund", None))
    shown = photos(spark, ("RED", "a1", "someone"), ("Red", "A1", "later"), ("Blue", "b2", "Anna Berg"), ("Green", "g4", "Eva Falk"), ("Off", "o6", "Ivo Juhl"), ("Late", "l7", "Kim Lund"), (None, "n", "Anna Berg"), ("Nobody's", "q", "Carl Dahl"))
    done = batches.run_teams(every, first, shown, path, disabled=[5], failed=spark.createDataFrame([(6, "the list of photos can't be read")], "TeamId int, message string"))
    assert states(done) == {
        1: ("Completed", "", 1, 1, 0),
        2: ("Completed", "", 2, 1, 1),
        3: ("Completed", "", 1, 1, 0),
        4: ("Skipped", "no folder of photos", 1, 0, 0),
        5: ("Skipped", "switched off", 0, 0, 0),
        6: ("Failed", "the list of photos can't be read", 0, 0, 0),
    }
    assert output(done.output) == {(1, 1): "a1", (2, 2): "b2", (2, 3): None, (3, 4): "g4"}

    # Red can't be read now and keeps what it had; Blue keeps an id and loses a player; Green has no players any more.
    second = rows(spark, ("1", "1", "Anna", "Berg", "A1"), ("x9", "1", "", "", None), (None, "1", None, None, None), ("3", "2", "Carl", "Dahl", None), ("2", "2", "Zoe", None, None), ("8", "none", "", "", None), ("9", None, "", "", None))
    done = batches.run_teams(every, second, photos(spark, ("Red", "new", "Anna Berg"), ("Blue", "c3", "Carl Dahl"), ("Green", "g4", "Eva Falk")), path, keep_prior=True)
    assert states(done)[1] == ("Failed", "PlayerId isn't a number: x9, and 1 more", 0, 0, 0)
    assert states(done)[2] == ("Completed", "", 2, 2, 0) and states(done)[3] == ("Completed", "", 0, 0, 0)
    assert output(done.output) == {(1, 1): "a1", (2, 2): "b2", (2, 3): "c3"}


def test_outputs_that_are_there_are_kept(spark, tmp_path):
    path, every = str(tmp_path / "out"), teams(spark, "Red", "Blue")
    shown = photos(spark, ("Red", "r1", "Anna Berg"), ("Blue", "b2", "Carl Dahl"))
    batches.run_teams(every, rows(spark, ("1", "1", "Anna", "Berg", None)), shown, path, disabled=[2])
    done = batches.run_teams(every, rows(spark, ("bad", "1", "", "", None), ("2", "2", "Carl", "Dahl", None)), shown, path, skip_existing=True)
    assert states(done) == {1: ("Completed", "output was there", 1, 1, 0), 2: ("Completed", "", 1, 1, 0)}
    assert output(done.output) == {(1, 1): "r1", (2, 2): "b2"}


def test_no_rows(spark, tmp_path):
    done = batches.run_teams(teams(spark, "Red"), rows(spark), photos(spark), str(tmp_path / "out"))
    assert states(done) == {1: ("Skipped", "no folder of photos", 0, 0, 0)} and output(done.output) == {}
    done = batches.run_teams(teams(spark, "Red").where("false"), rows(spark, ("1", "1", "a", "b", None)), photos(spark), str(tmp_path / "out"))
    assert states(done) == {} and output(done.output) == {}


def test_teams_match_as_if_each_were_alone(spark):
    people = [(n, t, f"{first} {last}") for n, (t, first, last) in enumerate((t, f, s) for t in (1, 2, None) for f in ("Anna", "Carla", "Carlo") for s in ("Berg", "Dahl", "Berg"))]
    shown = [(100 + n, t, str(n), name) for n, (t, name) in enumerate((t, x) for t in (1, 2, 3) for x in ("Berg Anna", "Carla Berg", "Carla Berg", "Carlo Dahl", "Dahl"))]
    p, c = "player_seq long, TeamId int, FullName string", "cand_seq long, TeamId int, external_id string, display_name string"
    together = matching.assign(spark.createDataFrame(people, p), spark.createDataFrame(shown, c), 0.8, within="TeamId")
    want = []
    for t in (1, 2):
        alone = matching.assign(spark.createDataFrame([x for x in people if x[1] == t], p), spark.createDataFrame([x for x in shown if x[1] == t], c), 0.8)
        want += [tuple(r) for r in alone.collect()]
    got = Counter(tuple(r) for r in together.collect())
    assert got == Counter(want) and len(want) > 4


def test_names_with_their_equals_meet_no_others(spark, tmp_path, monkeypatch):
    """All of a team's names are nearly the same, so that pairs would grow with its square: nobody meets for photos that equal names take."""
    met, real = [], matching.met_pairs
    monkeypatch.setattr(matching, "met_pairs", lambda both, left, bound: met.append((left.count(), both.right.count())) or real(both, left, bound))
    numbered = spark.range(1, 121).selectExpr("string(id) AS PlayerId", "string(id % 2 + 1) AS TeamId", f"{queries.NUMBERED_NAME.format('id')} AS FamilyName", "'' AS SurName", "string(null) AS External_Player_ID", "'x' AS folder", "id AS seq")
    shown = numbered.where("seq % 7 > 0").selectExpr("CASE TeamId WHEN '1' THEN 'Red' ELSE 'Blue' END AS folder", "concat('/', seq) AS path", "concat('N', seq) AS external_id", "FamilyName AS display_name", "99 AS TeamId", "seq")
    done = batches.run_teams(teams(spark, "Red", "Blue"), numbered, shown, str(tmp_path / "out"))
    assert {k[1]: v for k, v in output(done.output).items()} == {k: f"N{k}" if k % 7 else None for k in range(1, 121)} and not met

    # photos that no equal name takes are what names meet for; the few that reach one are compared with all
    more = shown.unionByName(photos(spark, ("Red", "z", f"{numbered.where('seq = 14').first().FamilyName} Zyx")))
    done = batches.run_teams(teams(spark, "Red", "Blue"), numbered, more, str(tmp_path / "out"))
    assert {k[1]: v for k, v in output(done.output).items()} == {k: f"N{k}" if k % 7 else "z" if k == 14 else None for k in range(1, 121)}
    assert met and max(a for a, _ in met) == 17 and min(b for _, b in met) == 1


def test_within_has_no_scorer(spark):
    with pytest.raises(ValueError):
        mapping.map_players(None, None, strict_id=True, within="TeamId")


def test_names_of_a_large_team_stay_apart(spark):
    """batch_run's SQL takes a team's names as different: they have to be so when they are normalised, too."""
    names = spark.range(1, 40_001).selectExpr(f"{queries.NUMBERED_NAME.format('id')} AS n")
    assert names.select(text.normalize_name(F.col("n"))).distinct().count() == 40_000
