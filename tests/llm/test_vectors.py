"""Centroid clustering, whitening and URL filters against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import clustering, queries, urls, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, entries that are null or not finite, other lengths, ties, repeated rows and huge numbers."""
    draw = np.random.default_rng(1)
    rows = [(k, [float(v) for v in draw.normal(size=4)], "x", None) for k in range(40)]
    rows += [(100 + k, [1.0, 1.0, 1.0, 1.0], None, "y") for k in range(30)] + [rows[3], rows[3]] + [(None, [0.5, -0.25, 2.0, 0.0], "x", "y")] * 2
    rows += [(200, None, "x", "y"), (201, [], "x", "y"), (202, [1.0, None, 2.0, 3.0], "x", "y"), (203, [1.0, math.nan, 2.0, 3.0], "x", "y"), (204, [math.inf, 0.0, 0.0, 0.0], None, None)]
    return spark.createDataFrame([*rows, (205, [1.0] * 5, "x", "y"), (206, [3e38, 0.0, 0.0, 0.0], "x", "y")], SCHEMA)


# --- centroid clustering


def plain_clusters(rows, dim, k, rounds):
    """Python's own whole numbers, all vectors against all centroids."""
    x = [(v, [math.floor(1024 * float(np.float32(c))) for c in e]) for v, e in rows if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e)]
    x = [(v, e) for v, e in x if max(map(abs, e)) < 1 << 28]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    centroids = [e for _, e in sorted(x, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for r in range(rounds + 1):
        own = [min((far(e, c), n) for n, c in enumerate(centroids)) for _, e in x]
        if r < rounds:
            for n in range(len(centroids)):
                if members := [e for (_, e), (_, c) in zip(x, own, strict=True) if c == n]:
                    centroids[n] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return sorted((str(v), c, d) for (v, _), (d, c) in zip(x, own, strict=True)), centroids


@pytest.mark.parametrize("k", [1, 5, 200])
def test_clusters(odd, k):
    found = clustering.annulus_clusters(odd, dim=4, k=k, rounds=4)
    want, centroids = plain_clusters([(r.vec_id, r.embedding) for r in odd.collect()], 4, k, 4)
    rows = found.rows.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in rows if r.cluster is not None) == want and found.centroids.tolist() == centroids
    assert [(r.vec_id, r.distance) for r in rows if r.cluster is None] == [(206, None)]
    assert sum(found.inertia) == sum(d for _, _, d in want)


def test_clusters_of_nothing(odd):
    for rows in (odd.where("false"), odd.where("vec_id = 206")):
        found = clustering.annulus_clusters(rows, dim=4)
        assert found.inertia == [] and {r.cluster for r in found.rows.collect()} <= {None}


def test_nearest_compares_the_annulus_alone():
    draw = np.random.default_rng(2)
    centroids = draw.integers(-50, 50, (300, 3)) * np.repeat(np.arange(1, 31), 10)[:, None]
    centroids[250:] = centroids[200:250]  # equal centroids: the first counts
    x = np.vstack([draw.integers(-1500, 1500, (500, 3)), centroids[:40], np.zeros((1, 3), np.int64)])
    d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    hint, tried = np.zeros(len(x), np.int64), []
    for _ in range(2):  # the second time with the nearest centroids as hints
        hint, least, compared = clustering.nearest(x, hint, centroids)
        assert (hint == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        tried.append(compared)
    assert tried[1] < tried[0] < d.size and tried[1] < 0.5 * d.size


def test_a_tie_on_the_edge_of_the_annulus():
    x, centroids = np.array([[10, 0]]), np.array([[14, 0], [10, 4], [6, 0]])  # norms 14 and 6 are both just as far as the distance
    for hint in range(3):
        assert clustering.nearest(x, np.array([hint]), centroids)[:2] == (np.array([0]), np.array([16]))


def test_centroids_are_bounded(odd):
    with pytest.raises(ValueError):
        clustering.annulus_clusters(odd, dim=4, k=1 << 22)


# --- whitening


def plain_whitening(vectors, shift, p):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)) + shift
    c = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(c.T @ c / len(x))
    keep = [k for k in np.argsort(-values)[:p] if values[k] > 1e-13 * values.max()]
    return c, values[keep], turn[:, keep], values.sum(), x.astype(int).tolist()


@pytest.mark.parametrize("kind", ["flat", "steep", "thin"])
def test_whitening(spark, kind):
    draw = np.random.default_rng(3)
    made = draw.normal(size=(400, 40))
    if kind == "steep":  # found with few directions
        made = made * 0.3 ** np.arange(40) * 300
    if kind == "thin":  # of three dimensions only
        made = np.round(made[:, :3] * 8) @ np.eye(3, 40)
    rows = spark.createDataFrame([(k, [float(v) for v in e], None, None) for k, e in enumerate(made)], SCHEMA)
    model = whitening.whiten(rows, components=8, shift=100_000)
    c, values, turn, trace, x = plain_whitening(made, 100_000, 8)
    assert model.n == 400 and len(model.eigenvalues) == (3 if kind == "thin" else 8) and np.allclose(model.eigenvalues, values, rtol=1e-11)
    assert model.size == (40 if kind == "flat" else 16)
    if kind != "steep":
        assert np.allclose(np.abs((model.components * turn).sum(axis=0)), 1, atol=1e-12)
    assert np.allclose(model.explained, values / trace, rtol=1e-10)
    got = {r.vec_id: r for r in model.whitened().collect()}
    sums = [sum(col) for col in zip(*x, strict=True)]
    for k in range(400):
        want = c[k] @ turn / np.sqrt(values)
        assert np.allclose(np.abs(got[k].whitened), np.abs(want), atol=1e-7 if kind == "steep" else 1e-9)
        assert got[k].deviation == sum((400 * v - s) ** 2 for v, s in zip(x[k], sums, strict=True))
    assert model.identity_error() < 1e-9
    flat = whitening.whitening_rows(model).collect()
    assert len(flat) == 400 * len(values) and {r.component for r in flat} == set(range(1, len(values) + 1))


def test_whitening_of_odd_rows(odd, spark):
    model = whitening.whiten(odd, components=8)  # 206 isn't within 2**40, 205 has another length
    kept = [r for r in odd.collect() if r.embedding and len(r.embedding) == 4 and all(v is not None and math.isfinite(v) for v in r.embedding) and r.vec_id != 206]
    assert model.n == len(kept) and len(model.eigenvalues) == 4 and model.identity_error() < 1e-9
    assert sorted(str(r.vec_id) for r in model.whitened().collect()) == sorted(str(r.vec_id) for r in kept)
    for none in (odd.where("false"), odd.where("vec_id between 200 and 204"), odd.where("vec_id = 7"), odd.where("vec_id = 3")):  # one row or equal rows span nothing
        assert whitening.whitening_rows(whitening.whiten(none)).collect() == []


def test_deviations_beyond_longs():
    n, sums = 3_000_000_000, [0]
    x = np.array([[1], [0], [2], [-1]])
    assert whitening.deviations(x, n, sums).to_pylist() == [9 * 10**18, 0, None, 9 * 10**18]
    edge = 3_037_000_499  # its square is the last below 2**63
    assert whitening.deviations(np.array([[1]]), edge, [0]).to_pylist() == [edge**2] and whitening.deviations(np.array([[1]]), edge + 1, [0]).to_pylist() == [None]


def test_whitening_query(spark):
    rows = queries.op12_whitening(spark, SF).collect()
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    c, values, turn, trace, x = plain_whitening([r.embedding for r in source], 100_000, 8)
    place = {r.vec_id: k for k, r in enumerate(source)}
    want = c @ turn / np.sqrt(values)
    flip = {}
    assert len(rows) == 8 * len(source) and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for r in rows:
        w = want[place[r.vec_id], r.component - 1]
        flip.setdefault(r.component, np.sign(w * r.whitened))
        assert r.whitened * flip[r.component] == pytest.approx(w, abs=1e-8) and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10) and r.n == len(source)


# --- URL filters

ODD = [
    None, "", "example.com/en/", "http://", "http:///en/1", "https://Example.COM/en/1?x=http://a.net/es/", "a://www.example.com/en/", "https://m.www.example.com/en/2", "https://notexample.com/en/3",
    "https://example.com", "https://example.com?ref=x", "https://example.com#/en/", "https://x.net/es", "https://x.net/es/", "https://net/fr/?q", "https://x.net:80/fr/1", "https://x.org/a?ref=1", "https://x.org/a?xref=1",
    "https://x.org/?page=1", "https://x.org/?page=1&ref=x", "https://x.org/?page=12&ref=x", "https://ads.x.org/", "https://ads1.x.org/", "https://b.ads.x.org/t", "https://ünï.org/é/LOGIN", "https://ünï.org/login", "https://ünï.org/logins",
    "https://x.net/" + "a" * 100_000 + "?utm_source=1", "https://x.org/\n?ref=1", "http://a.b://c.com/d",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, u, "x", None) for k, u in enumerate([*ODD, ODD[5], ODD[5]])], "page_id long, url string, Host string, verdict string")


def plain_verdict(url, rules):
    """All rules on the URL, place rules without any regular expression."""
    host, path, rest = "", "", ""
    if "://" in (url or ""):
        tail = url[url.index("://") + 3 :]
        cut = min([tail.index(c) for c in "/?#" if c in tail], default=len(tail))
        host, rest = "".join(c.lower() if c.isascii() else c for c in tail[:cut]), tail[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    places, patterns = [], []
    for r in rules:
        if r.place:
            name, slash, way = r.text.partition("/")
            if (host or rest) and ("." + host).endswith("." + name) and path.startswith(slash + way):
                places.append(r)
        elif (host or rest) and re.match(r.pattern, host + rest):
            patterns.append(r)
    place = max(places, key=lambda r: len(r.text), default=None)
    pattern = None if place else max(patterns, key=lambda r: (r.verdict == "allow", len(r.text), r.text), default=None)
    return host, path, place and place.text, pattern and pattern.text, (place or pattern).verdict if place or pattern else "allow"


@pytest.mark.parametrize("task_bytes", [1 << 20, 0])
def test_urls(spark, pages, task_bytes):
    rules = [*queries.PLACES, *urls.PATTERNS, urls.place_rule("block", "ünï.org"), urls.place_rule("allow", "x.org", "/a"), urls.pattern_rule("|b.ads"), urls.pattern_rule("*")]
    out = urls.url_verdicts(pages, rules, task_bytes=task_bytes)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "pattern", "verdict"]
    rows = out.collect()
    assert sorted(r.page_id for r in rows) == list(range(len(ODD) + 2))
    for r in rows:
        assert (r["host"], r.path, r.rule, r.pattern, r.verdict) == plain_verdict(r.url, rules), r.url[:80]


def test_urls_without_rules_or_rows(pages):
    assert {(r.rule, r.verdict) for r in urls.url_verdicts(pages, [], default="block").collect()} == {(None, "block")}
    for n in (1 << 20, 0):
        assert urls.url_verdicts(pages.where("false"), queries.PLACES, task_bytes=n).collect() == []


@pytest.mark.parametrize("text,fits,fails", [
    ("^ref=", ["a.com/?ref=", "a.com/x&ref=1"], ["a.com/?xref=1", "a.com/?ref"]), ("/login^", ["a.com/login", "a.com/x/login?b"], ["a.com/logins", "a.com/login-x"]), ("||ads.*^", ["ads.x/", "b.ads.x"], ["bads.x/", "x.org/ads.x/"]),
    ("|b.", ["b.com"], ["a.b.com"]), ("x|", ["a.com/x"], ["a.com/xy"]), ("a*z", ["a.com/z", "q.com/a\nz"], ["z.com/q/b"]),
])
def test_patterns(text, fits, fails):
    pattern = re.compile(urls.pattern_rule(text).pattern)
    assert all(pattern.match(s) for s in fits) and not any(pattern.match(s) for s in fails)


def test_rules_are_filed_by_their_rarest_token(spark, pages):
    rules = [*queries.PLACES, urls.pattern_rule("^utm_source="), urls.pattern_rule("a*b")]
    assert [set(r.tokens) for r in rules[-3:]] == [{"net", "fr"}, {"utm", "source"}, set()]
    counts = urls.token_counts(pages, "url", {t for r in rules for t in r.tokens})
    assert counts["fr"] == 2 and counts["net"] == 8
    index = urls.filed(rules, counts)
    assert [r.text for r in index["fr"]] == ["net/fr/"] and [r.text for r in index["com"]] == ["com/"] and [r.text for r in index[""]] == ["a*b"] and "net" not in index
    tries = urls.Tries(index)
    tries.best("a.org", "/x?y=1")
    assert tries.tried == 1  # only the rule without a token


def test_place_rules_are_checked():
    for host, path in (("a/b", ""), ("a", "b"), ("a", "/b?c")):
        with pytest.raises(ValueError):
            urls.place_rule("block", host, path)


def test_queries_and_sql_agree(spark):
    import duckdb

    for name, table in (("op11_annulus_clusters", "embeddings"), ("op13_url_filters", "pages")):
        out = queries.QUERIES[name](spark, SF)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        assert sorted(map(repr, map(tuple, out.select(*sorted(out.columns)).collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(sorted(out.columns))} FROM ({queries.SQL[name]})").fetchall()))
    assert out.where(F.col("rule").isNotNull()).count() > 20
