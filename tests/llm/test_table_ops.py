"""Operators over whole tables, against brute force, round trips and their laws."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlink.llm import components as components_module
from weftlink.llm import decontaminate, mixing, ngram_join, quality_rules, queries, sharding, warc
from weftlink.llm.common import table
from weftlink.llm.components import components

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing


def level_of(sizes, weights, share):
    """Targets by pouring: shares by weight, what is above a source's cap goes to the others, again and again."""
    caps, goal = {s: 2 * n for s, n in sizes.items()}, share * sum(sizes.values())
    full: set = set()
    while True:
        open_ = [s for s in sizes if s not in full]
        left = goal - sum(caps[s] for s in full)
        level = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] >= caps[s]}
        if not over:
            return {s: level.get(s, caps[s]) for s in sizes}
        full |= over
        if len(full) == len(sizes):
            return caps


@pytest.mark.parametrize("source", ["odd", "sample", "one"])
def test_mixture(spark, docs, sample, source):
    rows = {"odd": docs, "sample": sample, "one": docs.where("doc_id = 9")}[source].select("doc_id", "source", "text")
    rows = rows.withColumn("h", mixing.mix_hash()).withColumn("size", mixing.n_words())
    out = mixing.mix(rows, rows.select("source", "h", "size"), shares=(0.5, 1.5)).collect()
    assert len(out) == rows.count() and all(r["size"] == len(words(r.text)) for r in out)
    sizes = collections.Counter()
    for r in out:
        sizes[r.source] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = level_of(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5)
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2 and list(r.copies_by_share) == sorted(r.copies_by_share)
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"] * sum(x.h == r.h and x.source == r.source for x in out))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_mixture_of_nothing_and_repeats(spark, docs, empty):
    assert mixing.mixed_documents(empty).count() == 0
    one, two = (sorted(map(str, mixing.mixed_documents(d).collect())) for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert one == two and mixing.mixed_documents(docs).columns == docs.columns
    none = docs.where("text is null or text = ''")
    rows = none.select("source", "text", "doc_id").withColumn("h", mixing.mix_hash()).withColumn("size", mixing.n_words())
    assert {(r.target, r.copies) for r in mixing.mix(rows, rows.select("source", "h", "size")).collect()} == {(0.0, 1)}


# --- near copies


def grams(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = words((text or "").translate(lower))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """(id, text) to (class, copies, links), all pairs compared."""
    sets = [grams(t) for _, t in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, sum(sets[k] == sets[i] for k in links[i]), len(links[i])))
    return sorted(out, key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies, some with a common text from which each differs elsewhere, among texts of their own."""
    rng = random.Random(1)
    rows = []
    for _ in range(6):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200)))
        rows += [edited(rng, base, rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randrange(1, 14))]
    rows += [" ".join(f"x{rng.randrange(400)}" for _ in range(rng.randrange(1, 50))) for _ in range(20)]
    rows += ["a b", "A B", "a  b\n", "", None, "  "]
    return [(k, t) for k, t in enumerate(rows)] + [(None, rows[0]), (None, rows[0]), (3, rows[3])]


@pytest.mark.parametrize(("load", "most", "block"), [(ngram_join.BLOCK_LOAD, ngram_join.MOST_BLOCKS, ngram_join.BLOCK_ROWS), (150, 3, 400), (1 << 20, 0, 2)])
def test_classes(spark, copies, load, most, block):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = [(r.id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.ngram_classes(docs, load=load, most=most, rows=block).collect()]
    assert sorted(got, key=str) == brute_classes(copies)


def test_classes_of_odd_rows(spark, docs, empty, copies):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.ngram_classes(docs).collect()]
    assert sorted(got, key=str) == brute_classes(rows)
    assert ngram_join.ngram_classes(empty).count() == 0 and ngram_join.without_near_copies(empty).count() == 0
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 3, 4, 5, 6, 8, 9, 10, 11]))
    many = spark.createDataFrame(copies, "doc_id long, text string")
    classes = brute_classes(copies)
    assert ngram_join.without_near_copies(many).count() == len({c for _, c, _, n in classes if n}) + sum(n == 0 for *_, n in classes)


def test_bands_reach_the_recall():
    for similar in (0.7, 0.8, 0.9):
        n = ngram_join.band_count(similar, 0.999)
        assert 1 - (1 - similar**ngram_join.ROWS) ** n >= 0.999 > 1 - (1 - similar**ngram_join.ROWS) ** (n - 1)


def test_minima_estimate_similarity():
    """A row of the signature agrees as often as the sets are alike."""
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2700], pool[300:]
    rows, ngram_join.ROWS = ngram_join.ROWS, 1
    try:
        sign = ngram_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([2700, 2700]), 2000)
    finally:
        ngram_join.ROWS = rows
    assert abs((sign[0] == sign[1]).mean() - 0.8) < 0.03


@pytest.mark.parametrize("hub", [components_module.HUB, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components_module, "HUB", hub)
    monkeypatch.setattr(components_module, "HUBS", 1000)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.createDataFrame([(k, 0) for k in range(1, 60)], "a long, b long")
    assert {(r.node, r.root) for r in components(star).collect()} == {(k, 0) for k in range(60)}


# --- WARC


@pytest.mark.parametrize(("chunk", "hot"), [(warc.CHUNK_BYTES, warc.HOT_COPIES), (7, 2)])
def test_archives_come_back(spark, tmp_path, monkeypatch, chunk, hot):
    monkeypatch.setattr(warc, "HOT_COPIES", hot)
    html = ["<p>x</p>", "<p>x</p>", None, "", "a\r\n\r\nb\r\n\r\n", "\r\n\r\n", "\r\n", "é漢字" * 50, "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n", "long " * 3000, "<p>x</p>", "end\r", "\r\n\r\n\r\n\r\nx"]
    rows = [(k, f"http://x/{k}\r\n y" if k % 2 else None, t, "more") for k, t in enumerate(html)] + [(None, None, "<p>x</p>", None), (None, None, "alone", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_archives(pages, f"file://{tmp_path}/w", chunk=chunk)
    parts = collections.defaultdict(list)
    for r in warc.read_chunks(spark, f"file://{tmp_path}/w").where("record_type <> 'warcinfo'").collect():
        parts[r.page_id, r.record_id].append(r)
    assert len(parts) == len(rows)
    text = {}
    for (page, _), p in parts.items():
        p.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in p] == list(range(len(p))) and [r["last"] for r in p] == [False] * (len(p) - 1) + [True]
        done, digest = b"", hashlib.sha1()
        for r in p if p[0].record_type == "response" else []:
            done += bytes(r.payload)
            digest.update(bytes(r.payload))
            assert len(r.payload) <= max(chunk, 4) and r.payload_bytes == len(done) and r.payload_digest == base64.b32encode(digest.digest()).decode()
        text.setdefault(page, []).append((p[-1], done))
    want = {k: (t or "").encode() for k, t in enumerate(html)}
    largest = {}
    for k, t in want.items():
        largest[t] = max(k, largest.get(t, -1))
    for k, t in want.items():
        (last, done), = text[k]
        assert last.payload_bytes == len(t) and last.payload_digest == base64.b32encode(hashlib.sha1(t).digest()).decode()
        assert (last.record_type, last.refers_to) == (("response", None) if largest[t] == k else ("revisit", largest[t]))
        assert done == (t if last.record_type == "response" else b"")
    assert sorted((r.record_type, r.refers_to) for r, _ in text[None]) == [("response", None), ("revisit", 10)]
    warc.write_archives(pages.where("false"), f"file://{tmp_path}/none")
    assert warc.read_chunks(spark, f"file://{tmp_path}/none").where("record_type <> 'warcinfo'").count() == 0
    for file in tmp_path.glob("w/*.warc.gz"):  # each record is a gzip member of its own
        rest, members = file.read_bytes(), 0
        while rest:
            unzip = zlib.decompressobj(31)
            one = unzip.decompress(rest)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and unzip.eof
            rest, members = unzip.unused_data, members + 1
        assert members
    warc.write_archives(pages, f"file://{tmp_path}/big", revisit_bytes=9)
    assert {r.page_id for r in warc.read_chunks(spark, f"file://{tmp_path}/big", with_payload=False).where("record_type = 'revisit'").collect()} == set()


def test_pages_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, SF, "pages").collect()}
    out = queries.op4_warc(spark, SF).collect()
    top = {t: max(k for k, x in pages.items() if x == t) for t in pages.values()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out} == {
        k: (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "response" if top[t] == k else "revisit", None if top[t] == k else top[t]) for k, t in pages.items()
    }


# --- shards


@pytest.mark.parametrize("run", [50_000, 3])
def test_shards_match_the_mixture(spark, monkeypatch, docs, sample, run):
    monkeypatch.setattr(sharding, "RUN", run)
    for source in (sample, docs):
        rows = corpus_pipeline.sized(source)
        out = sharding.interleave(rows, shards=4, tie=("doc_id", "text_crc32", "size")).collect()
        assert len(out) == source.count()
        by = collections.defaultdict(list)
        for r in out:
            by[r.shard].append(r)
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
        whole = collections.Counter(r.source for r in out)
        for x in by.values():
            mine = collections.Counter(r.source for r in x)
            assert all(abs(mine[s] - n * len(x) / len(out)) <= 2.5 for s, n in whole.items())
    again = sharding.interleave(corpus_pipeline.sized(docs.repartition(5)), shards=4, tie=("doc_id", "text_crc32", "size"))
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert sharding.interleave(corpus_pipeline.sized(docs.where("false"))).count() == 0


def test_shards_query(spark, sample):
    out = {r.doc_id: r for r in queries.op5_shards(spark, SF).collect()}
    for r in sample.collect():
        got, raw = out[r.doc_id], (r.text or "").encode()
        assert (got["size"], got.text_crc32, got.law, got.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None) and 0 <= got.shard < 16
    plan = queries.op5_shards(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- queries with SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    out = queries.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(out.columns)
    assert sorted(cur.fetchall(), key=str) == sorted((tuple(r) for r in out.select(*cols).collect()), key=str)


# --- pipeline


def test_pipeline_against_its_stages_in_plain_python(spark, sample):
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    model = quality_rules.train(sample, labels)
    scored = {r.doc_id: r for r in quality_rules.quality_rules(sample, model).collect()}
    now = [r for r in sample.collect() if scored[r.doc_id].kept]
    got = stages["quality rules"](spark, sample, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, now)) and got.columns == sample.columns and 0 < len(now) < 200
    classes = {i: c for i, c, _, _ in brute_classes([(r.doc_id, r.text) for r in now])}
    now = [r for r in now if classes[r.doc_id] == r.doc_id]
    got = stages["n-gram Jaccard join"](spark, got, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, now))
    leaks = {r.doc_id for r in decontaminate.find_leaks(got, bench).where("n_hit > 0").collect()}
    now = [r for r in now if r.doc_id not in leaks]
    got = stages["benchmark decontamination"](spark, got, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, now))
    mixed = stages["mixing sources to target weights"](spark, got, SF)
    count = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == sample.columns and set(count) <= {r.doc_id for r in now} and max(count.values()) <= 2
    done = corpus_pipeline.run(spark, SF)
    rows = done.collect()
    assert collections.Counter(r.doc_id for r in rows) == count and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_pipeline_of_odd_rows(spark, docs, empty):
    for source in (docs, empty):
        now = source
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            assert k == 4 or now.columns == source.columns
        assert now.count() >= 0


def test_labelled_sample_is_bounded(spark):
    """By rows and by bytes, also where thousands of rows share an id."""
    from weftlink.llm.common import labelled_sample

    docs = spark.range(5000).selectExpr("id % 3 AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text").union(spark.createDataFrame([(9, None), (None, "y"), (8, "z" * 5000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 2), (8, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    assert labelled_sample(docs, labels, "quality", 10).count() == 10
    rows = labelled_sample(docs, labels, "quality", 4000).collect()
    assert {(r.doc_id, r.y) for r in rows} == {(0, 1.0), (1, 0.0), (8, 1.0), (9, 0.0)} and len(rows) == sum(k % 3 < 2 for k in range(5000)) + 2
    few = labelled_sample(docs, labels, "quality", 4000, most_bytes=1000).collect()  # without the long document
    assert 0 < len(few) < len(rows) and sum(len(r.text or "") for r in few) <= 1000
    assert labelled_sample(docs.where("false"), labels, "quality", 10).count() == 0
