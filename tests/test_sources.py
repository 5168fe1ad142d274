"""Files in and out, reports on small tables, and the stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from weftlink.operators import reports
from weftlink.plans import batches, queries, registry  # noqa: F401 (queries puts its queries into the registry)
from weftlink.sources import documents, json_parts, listing, people, sinks
from weftlink.streaming import upserts


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_players_from_csv(spark, tmp_path):
    path = put(tmp_path / "team.csv", "PlayerId,TeamId,FamilyName,SurName,ExternalId,ValidMapping,Confidence\n1,7,Smith,John,501,False,0.2\n\n2,7,Doe,,,True,0.9\n1,7,Last,Row,502,True,0.5\n")
    rows = people.csv_players(spark, path).orderBy("seq").collect()
    assert [(r.PlayerId, r.External_Player_ID, r.ValidMapping, r.Confidence, r.FullName) for r in rows] == [(1, "501", True, 1.0, "Smith John"), (2, None, False, 0.0, "Doe"), (1, "502", True, 1.0, "Last Row")]
    mapped = people.csv_mapped(spark, path)
    assert {(r.PlayerId, r.ValidMapping, r.Confidence) for r in people.last_by_player(mapped).collect()} == {(1, True, 0.5), (2, True, 0.9)}
    assert people.csv_mapped(spark, str(tmp_path / "none.csv")).count() == 0
    out = str(tmp_path / "out")
    sinks.write_players(mapped, out, single=True)
    again = people.csv_mapped(spark, out)
    assert {tuple(r) for r in again.drop("seq").collect()} == {tuple(r) for r in mapped.drop("seq").collect()}
    assert any("True" in line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines())
    assert sinks.mapped_name("/in/team.csv", "/o/") == "/o/mapped_team.csv" and sinks.benchmark_path("/o", "20240101-000000") == "/o/benchmark-20240101-000000.json"


def test_teams_and_samples(spark, tmp_path):
    path = put(tmp_path / "teams.csv", "TeamId,TeamName\n1,A/B\n2,C\n")
    assert [(r.DisplayName, r.SafeTeamName) for r in people.csv_teams(spark, path).orderBy("TeamId").collect()] == [("1 - A/B", "A_B"), ("2 - C", "C")]
    assert people.sample_teams(spark).count() == 5 and [people.sample_players(spark, k).count() for k in (1, 2, 3, 4)] == [3, 10, 25, 0]
    assert people.first_with_rows(people.sample_players(spark, 4), people.sample_players(spark, 1)).count() == 3
    with pytest.raises(ValueError):
        people.first_with_rows(people.sample_players(spark, 9))
    sinks.write_teams(people.sample_teams(spark), str(tmp_path / "t"))
    assert people.csv_teams(spark, str(tmp_path / "t")).count() == 5
    refs = spark.createDataFrame([("1",), ("0",), (" ",), (None,)], "ExternalId string")
    assert people.reference_mapping(refs).count() == 1


def test_listing_and_records(spark, tmp_path):
    names = ["5_Smith_John.jpg", "sub/Ann_Lee_7.PNG", "sub/notes.txt", "9.jpeg"]
    for n in names:
        put(tmp_path / "photos" / n, b"x" * len(n))
    files = listing.files(spark, str(tmp_path / "photos"))
    assert {(r.name, r.depth) for r in files.collect()} == {("5_Smith_John.jpg", 0), ("Ann_Lee_7.PNG", 1), ("notes.txt", 1), ("9.jpeg", 0)}
    assert listing.images(files).count() == 3 and listing.merged_listings(files, files).count() == 3
    manifest = put(tmp_path / "m.json", json.dumps({"photos": {"notes.txt": {"externalId": 11, "familyName": "Ray", "surName": "Bob"}, "other.png": {"id": "3", "fullName": "X Y", "teamId": 4}}}))
    got = {r.name: (r.metadata.external_id, r.metadata.source, r.display_name) for r in listing.photo_records(files, manifest=documents.manifest(spark, manifest)).collect()}
    assert got["5_Smith_John.jpg"] == ("5", "AutoDetect", "Smith John") and got["notes.txt"] == ("11", "Manifest", "Ray Bob")
    got = {r.name: (r.metadata.external_id, r.metadata.source, r.display_name, r.cand_seq) for r in listing.photo_records(files).collect()}
    assert got["notes.txt"][:3] == (None, "Unknown", "notes") and sorted(v[3] for v in got.values()) == [1, 2, 3, 4]
    assert listing.photo_records(files, "{id}_{family}_{sur}.jpg").where("metadata.source = 'UserPattern'").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.manifest(spark, put(tmp_path / "bad.json", "{nope")).collect()
    assert documents.manifest(spark, put(tmp_path / "empty.json", "{}")).count() == 0
    ids = spark.createDataFrame([("9",), ("7",), ("5",)], "External_Player_ID string")
    find = lambda **k: {r.External_Player_ID: r.path and r.path.rsplit("/", 1)[1] for r in listing.photos_by_id(ids, files, **k).collect()}
    assert find() == {"9": "9.jpeg", "7": "Ann_Lee_7.PNG", "5": None} and find(prefixed=True)["5"] == "5_Smith_John.jpg"


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 30, 40)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 50, 60) + b"\x03"
    for n, d in (("a.png", png), ("b.jpg", jpg), ("c.bmp", b"BM")):
        put(tmp_path / "i" / n, d)
    got = {r.path[-5:]: (r.width, r.height) for r in listing.image_sizes(spark, str(tmp_path / "i")).collect()}
    assert got == {"a.png": (30, 40), "b.jpg": (60, 50), "c.bmp": (None, None)}
    hashes = listing.content_hashes(spark, str(tmp_path / "i"), "r1").unionByName(listing.content_hashes(spark, str(tmp_path / "i"), "r2"))
    assert reports.compare_runs(hashes).first()[2:] == (3, 3, 0)


def test_json_inputs(spark, tmp_path):
    profile = put(tmp_path / "p.json", '{"Name": "n", // note\n "variants": [{"key": "x34x50", "Width": 34, "height": 50,}, {"key": "b", "width": 200, "height": 300, "outputSubfolder": "a//b"}],}')
    assert [tuple(r)[:4] for r in documents.size_profile(spark, profile).collect()] == [("x34x50", 34, 50, None), ("b", 200, 300, "a//b")]
    for bad in ('{"variants": []}', '{"variants": [{"key": "a", "width": 1, "height": 1}, {"key": "A", "width": 1, "height": 1}]}', '{"variants": [{"key": "a", "width": 0, "height": 1}]}'):
        with pytest.raises(ValueError):
            documents.size_profile(spark, put(tmp_path / "q.json", bad))
    assert documents.layered({"a": {"x": 1, "y": 1}}, {"a": {"y": 2}}) == {"a": {"x": 1, "y": 2}} and documents.first_section([{}, {"s": 1}, {"s": 2}], "s") == 1
    assert documents.name_pairs(spark, ["/none.csv"]).count() == 4
    pairs = put(tmp_path / "pairs.csv", "name1,name2,expectedMatch\nA,B,true\nshort,row\nC,D,false\n")
    assert [tuple(r) for r in documents.name_pairs(spark, ["/none.csv", pairs]).collect()] == [("A", "B", True), ("C", "D", False)]
    faces = put(tmp_path / "faces.csv", "image_file,expected_faces\na.png,2\nbad,x\na.png,3\nFaceDetection/c.png,0\n")
    expected = documents.expected_faces(spark, [faces])
    files = spark.createDataFrame([("/t/a.png", "a.png"), ("/t/FaceDetection/c.png", "c.png"), ("/t/z.png", "z.png")], "path string, name string")
    assert {r.name: r.expected_faces for r in documents.with_expected_faces(files, expected, "/t").collect()} == {"a.png": 3, "c.png": 0, "z.png": 1}
    run = put(tmp_path / "b.json", json.dumps({"timestamp": "t", "nameMatchingResults": [{"modelName": "m", "accuracy": 0.9, "testResults": [{"name1": "a", "expected": True}]}]}))
    assert documents.benchmark_results(spark, run).select(F.explode("nameMatchingResults").alias("m")).first().m.testResults[0].expected
    cache = put(tmp_path / "c.json", json.dumps([{"ImagePath": "/a", "FileSize": 1, "Landmarks": {"face_detected": True, "metadata": {}}, "Model": "m"}, {"ImagePath": "/b", "FileSize": 1, "Landmarks": {"metadata": {"error": "e"}}, "Model": "m"}]))
    assert [r.ImagePath for r in documents.face_cache(spark, cache).collect()] == ["/a"] and documents.face_cache(spark, "/none.json").count() == 0
    assert documents.face_cache(spark, put(tmp_path / "corrupt.json", "{{{")).count() == 0
    entries = documents.face_cache(spark, cache)
    assert sinks.write_cache(entries, entries, str(tmp_path / "kept")) and not sinks.write_cache(entries, entries.where("false"), str(tmp_path / "x"))
    assert reports.cache_stats(entries, files).first() == (1, 0)


def test_reports_on_nothing(spark):
    none = spark.createDataFrame([], "model string, expected boolean, predicted boolean, confidence double, ms int")
    assert reports.benchmark_metrics(none).count() == 0
    teams = spark.createDataFrame([], "team string, status string, message string, extracted int, mapped int, unmapped_names array<string>")
    assert reports.team_issues(teams).count() == 0 and reports.batch_summary(teams).first().title == "Issues: none"
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([], "k int")
    assert reports.coverage(a, b, "k").first() == (2, 0, 2, 0.0) and reports.coverage(b, a, "k").first() == (0, 0, 0, 0.0)
    done = batches.team_states(people.sample_teams(spark), people.sample_players(spark, 1).withColumn("ValidMapping", F.lit(True)), spark.createDataFrame([("team 1",), ("Team 2",)], "folder string"), failed=spark.createDataFrame([(2, "boom")], "TeamId int, message string"))
    assert {r.TeamId: (r.status, r.mapped) for r in done.collect()} == {1: ("Completed", 3), 2: ("Failed", 0), 3: ("Skipped", 0), 4: ("Skipped", 0), 5: ("Skipped", 0)}
    text = sinks.markdown(spark.createDataFrame([("a|b", None)], "x string, y string"), "T")
    assert "| a/b |  |" in text


def test_model_comparison(spark):
    base = spark.createDataFrame([(0, "A", 0.9, 10.0, 0.5, 4), (1, "B", 0.8, 5.0, 0.5, 4)], "position int, model string, accuracy double, avg_ms double, avg_confidence double, tests long")
    cand = base.withColumn("model", F.lower("model")).withColumn("accuracy", F.col("accuracy") + 0.05)
    got = {r.metric: round(r.delta, 6) for r in reports.compare_models(base, cand, "b").collect()}
    assert got == {"accuracy": 0.05, "avg_ms": 0.0, "avg_confidence": 0.0, "tests": 0.0}
    assert reports.compare_models(base, cand).count() == 4 and reports.compare_models(base, cand, "zz").count() == 0 and reports.compare_all(base, cand).count() == 8
    answers = spark.createDataFrame([({"error": "x"},), ({"k": "v"},), (None,)], "metadata map<string,string>")
    assert reports.error_count(answers).first().errors == 1 and reports.token_usage(answers).first() == (0, 0, 0, 0)
    issues = spark.createDataFrame([("a", f"{k:03}") for k in range(60)] + [(None, "z")], "label string, detail string")
    got = {r.label: (r.n, len(r.details.split(", "))) for r in reports.issue_counts(issues).collect()}
    assert got == {"a": (60, 50), None: (1, 1)}


def test_issue_details_are_whole(spark):
    issues = spark.createDataFrame([("a", f"{k:03}") for k in range(60)] + [(None, "z")], "label string, detail string")
    got = [tuple(r) for r in reports.issue_details(issues).collect()]
    assert len(got) == 61 and set(got) == {("a", k + 1, f"{k:03}") for k in range(60)} | {(None, 1, "z")}


def test_stream_keeps_the_last(spark, tmp_path):
    schema = "k int, v string, t long"
    folder, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    for rows, want in (([(1, "a", 1), (2, "b", 1), (1, "c", 3)], {1: "c", 2: "b"}), ([(1, "old", 2), (3, "d", 1), (2, "e", 1)], {1: "c", 2: "e", 3: "d"})):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        upserts.keep_upserted(spark.readStream.schema(schema).parquet(folder), table, check, ["k"], "t").awaitTermination()
        assert {r.k: r.v for r in upserts.current(spark, table, spark.read.parquet(folder).schema).collect()} == want


def test_every_query_runs(spark):
    """Smallest tables; results are compared with SQL elsewhere."""
    slow = {"map_run", "assign_fixpoint", "assign_round1", "propose_round1", "scorer_pass_stub", "scorer_shortlists", "assign_equal_names"}
    for name, f in registry.QUERIES.items():
        if name not in slow:
            assert len(f(spark, "/root/testdata/sf0.001").columns) > 0, name


def test_queries_and_their_sql(spark):
    """The queries that write files and read them back, and those of small rules, against their SQL."""
    import duckdb

    from weftlink.plans import file_queries

    con = duckdb.connect()
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    plain = lambda row: str([round(x, 6) if isinstance(x, float) else x for x in row])
    for name in [n for n, f in registry.QUERIES.items() if f.__module__ == file_queries.__name__]:
        rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols, said = sorted(rows.columns), con.execute(registry.SQL[name])
        have = [c[0] for c in said.description]
        assert sorted(have) == cols, name
        assert sorted(plain(r) for r in rows.select(*cols).collect()) == sorted(plain([r[have.index(c)] for c in cols]) for r in said.fetchall()), name


def test_parameters_are_marks_only():
    q = "SELECT ':TeamId', \"@TeamId\", x::int, -- :TeamId ?\n /* {TeamId} */ y FROM {t} WHERE a = :TeamId AND b = @teamid AND c = {TEAMID} AND d = :other AND e = ?"
    got = people.bound_query(q, {"TeamId": 10})
    assert got == "SELECT ':TeamId', \"@TeamId\", x::int, -- :TeamId ?\n /* {TeamId} */ y FROM {t} WHERE a = 10 AND b = 10 AND c = 10 AND d = :other AND e = 10"
    assert people.bound_query("? ?", {"a": "O'Neil", "b": None}) == "'O''Neil' NULL"
    with pytest.raises(ValueError):
        people.bound_query("? ?", {"a": 1})


def test_database_by_ranges(spark):
    """An embedded database among Spark's own jars; a text that looks like a parameter stays as it is."""
    jdbc = {"url": "jdbc:derby:memory:players;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).selectExpr("cast(id AS int) AS PlayerId", "cast(id % 7 AS int) AS TeamId", "concat('F', id) AS FamilyName", "concat('S', id) AS SurName")
    rows.write.format("jdbc").options(**jdbc).option("dbtable", "people").mode("overwrite").save()
    query = 'SELECT "PlayerId", "TeamId", "FamilyName", \':TeamId\' AS "SurName" FROM people WHERE "TeamId" = :TeamId'
    got = people.sql_players(spark, query, {"TeamId": 3}, jdbc, parts=('"PlayerId"', 4))
    assert got.rdd.getNumPartitions() == 4 and {r.PlayerId for r in got.collect()} == set(range(3, 1000, 7)) and {r.SurName for r in got.collect()} == {":TeamId"}
    assert people.sql_players(spark, query, {"TeamId": 99}, jdbc, parts=('"PlayerId"', 4)).count() == 0
    assert people.sql_players(spark, query.replace(":TeamId AS", "x AS"), {"TeamId": 3}, jdbc).count() == 143


def test_rows_of_several_files_in_order(spark, tmp_path):
    folder = tmp_path / "mapped_players"
    folder.mkdir()
    head = "PlayerId,TeamId,FamilyName,SurName,External_Player_ID,ValidMapping,Confidence\n"
    (folder / "part-0.csv").write_text(head + "1,1,First,x,a,True,0.5\n")
    (folder / "part-1.csv").write_text(head + '1,1,Second,x,b,True,0.5\n2,1,"two\nlines",y,c,True,0.5\n' + "3,1,Filler,z,d,True,0.5\n" * 500)
    rows = people.csv_mapped(spark, str(folder))
    got = {r.PlayerId: r.FamilyName for r in people.last_by_player(rows).collect()}
    assert got == {1: "Second", 2: "two\nlines", 3: "Filler"}
    in_order = [r.FamilyName for r in rows.orderBy("seq").collect()]
    assert in_order[:3] == ["First", "Second", "two\nlines"] and len(in_order) == 503


def test_sizes_behind_long_segments(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    segment = b"\xff\xe1\xff\xff" + b"\0" * 65533
    size = b"\xff\xc0\x00\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\0" * 10
    for k in (0, 1, 16):
        (folder / f"{k}.jpg").write_bytes(b"\xff\xd8" + segment * k + size)
    (folder / "none.jpg").write_bytes(b"\xff\xd8" + segment * 3)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in listing.image_sizes(spark, str(folder)).collect()}
    assert got == {"0.jpg": (200, 300), "1.jpg": (200, 300), "16.jpg": (200, 300), "none.jpg": (None, None)}


def test_tasks_stay_small_however_large_a_document_is(spark, tmp_path, monkeypatch):
    """Blocks are cut where they are read, without a sort of their text, and more text is dealt to more tasks."""
    plans, real = {}, json_parts.written
    monkeypatch.setattr(json_parts, "written", lambda df, tag: plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}) or real(df, tag))
    monkeypatch.setattr(documents, "TASK_BYTES", 512, raising=False)
    text = json.dumps({"photos": {f"f{k}.png": {"id": str(k)} for k in range(300)}})
    rows = documents.manifest(spark, put(tmp_path / "m.json", text))
    assert "Sort" not in plans["parts"] and "hashpartitioning" not in plans["parts"]
    assert rows.rdd.getNumPartitions() >= len(text) // 512 > 10
    assert {(r.file, r.external_id) for r in rows.collect()} == {(f"f{k}.png", str(k)) for k in range(300)}


def test_documents_in_blocks(spark, tmp_path):
    """One document in blocks of 97 bytes: braces, quotes and backslashes in texts, other sections, a name twice; and broken ones."""
    name = lambda k: ["plain", "br}ce", "q\\\"{", "back\\\\", "[x]", "é}🙂", "", "a" * 300][k % 8] + str(k)
    photos = {name(k): {"id": str(k), "fullName": name(k + 3), "teamId": k, "more": {"a": [{"b": "}"}]} if k % 5 == 0 else None} for k in range(120)}
    said = {"note": "a } b { \\\" photos", "tags": [1, [2], {"photos": {"no": {"id": "0"}}}], "other": {"x": {"id": "9"}, "photos": {"y": {"id": "8"}}}, "photos": photos, "end": {"z": 1}}
    def manifest(text, file="m.json"):
        return sorted(tuple(r) for r in documents.manifest(spark, put(tmp_path / file, text)).collect())
    key = "spark.sql.files.maxPartitionBytes"
    usual, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(key, "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        want = sorted((k, v["id"], v["fullName"], None, None, v["teamId"]) for k, v in photos.items())
        assert manifest(json.dumps(said)) == want
        assert manifest("\ufeff" + json.dumps(said, indent=3, ensure_ascii=False) + "\n") == want
        twice = '{"photos": {"a": {"id": "1"}, "b": {"id": "2"}, "a": {"id": "3"} } }'
        assert [r[:2] for r in manifest(twice)] == [("a", "3"), ("b", "2")]
        for text in ("", "{}", ' {"photos": null}', '{"other": [{"a": {}}]}'):
            assert manifest(text) == []
        for text in ("nope}", twice[:-1], twice + "}", twice.replace('"2"', '"2'), '{"photos": nope}', '{"photos": {"a": {"id": "1"}, "b": [] }}'):
            with pytest.raises(Exception, match="(?i)malformed"):
                manifest(text)
        entry = lambda k: {"ImagePath": name(k), "FileSize": k, "LastModified": "2024-01-01T00:00:00Z", "Landmarks": {"face_detected": True, "face": {"x": k, "y": 0, "width": 1, "height": 1}, "metadata": {"k": "}{"}}, "Model": "m"}
        entries = [entry(k) for k in range(60)]
        cache = lambda text: sorted((r.ImagePath, r.FileSize, r.Landmarks.face.x) for r in documents.face_cache(spark, put(tmp_path / "c.json", text)).collect())
        assert cache(json.dumps(entries)) == sorted((e["ImagePath"], e["FileSize"], e["FileSize"]) for e in entries) == cache(json.dumps(entries, indent=1))
        for text in ("[]", json.dumps(entries)[:-1], json.dumps([*entries, 5]), json.dumps(entries[0]), json.dumps(entries).replace("}, {", "}, x {", 1)):
            assert cache(text) == []
    finally:
        spark.conf.set(key, usual)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
