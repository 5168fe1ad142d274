"""Crops, detections and picture tables against known values and plain loops."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from weftlink.functions import geometry as g
from weftlink.operators import images
from weftlink.plans import portraits
from weftlink.sources.documents import reusable

RECT, POINT = "struct<x:int,y:int,width:int,height:int>", "struct<x:int,y:int>"


def crops(spark, rows, *frame, **more):
    df = spark.createDataFrame(rows, f"k int, found boolean, face {RECT}, left {POINT}, right {POINT}, w int, h int")
    return {r.k: tuple(r.crop) for r in g.with_crop(df, *frame, **more).collect()}


def test_eye_line_stays_in_its_band(spark):
    face = (450, 550, 260, 320)
    got = crops(spark, [(0, True, face, (520, 670), (640, 670), 1200, 2000), (1, True, face, None, None, 1200, 2000), (2, True, (450, 350, 260, 320), (520, 470), (640, 472), 1200, 2000)])
    for k, eyes in ((0, 670), (1, 550 + 128)):
        x, y, w, h = got[k]
        assert 96 <= (eyes - y) * 300 / h <= 114 and 0 <= x and x + w <= 1200
    x, y, w, h = got[2]
    assert abs(w / h - 2 / 3) < 0.01


def test_crops_stay_within_the_picture(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        box = (rng.randint(0, 900), rng.randint(0, 900), rng.randint(1, 500), rng.randint(1, 500))
        point = lambda: (rng.randint(0, 999), rng.randint(0, 999)) if rng.random() < 0.6 else None
        rows.append((k, rng.random() < 0.8, box if rng.random() < 0.7 else None, point(), point(), rng.randint(50, 1200), rng.randint(50, 1200)))
    for more in ({}, {"shift_x": 20.0, "shift_y": -30.0}):
        for k, (x, y, w, h) in crops(spark, rows, 100, 150, **more).items():
            assert 0 <= x <= rows[k][5] - w and 0 <= y <= rows[k][6] - h and w > 0 and h > 0
    none = crops(spark, [(0, False, None, None, None, 1000, 1000), (1, None, None, None, (500, 300), 1000, 1000)])
    assert none[0] == (500 - 147 // 2, 120 - 77, 147, 220) and none[1] == (500 - 34 - 233 // 2, 300 - 122, 233, 350)


def test_landmarks(spark):
    error = lambda *a: spark.createDataFrame([a], f"found boolean, face {RECT}, left {POINT}, right {POINT}").select(g.landmark_error(*[F.col(c) for c in ("found", "face", "left", "right")], F.lit(1000), F.lit(1000)).alias("e")).first().e
    assert error(True, (900, 900, 200, 200), None, None) == "face_rect_out_of_bounds"
    assert error(True, (100, 100, 200, 200), (250, 150), (150, 150)) == "eye_order_invalid" and error(True, (100, 100, 200, 200), (150, 150), (250, 150)) is None
    assert error(True, None, None, None) == "face_detected_without_face_rect" and error(False, None, None, None) is None and error(None, None, None, None) is None
    assert error(True, (0, 0, 10, 200), None, None) == "unrealistic_face_ratio_w0.010_h0.200" and error(True, (0, 0, 0, 9), None, None) == "invalid_face_rect_dimensions"
    assert error(True, (100, 100, 200, 200), (99, 150), None) == "left_eye_outside_face_rect" and error(True, (100, 100, 200, 200), None, (150, 301)) == "right_eye_outside_face_rect"


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(g.scaled(F.lit(v), F.lit(640))) for v in (0.5, 1.0, 0.0, 33.9)] == [320, 1, 0, 33]
    assert [one(g.nearest(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2] and [one(g.half(F.lit(v))) for v in (-3, 3)] == [-1, 1]
    assert tuple(one(g.thumbnail(F.lit(400), F.lit(100)))) == (160, 40) and tuple(one(g.thumbnail(F.lit(100), F.lit(100)))) == (80, 80)
    assert one(g.locked_frame(F.lit(100), None, 200, 300)) == 150 and one(g.locked_frame(None, F.lit(30), 200, 300)) == 20
    narrow, wide = (g.aspect_trim(g.rect(F.lit(10), F.lit(10), F.lit(w), F.lit(h)), 200, 300) for w, h in ((100, 300), (300, 300)))
    assert tuple(one(narrow)) == (10, 10, 100, 150) and tuple(one(wide)) == (60, 10, 200, 300)


def test_eyes_merge_from_the_left(spark):
    def plain(eyes):
        kept = []
        for e in (x for x in eyes if x[2] >= 20 and x[3] >= 20):
            hit = next((k for k in kept if k[0] < e[0] + e[2] and e[0] < k[0] + k[2] and k[1] < e[1] + e[3] and e[1] < k[1] + k[3]), None)
            if hit:
                kept.remove(hit)
                x, y = min(hit[0], e[0]), min(hit[1], e[1])
                e = (x, y, max(hit[0] + hit[2], e[0] + e[2]) - x, max(hit[1] + hit[3], e[1] + e[3]) - y)
            kept.append(e)
        return sorted(kept)

    rng = random.Random(5)
    rows = [(k, [(rng.randint(0, 200), rng.randint(0, 60), rng.randint(10, 50), rng.randint(10, 50)) for _ in range(rng.randint(0, 6))]) for k in range(60)]
    got = spark.createDataFrame(rows, f"k int, eyes array<{RECT}>").select("k", g.merged_eyes(F.col("eyes")).alias("m")).collect()
    assert all([tuple(e) for e in r.m] == plain(rows[r.k][1]) for r in got)


def test_grid_cells(spark):
    cell = "struct<stride:int,row:int,col:int,cls:double,obj:double,dx:double,dy:double,lw:double,lh:double,rx:double,ry:double,lx:double,ly:double>"
    rows = spark.createDataFrame([((8, 2, 3, 0.95, 0.95, 0.5, 0.5, 1.0, 1.0, 0.2, 0.2, 0.8, 0.2),), ((8, 2, 3, 0.5, 0.9, 0.5, 0.5, 1.0, 1.0, 0.2, 0.2, 0.8, 0.2),)], f"c {cell}")
    good, weak = [r.d for r in rows.select(g.decode_grid(F.col("c"), F.lit(640), F.lit(320), 320, 320).alias("d")).collect()]
    assert weak is None and abs(good.score - 0.95) < 1e-9 and abs(good.box.x - (28 - 8 * 2.718281828 / 2) * 2) < 1e-6 and abs(good.right_eye.x - 51.2) < 1e-9 and abs(good.left_eye.y - 17.6) < 1e-9


def test_suppression_equals_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(p, k, *(float(rng.randint(0, 60)) for _ in range(2)), *(float(rng.randint(10, 40)) for _ in range(2)), float(rng.randint(0, 9))) for p in range(5) for k in range(40)]
    df = spark.createDataFrame(rows, "p int, box_id long, x double, y double, width double, height double, score double")

    def overlap(a, b):
        w, h = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])), max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        return w * h / (a[4] * a[5] + b[4] * b[5] - w * h)

    want = set()
    for p in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], r[1])):
            if len(kept) < 12 and all(overlap(r, k) < 0.3 for k in kept):
                kept.append(r)
        want |= {(p, r[1]) for r in kept}
    assert {(r.p, r.box_id) for r in images.suppress(df, "p", most=12).collect()} == want
    assert images.suppress(df.where("false"), "p").count() == 0
    assert {(r.p, r.box_id) for r in images.suppress(df, "p", most=12, stream=0).collect()} == want
    assert images.suppress(df.where("false"), "p", stream=0).count() == 0


def test_tiles_keep_what_a_stream_keeps(spark):
    """Sizes from 1 to 500, chains across tiles, repeated rows and scores, nulls, infinities and sides that are no sides."""
    rng = random.Random(9)
    size = lambda: 1.5 ** rng.randint(0, 15)
    rows = [(p, k, rng.uniform(-900, 900), rng.uniform(-900, 900), size(), size(), float(rng.randint(0, 30))) for p in ("a", "b") for k in range(900)]
    rows += [("a", 10_000 + k, k * 4.0, 5000.0, 8.0, 8.0, -float(k)) for k in range(700)]  # each overlaps the next by a third
    rows += [(None, 1, 0.0, 0.0, 5.0, 5.0, None), (None, 1, 0.0, 0.0, 5.0, 5.0, None), (None, 2, 1.0, 0.0, 5.0, 5.0, 1.0), (None, 3, None, 0.0, 5.0, 5.0, 1.0)]
    rows += [("c", k, x, 0.0, w, 5.0, s) for k, (x, w, s) in enumerate([(0.0, float("inf"), 1.0), (0.0, 0.0, 1.0), (5.0, -5.0, 1.0), (1e300, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.0, 5.0, float("nan")), (0.0, 5.0, 0.0), (0.0, 5.0, -0.0)])]
    df = spark.createDataFrame(rows, "p string, box_id long, x double, y double, width double, height double, score double").withColumn("kept", F.lit("clash")).withColumn("level", F.lit(1))
    for overlap, most in ((0.3, 100), (0.75, 5000), (0.04, 5000), (0.0, 10)):
        stream, tiles = (sorted(map(repr, images.suppress(df, "p", overlap, most, stream=n).collect())) for n in (10**6, 0))
        assert stream == tiles, (overlap, most)
    assert sorted(map(repr, images.suppress(df, "p", stream=1000).collect())) == sorted(map(repr, images.suppress(df, "p").collect()))


def test_chain_and_cache(spark):
    assert images.detector_chain("yolov8-face, yunet,llava:7b") == ["opencv-dnn", "opencv-yunet", "llava:7b"]
    rows = spark.createDataFrame([("p", "a", False, None), ("p", "b", True, None), ("p", "c", True, None), ("q", "a", True, "boom"), ("r", "z", True, None)], "path string, detector string, face_detected boolean, error string")
    got = {r.path: (r.found, r.detector) for r in images.first_found(rows, ["a", "c", "b"]).collect()}
    assert got == {"p": (True, "c"), "q": (False, None), "r": (False, None)}
    t = datetime(2024, 1, 1)
    marks = "struct<face_detected:boolean,model_used:string,metadata:map<string,string>>"
    cache = spark.createDataFrame([("/A.png", 5, t, (True, "M", {}), "m"), ("/b.png", 5, t, (True, "", {"parse_error": "x"}), "m"), ("/c.png", 5, t, (True, "other", {}), "m"), ("/d.png", 6, t, (True, None, None), "m"), ("/e.png", 5, t, (True, None, None), "n")], f"ImagePath string, FileSize long, LastModified timestamp, Landmarks {marks}, Model string")
    files = spark.createDataFrame([(f"/{c}.png", 5, t) for c in "abcdef"], "path string, length long, modified timestamp")
    assert {r.path: r.due for r in images.cached_or_due(files, cache, "M").collect()} == {"/a.png": False, **{f"/{c}.png": True for c in "bcdef"}}
    assert [r.path for r in portraits.due_pictures(spark, files, cache, "n").orderBy("path").collect()] == ["/a.png", "/b.png", "/c.png", "/d.png", "/f.png"]
    assert cache.select(reusable(F.col("Landmarks"), F.col("Model")).alias("r")).toPandas()["r"].tolist() == [True, False, False, True, True]


def test_portrait_jobs(spark):
    players = spark.createDataFrame([(1, "500001"), (2, "x"), (3, None), (4, "X2")], "PlayerId int, External_Player_ID string")
    files = spark.createDataFrame([("/a/500001.jpg", "500001.jpg", 0), ("/a/t/Ann_x.png", "Ann_x.png", 1), ("/a/t/x.png", "x.png", 1)], "path string, name string, depth int")
    found = spark.createDataFrame([("/a/500001.jpg", True, (450, 350, 260, 320), None, None)], f"path string, found boolean, face {RECT}, left_eye {POINT}, right_eye {POINT}")
    sizes = spark.createDataFrame([("/a/500001.jpg", 1200, 2000), ("/a/t/Ann_x.png", 800, 800)], "path string, image_w int, image_h int")
    variants = [("s", 34, 50, None, "p.png"), ("b", 200, 300, "big", "q.png")]
    jobs = portraits.portrait_jobs(players, files, found, sizes, variants)
    got = {(r.PlayerId, r.variant): (r.status, r.source, r.output, r.is_base) for r in jobs.collect()}
    assert got[1, "b"] == ("portrait", "/a/500001.jpg", "big/1.jpg", True) and got[2, "s"] == ("portrait", "/a/t/Ann_x.png", "2.jpg", False) and got[4, "b"] == ("placeholder", "q.png", "big/4.jpg", True) and len(got) == 6
    crop = {(r.PlayerId, r.variant): r.crop for r in jobs.collect()}
    assert crop[4, "b"] is None and abs(crop[1, "b"].width / crop[1, "b"].height - 2 / 3) < 0.02
    assert {r.n for r in portraits.portrait_report(jobs).collect()} == {2, 1} and portraits.portrait_jobs(players, files, found, sizes, variants, only="500001").count() == 2
    assert {r.status for r in portraits.portrait_jobs(players, files, found, sizes, [("s", 1, 1, None, None)]).where("PlayerId = 4").collect()} == {"failed"}


def test_detector_batches(spark):
    import pandas as pd

    rows = spark.createDataFrame([("a", b"123"), ("b", b"")], "path string, content binary")
    out = images.detect(rows, lambda batch: pd.DataFrame({"n": [len(x) for x in batch]}), "n long")
    assert {(r.path, r.n) for r in out.collect()} == {("a", 3), ("b", 0)}


def test_strips_find_what_a_matrix_finds():
    """Boxes in a strip are compared only with those in reach of each other, and overlap the same ones."""
    rng = np.random.default_rng(3)
    box = lambda n: np.stack([rng.integers(-90, 90, n) / 2, rng.integers(0, 40, n) / 2, rng.integers(1, 30, n) * 1.0, rng.integers(1, 20, n) * 1.0])
    for overlap in (0.1, 0.3, 1.0):
        strip, every = images.Strip(), np.empty((4, 0))
        for n in (0, 1, 40, 200):
            more, part = box(n), box(50)
            strip.add(more)
            every = np.concatenate([every, more], 1)
            assert (strip.overlapped(part, overlap) == images.clashes(every, part, overlap).any(0)).all()
            assert len(strip.boxes[0]) == every.shape[1]
