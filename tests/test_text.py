"""Names and file names against known values."""

import pytest
from pyspark.sql import functions as F

from weftlink.functions import filenames, responses, rules, text

# Known names with their normal forms, tokens and scores.
NORMAL = {
    "Müller": "mueller", "Østergård": "oestergard", "Đorđe Petrović": "djordje petrovic", "Michał Skóraś": "michal skoras", "Altay Bayındır": "altay bayindir", "Ｍｉｎａ・Ｔａｎａｋａ": "mina tanaka",
    "Ŋolo": "ngolo", "Rodriguez-": "rodriguez", "juan !": "juan ", "Müller": "muller", "": "", None: "", "Gonzaalez": "gonzalez", "İlkay": "ilkay", "ABC 12": "abc 12",
}
CORE = {"Fernández": "fernandez", "Gonzalez": "gonzalez", "Chico": "francisco", "Zander": "oleksandr", "Alex": "oleksandr", "ياسين": "", "Jan van der Berg 12": "jan berg", "O'Neil-Smith Jr.": "o neil smith", None: ""}


def test_normalized_names(spark):
    rows = spark.createDataFrame([(k, v) for k, v in NORMAL.items()], "raw string, want string")
    for r in rows.withColumn("got", text.normalize_name(F.col("raw"))).collect():
        assert r.got == r.want, r.raw


def test_core_tokens(spark):
    rows = spark.createDataFrame([(k, v) for k, v in CORE.items()], "raw string, want string")
    for r in rows.withColumn("got", F.array_join(text.core_tokens(F.col("raw")), " ")).collect():
        assert r.got == r.want, r.raw
    pair = lambda a, b: spark.range(1).select(text.same_tokens(F.lit(a), F.lit(b))).first()[0]
    assert pair("Fernández", "Fernandes") and pair("Gonzalez", "Gonsales") and pair("Zander", "Alexander") and pair("", "ياسين") and not pair("Ann", "Bob")


def test_scripts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.normalize_name(F.lit("ياسين"))) == one(text.normalize_name(F.lit("یاسين")))
    assert one(text.scripts(F.lit("Ɔsei Ŋkrumah"), text.EUROPEAN)) == "Osei Ngkrumah"
    assert one(text.scripts(F.lit("یاسين ۱۲۳ كريم"), text.EUROPEAN)) == "ياسين 123 كريم"
    assert one(text.validation_name(F.lit("  José   LÓPEZ "))) == "jose lopez"


@pytest.mark.parametrize(("a", "b", "want"), [("hello", "halo", 2), ("HELLO", "hello", 5), ("", "hello", 5)])
def test_distance(spark, a, b, want):
    assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] == want


def test_similarity_and_ladder(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.similarity(F.lit("HELLO"), F.lit("hello"))) == 1.0 and one(text.similarity(F.lit("hello"), F.lit(""))) == 0.0
    assert one(text.similarity(F.lit("HELLO"), F.lit("hellx"))) == 0.0 and one(text.similarity(F.lit(""), F.lit(""))) == 1.0
    compare = lambda a, b: one(text.compare_names(F.lit(a), F.lit(b)))
    assert compare("Juan Rodriguez", "Rodriguez Juan") == 1.0 and compare("ياسين", "یاسين") == 1.0 and compare("Juan Rodriguez", "Maria Garcia") < 0.5
    assert compare("Rodriguez", None) == 0.95 and compare(None, None) == 1.0 and compare("Juan Carlos", "Juan Carlos Perez") == 0.93
    assert one(text.lenient_similarity(F.lit("ann"), F.lit("ann bob"))) == 0.5


SCORES = [("Clarke Steve", "Stephen Clarke", 0.84), ("Conceicao Chico", "Francisco Fernandes Conceição", 0.93), ("Clark Zander", "Alexander Clark", 0.93), ("Smith John", "John Smith", 0.93), ("Pepe", "Kepler Laveran Maceira", 0.88), ("Pepe", "Kepler Laveran", 0.782), ("Sylvinho Coach", "Mendes De Campo Sylvio", 0.79), ("Smith John", "Smith Jahn", 0.95), ("Rodri Hernan", "Rodrigo Hernan", 0.90), ("123", "Ann", 0.0), ("Ann Lee", "ann  lee", 1.0)]


def test_scores(spark):
    rows = spark.createDataFrame(SCORES, "a string, b string, want double")
    rows = rows.select("*", *[text.normalize_name(F.col(c)).alias(f"n{c}") for c in "ab"])
    rows = rows.select("*", *[text.name_tokens(F.col(c), F.col(f"n{c}")).alias(f"t{c}") for c in "ab"])
    for r in text.with_name_score(rows, "ta", "na", "tb", "nb").collect():
        if r.b == "Mendes De Campo Sylvio":
            assert r.score <= 0.79
        else:
            assert r.score == pytest.approx(r.want, abs=2e-3), (r.a, r.b)


FILES = {
    "123_Smith_John.png": ("123", "Smith", "John"), "Maria-Garcia-789.jpg": ("789", "Garcia", "Maria"), "Martinez, Carlos - 321.png": ("321", "Martinez", "Carlos "), "Rodriguez_Luis_position_654.jpg": ("654", "Rodriguez", "Luis"),
    "987-Ana-Lopez.png": ("987", "Lopez", "Ana"), "Fernandez_Pedro_147.png": ("147", "Pedro", "Fernandez"), "258.jpg": ("258", "", ""), "123_Smith_John_Doe.png": ("123", "Smith", "John_Doe"), "RIVERA Mateo;741258.png": ("741258", "RIVERA", "Mateo"),
    "invalid_filename.txt": None, "": None,
}


def test_file_names(spark):
    rows = spark.createDataFrame([(k,) for k in FILES], "name string").withColumn("r", filenames.auto_detect(F.col("name")))
    for x in rows.collect():
        assert (x.r and (x.r.external_id, x.r.family_name, x.r.sur_name)) == FILES[x.name], x.name


def test_templates(spark):
    fit = lambda name, t: spark.range(1).select(filenames.with_template(F.lit(name), t).alias("r")).first().r
    r = fit("123_Smith_John.png", "{id}_{family}_{sur}.png")
    assert (r.external_id, r.family_name, r.sur_name, r.full_name) == ("123", "Smith", "John", "Smith John")
    assert fit("123_Smith_John.png", "{id.png") is None and fit("x.png", "{id}.png") is None
    assert spark.range(1).select(text.display_name(F.lit(" "), F.lit("Ann_Lee-x"))).first()[0] == "Ann Lee x"


def test_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert rules.threshold(0.5) == 0.8 and rules.threshold(0.5, 0.65) == 0.65 and rules.threshold(0.5, None) == 0.5
    assert one(rules.is_cloud(F.lit("coder:480b-CLOUD"))) and not one(rules.is_cloud(F.lit("x")))
    assert tuple(one(rules.provider_and_model(F.lit("Claude: x:y")))) == ("claude", "x:y") and tuple(one(rules.provider_and_model(F.lit("qwen:8b")))) == ("ollama", "qwen:8b")
    with pytest.raises(Exception, match="no model"):
        one(rules.provider_and_model(F.lit("openai:")))
    running = spark.createDataFrame([("a",), ("A",), ("b:cloud",), ("c",), (None,)], "model string")
    names = lambda need: sorted(r.model.lower() for r in rules.models_to_unload(running, need).collect())
    assert names("c") == ["a"] and names("x:cloud") == [] and names("") == []
    assert rules.output_profile("test", {}, "/o") == "/o/test" and rules.output_profile("prod", {"prod": "/p"}, "/o") == "/p" and rules.output_profile(None, {}, "/o") == "/o"
    with pytest.raises(ValueError):
        rules.output_profile("other", {}, "/o")


def test_answers(spark):
    said = ['x {"confidence": 0.9, "IsMatch": false, "reason": "r"} y', '"confidence": 0.7', "{broken", '{"confidence": 0.4, oops}', "nothing", None, "{}"]
    rows = spark.createDataFrame([(s,) for s in said], "said string").withColumn("r", responses.parse_one(F.col("said"), 0.8, F.create_map(F.lit("model"), F.lit("m"))))
    got = [(r.r.confidence, r.r.is_match, "error" in r.r.metadata, r.r.metadata["model"]) for r in rows.collect()]
    assert got == [(0.9, True, False, "m"), (0.7, False, False, "m"), (0.0, False, True, "m"), (0.0, False, True, "m"), (0.0, False, True, "m"), (0.0, False, True, "m"), (0.0, False, False, "m")]
    many = '{"results": [{"index": 0, "confidence": 0.1}, {"index": 1, "confidence": 0.2}, {"index": 0, "confidence": 0.3}]}'
    rows = spark.createDataFrame([(many,), ("none",), ('{"results": []}',)], "said string").select(responses.parse_many(F.col("said")).alias("m")).collect()
    assert {k: v.confidence for k, v in rows[0].m.items()} == {0: 0.3, 1: 0.2} and rows[1].m is None and rows[2].m is None
    asked = spark.range(1).select(responses.ask_one(F.lit("a"), F.lit('b"')).alias("q")).first().q
    assert asked.endswith('{"name1":"a","name2":"b\\""}')
    assert spark.range(1).select(responses.number(F.lit(0.9)).alias("n"), responses.number(F.lit(2.0)).alias("m")).first() == ("0.9", "2")


def test_white_space_and_units(spark):
    from weftlink.functions import rules

    rows = spark.createDataFrame([("\tJohn Smith\n", "a"), ("  Ann\u0085 Lee \x0b", "😀a"), ("\t\n", "a😀😁"), (None, None), ("x𠀀y", "\U0001f600\U0001f601")], "n string, a string")
    got = rows.select(text.normalize_name(F.col("n")).alias("n"), rules.blank(F.col("n")).alias("b"), text.distance(F.col("a"), F.lit("a")).alias("d"), text.text_similarity(F.col("a"), F.lit("😁")).alias("s"), F.length(text.code_units(F.col("a"))).alias("u")).collect()
    assert [r.n for r in got] == ["john smith", "ann le", "", "", "xy"] and [r.b for r in got] == [False, False, True, True, False]
    units = lambda t: [*memoryview((t or "").encode("utf-16-le")).cast("H")]

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, above = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        return row[-1]

    texts = ["a", "😀a", "a😀😁", None, "\U0001f600\U0001f601"]
    assert [r.u for r in got] == [len(units(t)) for t in texts] and [r.d for r in got] == [plain(units(t), units("a")) for t in texts]
    assert [round(r.s, 9) for r in got] == [round(1 - plain(units(t), units("😁")) / max(len(units(t)), 2), 9) for t in texts]


def test_thresholds_swept(spark):
    from weftlink.operators import reports

    rows = [("a", True, 0.9), ("a", False, 0.9), ("a", True, None), ("a", None, 0.29), ("b", False, 7.0), (None, True, -1.0), (None, True, 0.5)]
    out = reports.threshold_sweep(spark.createDataFrame(rows, "preset string, expected boolean, confidence double"), steps=10).collect()
    assert len(out) == 33
    for r in out:
        mine = [(bool(e), min(max(c or 0.0, 0.0), 1.0)) for p, e, c in rows if p == r.preset]
        taken = [e for e, c in mine if c >= r.threshold]
        assert (r.tests, r.accepted, r.right) == (len(mine), len(taken), sum(taken))
        assert r.accuracy == pytest.approx(sum((c >= r.threshold) == e for e, c in mine) / len(mine))
        assert r.precision == pytest.approx(sum(taken) / len(taken) if taken else 1) and r.recall == pytest.approx(sum(taken) / sum(e for e, _ in mine) if any(e for e, _ in mine) else 1)
    assert reports.threshold_sweep(spark.createDataFrame([], "preset string, expected boolean, confidence double")).count() == 0


def test_vision_answers(spark):
    from weftlink.operators import images

    tries = [("a", 1, None, "timeout"), ("a", 2, "", None), ("a", 3, "{}", None), ("b", 1, None, "x"), ("b", 2, None, "y"), ("b", 3, None, "z"), ("b", 4, "{}", None)]
    got = {r.path: tuple(r)[1:] for r in images.first_answers(spark.createDataFrame(tries, "path string, attempt int, response string, error string")).collect()}
    assert got == {"a": (2, "", None), "b": (3, None, "z")}
    said = ['x {"faceDetected": true, "faceRect": {"x": 0.1, "y": 20, "width": 0.2, "height": 30}, "leftEye": {"x": 0.9, "y": 25}, "confidence": 0.5} y', '{"faceDetected": true}', '{"faceDetected": false, "confidence": 0}', "{", None, "{]}",
            '```json {"faceDetected": true, "bothEyesDetected": true, "faceRect": {"x": 10, "y": 20, "width": 30, "height": 30}, "leftEye": {"x": 15, "y": 25}, "rightEye": {"x": 30, "y": 25}} ```']
    rows = [r.p for r in spark.createDataFrame([(s,) for s in said], "s string").select(responses.parse_landmarks(F.col("s"), F.lit(100), F.lit(100)).alias("p")).collect()]
    assert [r.error for r in rows] == ["left_eye_outside_face_rect", "face_detected_without_face_rect", None, "no_json", "no_json", "broken_json", None]
    assert [r.face_detected for r in rows] == [False] * 6 + [True] and rows[6].both_eyes and tuple(rows[6].face) == (10, 20, 30, 30) and tuple(rows[6].right_eye) == (30, 25) and rows[0].face is None
