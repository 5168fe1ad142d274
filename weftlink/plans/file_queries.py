"""Queries that write files and read them back, and those of small rules; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import images, reports, scorers
from ..sources import documents, listing, people, sinks
from ..storage import shared_dir
from . import oracles
from .queries import CUSTOMERS_SQL, FILES_SQL, customers, extract_teams, part_files
from .registry import query, table


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


@query(CUSTOMERS_SQL + """ SELECT id AS "PlayerId", team::INT AS "TeamId", shown AS "FullName", ext AS "External_Player_ID", valid AS "ValidMapping", conf AS "Confidence" FROM players""")
def players_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "players.csv")
    sinks.write_players(customers(spark, sf_dir), path)
    return people.csv_players(spark, path).select("PlayerId", "TeamId", "FullName", "External_Player_ID", "ValidMapping", "Confidence")


@query(CUSTOMERS_SQL + """ SELECT id AS "PlayerId", ext AS "External_Player_ID", id % 2 = 0 AS "ValidMapping", 0.25::DOUBLE AS "Confidence", shown AS "FullName" FROM players""")
def mapped_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output under the name of a mapped file keeps its flags when it is read again."""
    path = sinks.mapped_name("/somewhere/players.csv", new_path(spark, "out"))
    rows = customers(spark, sf_dir).withColumn("ValidMapping", F.col("PlayerId") % 2 == 0).withColumn("Confidence", F.lit(0.25))
    sinks.write_players(rows, path)
    return people.csv_mapped(spark, path).select("PlayerId", "External_Player_ID", "ValidMapping", "Confidence", "FullName")


@query("""SELECT n_nationkey::INT AS "TeamId", n_name AS "TeamName", n_nationkey || ' - ' || n_name AS "DisplayName", n_name AS "SafeTeamName" FROM nation""")
def teams_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "teams.csv")
    sinks.write_teams(extract_teams(spark, sf_dir), path, single=True)
    return people.csv_teams(spark, path)


@query("""SELECT 'run' AS stamp, event_type AS model, count(*)::INT AS tests, count(*) FILTER (value >= 50)::INT AS correct, round(avg(value), 6) AS mean_confidence FROM events GROUP BY event_type""")
def benchmark_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of five models as one document, written and read."""
    path = sinks.benchmark_path(new_path(spark, "results"), "run")
    each = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("int").alias("testCount"), F.count_if(F.col("value") >= 50).cast("int").alias("correct"), F.avg("value").alias("averageConfidence"))
    models = F.collect_list(F.struct(F.col("event_type").alias("modelName"), "testCount", "correct", "averageConfidence"))
    sinks.write_json(each.agg(models.alias("nameMatchingResults")).select(F.lit("run").alias("timestamp"), "nameMatchingResults").coalesce(1), path)
    rows = documents.benchmark_results(spark, path).select("timestamp", F.explode("nameMatchingResults").alias("m"))
    return rows.select(F.col("timestamp").alias("stamp"), F.col("m.modelName").alias("model"), F.col("m.testCount").alias("tests"), "m.correct", F.round("m.averageConfidence", 6).alias("mean_confidence"))


@query("""SELECT '/p/' || s_suppkey || '.png' AS "ImagePath", (s_suppkey * 10)::BIGINT AS "FileSize", 'M' AS "Model", s_suppkey % 2 = 0 AS found FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 < 2""")
def face_cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a cache: those that state an error, or are of another model, can't be used again."""
    path = new_path(spark, "cache.json")
    mark = "named_struct('face_detected', s_suppkey % 2 = 0, 'model_used', CASE s_suppkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN '' ELSE 'other' END, 'metadata', CASE s_suppkey % 5 WHEN 0 THEN map('parse_error', 'x') ELSE map('k', 'v') END)"
    rows = table(spark, sf_dir, "supplier").selectExpr("concat('/p/', s_suppkey, '.png') AS ImagePath", "s_suppkey * 10 AS FileSize", "'2024-01-01T00:00:00Z' AS LastModified", f"{mark} AS Landmarks", "'M' AS Model")
    chunks = rows.groupBy(F.floor(F.col("FileSize") / 500).alias("chunk")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    chunks.repartition("chunk").write.partitionBy("chunk").text(path)  # a list of fifty entries a file
    return documents.face_cache(spark, path).select("ImagePath", "FileSize", "Model", F.col("Landmarks.face_detected").alias("found"))


@query("""SELECT 'f{' || o_orderkey || '}.png' AS file, o_custkey::VARCHAR AS external_id, 'A "' || o_orderstatus || '" }, { ' || o_orderkey AS full_name, (o_orderkey % 7)::INT AS team_id FROM orders""")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the photos of one document, with braces and quotes in its texts, read in blocks."""
    path = new_path(spark, "manifest.json")
    said = table(spark, sf_dir, "orders").selectExpr("concat('f{', o_orderkey, '}.png') AS file", "to_json(named_struct('externalId', cast(o_custkey AS string), 'fullName', concat('A \"', o_orderstatus, '\" }, { ', o_orderkey), 'teamId', o_orderkey % 7)) AS e")
    line = lambda text: spark.createDataFrame([(text,)], "value string")
    lines = line('{"made": {"by": {"photos": 1}}, "photos": {"f{0}.png": {}').unionByName(said.selectExpr("concat(',\"', file, '\": ', e) AS value")).unionByName(line("}}"))
    lines.coalesce(1).write.text(path)
    return documents.manifest(spark, path).where("external_id IS NOT NULL").select("file", "external_id", "full_name", "team_id")


@query("""SELECT n_name AS name1, n_name || ' x' AS name2, n_nationkey % 2 = 0 AS expected FROM nation""")
def name_pairs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pairs.csv")
    said = table(spark, sf_dir, "nation").select(F.concat_ws(" , ", "n_name", F.concat("n_name", F.lit(" x")), F.when(F.col("n_nationkey") % 2 == 0, "True").otherwise("false")).alias("value"))
    spark.createDataFrame([("Name1,Name2,ExpectedMatch",), ("",), ("short,row",)], "value string").unionByName(said).write.text(path)
    return documents.name_pairs(spark, [f"{path}-none", path])


@query("""SELECT s_suppkey::BIGINT AS id, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 7 WHEN 1 THEN s_suppkey % 5 WHEN 2 THEN s_suppkey % 3 ELSE 1 END::INT AS expected_faces FROM supplier""")
def expected_faces_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file name, by path, by path below FaceDetection, else one face."""
    path, rows = new_path(spark, "expected.csv"), table(spark, sf_dir, "supplier")
    name = "concat('f', s_suppkey, '.png')"
    at = f"CASE s_suppkey % 4 WHEN 0 THEN {name} WHEN 1 THEN concat('sub/', {name}) WHEN 2 THEN concat('FaceDetection/a/', {name}) END"
    rows.selectExpr(f"{at} AS f", "CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 7 WHEN 1 THEN s_suppkey % 5 ELSE s_suppkey % 3 END AS n").where("f is not null").selectExpr("f", "cast(n AS string) AS n").unionByName(spark.createDataFrame([("FileName", "Faces"), ("x.png", "many")], "f string, n string")).write.csv(path)
    listed = rows.selectExpr("s_suppkey AS id", f"{name} AS name", f"concat('/top/', CASE s_suppkey % 4 WHEN 1 THEN 'sub/' WHEN 2 THEN 'more/FaceDetection/a/' ELSE '' END, {name}) AS path")
    return documents.with_expected_faces(listed, documents.expected_faces(spark, [path]), "/top").select("id", "expected_faces")


@query("""SELECT 'S' || p_size AS key, p_size::INT AS width, (p_size * 3 // 2)::INT AS height, CASE WHEN n % 2 = 0 THEN 's' END AS "outputSubfolder", CASE WHEN n % 2 = 1 THEN '/p.png' END AS "placeholderPath" FROM (SELECT p_size, count(*) AS n FROM part WHERE p_size > 0 GROUP BY 1)""")
def size_profile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with a variant for every size that parts have, of which there are a few dozen; with a comment, and a comma at a list's end."""
    path = new_path(spark, "profile.json")
    sizes = table(spark, sf_dir, "part").where("p_size > 0").groupBy("p_size").agg(F.count("*").alias("n"))
    variants = sizes.selectExpr("concat('S', p_size) AS Key", "p_size AS width", "p_size * 3 div 2 AS Height", "CASE WHEN n % 2 = 0 THEN 's' END AS outputSubfolder", "CASE WHEN n % 2 = 1 THEN '/p.png' END AS placeholderPath")
    listed = F.regexp_replace(F.to_json(F.collect_list(F.struct("*"))), r"\]$", ",]")
    variants.agg(F.concat(F.lit('{"Name": "x", // sizes\n "variants": '), listed, F.lit("}")).alias("value")).write.text(path)
    return documents.size_profile(spark, path)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN '7' ELSE o_custkey::VARCHAR END AS "ExternalId" FROM orders WHERE o_orderkey % 4 = 1 OR (o_orderkey % 4 = 3 AND o_custkey <> 0)""")
def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN ' 0' WHEN 1 THEN '7' WHEN 2 THEN ' ' ELSE cast(o_custkey AS string) END AS ExternalId")
    return people.reference_mapping(people.first_with_rows(rows.where("false"), rows))


@query("""SELECT p.* FROM (SELECT * FROM (VALUES (1, 1, 'Rodríguez Sánchez'), (2, 1, 'Ramos Sergio'), (3, 1, 'Iniesta Andrés')) t("PlayerId", "TeamId", "FullName")
 UNION ALL SELECT k::INT, t::INT, 'Family' || k || ' Sur' || k FROM (SELECT 2 AS t, unnest(range(1, 11)) AS k UNION ALL SELECT 3, unnest(range(1, 26)))) p JOIN supplier ON s_suppkey = "TeamId" """)
def made_up_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-ins for a database, only where they are asked for: here for a team a supplier."""
    return people.stand_ins(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS TeamId")).select("PlayerId", "TeamId", "FullName")


TEMPLATE = r"'^(\d+)_([^{}_]+)_([^{}.]+)\.png$'"


@query(FILES_SQL + oracles.detected("files").replace("SELECT p_partkey, name, external_id", ", auto AS (SELECT p_partkey, name, external_id").rstrip() + f""")
SELECT a.p_partkey, row_number() OVER (ORDER BY '/p/' || a.p_partkey || '/' || a.name) AS cand_seq, CASE WHEN a.p_partkey % 22 = 0 THEN 'M' || a.p_partkey WHEN regexp_matches(a.name, {TEMPLATE}) THEN regexp_extract(a.name, {TEMPLATE}, 1) ELSE external_id END AS external_id,
 CASE WHEN a.p_partkey % 22 = 0 THEN 'Man' WHEN regexp_matches(a.name, {TEMPLATE}) THEN regexp_extract(a.name, {TEMPLATE}, 2) ELSE family_name END AS family_name FROM auto a""")
def photo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of a file goes before the template, the template before the layouts."""
    rows = part_files(spark, sf_dir).withColumn("path", F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("name")))
    said = rows.where("p_partkey % 22 = 0").selectExpr("name AS file", "concat('M', p_partkey) AS external_id", "'Man X' AS full_name", "'Man' AS family_name", "'X' AS sur_name")
    out = listing.photo_records(rows, "{id}_{family}_{sur}.png", said)
    return out.select(F.regexp_extract("path", r"^/p/(\d+)/", 1).cast("long").alias("p_partkey"), "cand_seq", "metadata.external_id", "metadata.family_name")


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS errors FROM events")
def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_count(table(spark, sf_dir, "events").selectExpr("CASE event_id % 3 WHEN 0 THEN map('error', 'x') WHEN 1 THEN map('k', 'v') END AS metadata"))


@query("SELECT count(*) AS entries, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS existing FROM orders")
def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "orders").select(F.concat(F.lit("/P/"), F.col("o_custkey").cast("string")).alias("ImagePath"))
    return reports.cache_stats(cache, table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("/p/"), F.col("c_custkey").cast("string")).alias("path")))


@query("""SELECT doc_id, left(replace(regexp_replace(coalesce(text, ''), '\\r\\n|\\r|\\n', ' ', 'g'), '|', '/'), 220) AS traced FROM documents""".replace("\\\\", "\\"))
def traced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.trace_text(F.col("text")).alias("traced"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mina tanaka ' WHEN 1 THEN 'ياسين 123 كريم ' WHEN 2 THEN 'احمد علي ' ELSE 'ngolo e ' END || p_partkey AS normalized FROM part""")
def other_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide and joined letters, middle dots, letters and digits that Arabic and Persian write apart, African letters."""
    said = "CASE p_partkey % 4 WHEN 0 THEN 'Ｍｉｎａ・Ｔａｎａｋａ ' WHEN 1 THEN 'یاسين ۱۲۳ كريم ' WHEN 2 THEN 'أحمـد علي ' ELSE 'Ŋolo Ɛ ' END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"concat({said}, p_partkey) AS raw").select("p_partkey", text.normalize_name(F.col("raw")).alias("normalized"))


@query("""SELECT p_partkey, p_partkey % 3 < 2 AS same FROM part""")
def identical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the same tokens need no scorer: in another order, or by another spelling."""
    other = "CASE p_partkey % 3 WHEN 0 THEN concat(split(p_name, ' ')[1], ' ', split(p_name, ' ')[0], ' Alexander') WHEN 1 THEN concat('Zander ', p_name) ELSE concat(p_name, ' other') END"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, ' Alex') AS a", f"{other} AS b")
    return rows.select("p_partkey", text.same_tokens(F.col("a"), F.col("b")).alias("same"))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), b AS (SELECT user_id, max(event_id) FILTER (k = 1) AS e, max(value) FILTER (k = 1) AS v, max(value) FILTER (k = 2) AS w FROM r GROUP BY 1)
SELECT user_id AS player_seq, e AS cand_seq, v AS confidence, round(v - coalesce(w, 0), 9) AS ahead, coalesce(v - w < 0.07, false) AS close FROM b""")
def one_against_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS player_seq", "event_id AS cand_seq", "event_id AS place", "value AS confidence")
    return scorers.best_of_many(rows).withColumn("ahead", F.round("ahead", 9))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size * (p_partkey % 9), p_size, p_partkey % 9, lower(p_name || p_partkey), p_name || p_partkey) AS place FROM part""")
def preset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, p_partkey) AS name", "p_size AS width", "p_partkey % 9 AS height")
    return reports.ordered_presets(rows).select("p_partkey", "place")


@query(CUSTOMERS_SQL + """ SELECT p.id AS "PlayerId", row_number() OVER (ORDER BY c_mktsegment, c_name, p.id) AS place FROM players p JOIN customer ON c_custkey = p.id WHERE NOT valid OR coalesce(trim(ext), '') = ''""")
def unmapped_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir).where("NOT ValidMapping OR coalesce(trim(External_Player_ID), '') = ''")
    return reports.ordered_unmapped(rows).select("PlayerId", "place")


@query(CUSTOMERS_SQL + """ SELECT id AS "PlayerId" FROM players WHERE ext IS NOT NULL AND (lower(ext) = 'x17' OR id = 17)""")
def only_one_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.only_player(customers(spark, sf_dir), "x17").select("PlayerId")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sqrt(least(greatest(l_tax * 20, 0), 1) * 0.9::DOUBLE) AS score, l_linenumber * 8 AS stride, (l_partkey % 40 + 0.25::DOUBLE) * l_linenumber * 8 AS x, (l_suppkey % 30 + 0.5::DOUBLE) * l_linenumber * 8 AS y, exp(l_discount) * l_linenumber * 8 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest((x - s / 2) * 2, 0), 639), 6) AS x, round(least(greatest((y - s / 2) * 1.5::DOUBLE, 0), 479), 6) AS y, round(least(greatest(s * 2, 1), 640), 6) AS width, round(score, 6) AS score FROM c WHERE score >= 0.9""")
def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = {"stride": "l_linenumber * 8", "row": "l_suppkey % 30", "col": "l_partkey % 40", "cls": "l_tax * 20", "obj": "0.9D", "dx": "0.25D", "dy": "0.5D", "lw": "l_discount", "lh": "l_discount", "rx": "0.1D", "ry": "0.1D", "lx": "0.2D", "ly": "0.2D"}
    line = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").selectExpr(*line, "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in cell.items()) + ") AS cell")
    out = rows.select(*line, geometry.decode_grid(F.col("cell"), F.lit(640.0), F.lit(480.0), 320, 320).alias("d")).where("d is not null")
    return out.select(*line, F.round("d.box.x", 6).alias("x"), F.round("d.box.y", 6).alias("y"), F.round("d.box.width", 6).alias("width"), F.round("d.score", 6).alias("score"))


@query("""SELECT (o_custkey % 997)::INT AS "PlayerId", arg_max(o_orderpriority || chr(10) || '"' || o_orderstatus || '"', o_orderkey) AS "FamilyName", arg_max(o_clerk, o_orderkey) AS "SurName", arg_max(o_orderkey, o_orderkey)::VARCHAR AS "External_Player_ID",
 arg_max(o_totalprice, o_orderkey) AS "Confidence" FROM orders GROUP BY 1""".replace("o_clerk", "o_orderstatus"))
def last_of_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files of different sizes, with line breaks within quotes: the last row of a player counts, in the order of files and lines."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey % 997 AS PlayerId", "0 AS TeamId", "concat(o_orderpriority, chr(10), '\"', o_orderstatus, '\"') AS FamilyName", "o_orderstatus AS SurName", "o_orderkey AS External_Player_ID", "'True' AS ValidMapping", "o_totalprice AS Confidence", "o_orderkey")
    path = new_path(spark, "mapped_players.csv")
    dealt = rows.repartitionByRange(7, F.sqrt("o_orderkey")).sortWithinPartitions("o_orderkey").drop("o_orderkey")
    dealt.write.option("header", True).option("escape", '"').csv(path)
    return people.last_by_player(people.csv_mapped(spark, path)).select("PlayerId", "FamilyName", "SurName", "External_Player_ID", "Confidence")
