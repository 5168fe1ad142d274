"""The engine's queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filenames, geometry, responses, rules, text
from ..operators import images, matching, merging, numbering, reports, scorers
from ..sources import documents, listing, people
from ..storage import shared_dir, written
from ..streaming import upserts
from . import batches, mapping, oracles
from .registry import query, table

# --- sources -------------------------------------------------------------------------------------------------------------

PLAYER_QUERY = "SELECT c_custkey AS PlayerId, c_nationkey AS TeamId, c_mktsegment AS FamilyName, c_name AS SurName, CAST(NULL AS STRING) AS External_Player_ID FROM {customer} WHERE c_nationkey = :TeamId ORDER BY FamilyName, SurName"


@query("""SELECT c_custkey::INT AS "PlayerId", c_nationkey::INT AS "TeamId", c_mktsegment AS "FamilyName", c_name AS "SurName", NULL::VARCHAR AS "External_Player_ID",
 false AS "ValidMapping", 0.0::DOUBLE AS "Confidence", trim(c_mktsegment || ' ' || c_name) AS "FullName" FROM customer WHERE c_nationkey = 10""")
def extract_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.sql_players(spark, PLAYER_QUERY, {"TeamId": 10}, customer=table(spark, sf_dir, "customer"))


@query("""SELECT n_nationkey::INT AS "TeamId", n_name AS "TeamName", n_nationkey::VARCHAR || ' - ' || n_name AS "DisplayName", n_name AS "SafeTeamName" FROM nation""")
def extract_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.sql_teams(spark, "SELECT n_nationkey AS TeamId, n_name AS TeamName FROM {nation}", nation=table(spark, sf_dir, "nation"))


RAW_PLAYERS = "c_custkey AS PlayerId, c_nationkey AS TeamId, c_mktsegment AS FamilyName, c_name AS SurName, CASE c_custkey % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN ' ' ELSE CAST(c_custkey AS STRING) END AS ExternalId, 'True' AS ValidMapping, '0.5' AS Confidence"


@query("""SELECT c_custkey::INT AS "PlayerId", c_nationkey::INT AS "TeamId", c_mktsegment AS "FamilyName", c_name AS "SurName",
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_custkey::VARCHAR END AS "External_Player_ID", c_custkey % 3 = 2 AS "ValidMapping",
 CASE WHEN c_custkey % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS "Confidence", c_mktsegment || ' ' || c_name AS "FullName" FROM customer""")
def derive_mapping_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.as_players(table(spark, sf_dir, "customer").selectExpr(*split_columns(RAW_PLAYERS)))


def split_columns(text_: str) -> list[str]:
    """Columns of a select list; commas within parentheses stay."""
    out, depth = [""], 0
    for c in text_:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query("""SELECT (o_custkey % 997)::INT AS "PlayerId", 0 AS "TeamId", arg_max(o_orderpriority, o_orderkey) AS "FamilyName", arg_max(o_orderstatus, o_orderkey) AS "SurName", arg_max(o_custkey, o_orderkey)::VARCHAR AS "External_Player_ID",
 arg_max(o_orderstatus, o_orderkey) = 'F' AS "ValidMapping", arg_max(o_totalprice, o_orderkey) AS "Confidence", arg_max(o_orderpriority || ' ' || o_orderstatus, o_orderkey) AS "FullName", max(o_orderkey) AS seq FROM orders GROUP BY 1""")
def last_mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey % 997 AS PlayerId", "0 AS TeamId", "o_orderpriority AS FamilyName", "o_orderstatus AS SurName", "o_custkey AS External_Player_ID", "CASE o_orderstatus WHEN 'F' THEN 'true' ELSE 'false' END AS ValidMapping", "o_totalprice AS Confidence", "o_orderkey AS seq")
    return people.last_by_player(people.as_players(rows, keep_flags=True))


NAMES = """CASE p_partkey % 11 WHEN 0 THEN concat(k, '_', a, '_', b, '.png') WHEN 1 THEN concat(a, '-', b, '-', k, '.JPG') WHEN 2 THEN concat(a, ', ', b, ' - ', k, '.png') WHEN 3 THEN concat(a, '_', b, '_position_', k, '.jpg')
 WHEN 4 THEN concat(k, '-', a, '-', b, '.png') WHEN 5 THEN concat(a, '_', b, '_', k, '.bmp') WHEN 6 THEN concat(k, '.jpeg') WHEN 7 THEN concat('__', a, '_', b, '_', k, '.png') WHEN 8 THEN concat(upper(a), ' ', b, ';', k, '.png')
 WHEN 9 THEN concat('_', a, k, '.png') ELSE concat(a, ' ', b, '.txt') END"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for every part, in all layouts by turns."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_partkey + 1000 as string) AS k", "split(p_name, ' ')[0] AS a", "split(p_name, ' ')[1] AS b")
    return rows.selectExpr("p_partkey", f"{NAMES} AS name")


FILES_SQL = f"WITH files AS (SELECT p_partkey, {NAMES} AS name FROM (SELECT p_partkey, (p_partkey + 1000)::VARCHAR AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))"


@query(FILES_SQL + oracles.detected("files"))
def parse_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_files(spark, sf_dir).select("p_partkey", "name", filenames.auto_detect(F.col("name")).alias("r"))
    return rows.select("p_partkey", "name", "r.external_id", "r.full_name", "r.family_name", "r.sur_name", "r.pattern_used")


@query(FILES_SQL + r""", hit AS (SELECT *, regexp_matches(name, '^(\d+)_([^{}_]+)_([^{}.]+)\.png$') AS ok FROM files)
SELECT p_partkey, CASE WHEN ok THEN regexp_extract(name, '^(\d+)_([^{}_]+)_([^{}.]+)\.png$', 1) END AS external_id, CASE WHEN ok THEN regexp_extract(name, '^(\d+)_([^{}_]+)_([^{}.]+)\.png$', 2) END AS family_name,
 CASE WHEN ok THEN regexp_extract(name, '^(\d+)_([^{}_]+)_([^{}.]+)\.png$', 3) END AS sur_name FROM hit""")
def parse_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_files(spark, sf_dir).select("p_partkey", filenames.with_template(F.col("name"), "{id}_{family}_{sur}.png").alias("r"))
    return rows.select("p_partkey", "r.external_id", "r.family_name", "r.sur_name")


@query(FILES_SQL + r""" SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Given Name' ELSE trim(regexp_replace(translate(regexp_replace(name, '\.[^.]*$', ''), '_-', '  '), '\s+', ' ', 'g')) END AS display_name FROM files""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.when(F.col("p_partkey") % 7 == 0, "Given Name").when(F.col("p_partkey") % 7 == 1, "  ")
    return part_files(spark, sf_dir).select("p_partkey", text.display_name(full, filenames.stem(F.col("name"))).alias("display_name"))


@query("""WITH said AS (SELECT event_id, concat('{"photos": {"', event_type, '.png": {"', CASE event_id % 4 WHEN 0 THEN 'External_Player_ID' WHEN 1 THEN 'externalId' WHEN 2 THEN 'id' ELSE 'other' END, '": "', user_id, '", "fullName": "User ', user_id, '", "teamId": "', user_id % 5, '"}}}') AS value, event_type, user_id FROM events)
SELECT event_type || '.png' AS file, CASE WHEN event_id % 4 < 3 THEN user_id::VARCHAR END AS external_id, 'User ' || user_id AS full_name, NULL::VARCHAR AS family_name, NULL::VARCHAR AS sur_name, (user_id % 5)::INT AS team_id FROM said""")
def explode_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "CASE event_id % 4 WHEN 0 THEN 'External_Player_ID' WHEN 1 THEN 'externalId' WHEN 2 THEN 'id' ELSE 'other' END"
    said = f"""concat('{{"photos": {{"', event_type, '.png": {{"', {key}, '": "', user_id, '", "fullName": "User ', user_id, '", "teamId": "', user_id % 5, '"}}}}}}') AS value"""
    return documents.manifest_rows(table(spark, sf_dir, "events").selectExpr(said))


@query(FILES_SQL + r""", paths AS (SELECT p_partkey, name, CASE WHEN p_partkey % 2 = 0 THEN '/photos/' || name ELSE '/photos/sub/' || name END AS path, p_partkey % 2 AS depth FROM files),
 kept AS (SELECT path, depth, regexp_replace(name, '\.[^.]*$', '') AS s FROM paths WHERE regexp_matches(lower(name), '\.(png|jpg|jpeg|bmp)$')),
 keyed AS (SELECT path, s AS key, 1 AS rank FROM kept WHERE depth = 0 UNION ALL SELECT path, regexp_extract(s, '_([^_]*)$', 1), 2 FROM kept WHERE contains(s, '_')),
 best AS (SELECT key, min({'rank': rank, 'path': path}).path AS path FROM keyed GROUP BY key)
 SELECT (p_partkey + 1000)::VARCHAR AS "External_Player_ID", path FROM part LEFT JOIN best ON key = (p_partkey + 1000)::VARCHAR""")
def photo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_files(spark, sf_dir).selectExpr("name", "CASE WHEN p_partkey % 2 = 0 THEN concat('/photos/', name) ELSE concat('/photos/sub/', name) END AS path", "p_partkey % 2 AS depth")
    ids = table(spark, sf_dir, "part").selectExpr("cast(p_partkey + 1000 as string) AS External_Player_ID")
    return listing.photos_by_id(ids, rows)


@query(FILES_SQL + r"""SELECT regexp_extract(name, '_(\d+)\.[^.]*$', 1) AS external_id, arg_max(replace(regexp_extract(name, '^(.*)_\d+\.[^.]*$', 1), '_', ' '), name) AS photo_name FROM files
 WHERE regexp_matches(name, '_\d+\.(png|jpg|jpeg|bmp)$') GROUP BY 1""")
def photo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.photo_names(part_files(spark, sf_dir).withColumn("path", F.col("name")))


@query(FILES_SQL + r""", w AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[_-]+', ' ', 'g'), '\d+', '', 'g')), '\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT name FROM files))
SELECT (900000000 + k)::INT AS "PlayerId", array_to_string(w[1:greatest(len(w) - 1, 1)], ' ') AS "FamilyName", CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS "SurName", nullif(regexp_extract(name, '(\d+)', 1), '') AS "External_Player_ID",
 trim(array_to_string(w[1:greatest(len(w) - 1, 1)], ' ') || ' ' || CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END) AS "FullName", '/photos' AS folder FROM w WHERE len(w) > 0 AND regexp_matches(lower(name), '\.(png|jpg|jpeg|bmp)$')""")
def players_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_files(spark, sf_dir).select("name").distinct()
    return people.players_from_names(names.select("name", F.concat(F.lit("/photos/"), F.col("name")).alias("path")))


# --- text ----------------------------------------------------------------------------------------------------------------


@query(oracles.NORMALIZED)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("normalized"))


#: Names with white space of several kinds around and within, and characters beyond 16 bits.
PADDED = "concat(CASE c_custkey % 4 WHEN 0 THEN decode(unhex('09'), 'UTF-8') WHEN 1 THEN decode(unhex('C2A00A'), 'UTF-8') WHEN 2 THEN decode(unhex('E280A8'), 'UTF-8') ELSE '' END, c_name, CASE c_custkey % 3 WHEN 0 THEN decode(unhex('F09F9880'), 'UTF-8') WHEN 1 THEN decode(unhex('0B'), 'UTF-8') ELSE '' END, c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN decode(unhex('0D0A'), 'UTF-8') WHEN 1 THEN decode(unhex('F09F988120'), 'UTF-8') ELSE '' END)"
PADDED_SQL = "CASE c_custkey % 4 WHEN 0 THEN chr(9) WHEN 1 THEN chr(160) || chr(10) WHEN 2 THEN chr(8232) ELSE '' END || c_name || CASE c_custkey % 3 WHEN 0 THEN chr(128512) WHEN 1 THEN chr(11) ELSE '' END || c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(128513) || ' ' ELSE '' END"


@query(f"""WITH n AS (SELECT c_custkey, {PADDED_SQL} AS name FROM customer),
 t AS (SELECT c_custkey, lower(replace(replace(trim(regexp_replace(name, '[' || chr(9) || chr(10) || chr(11) || chr(13) || chr(160) || chr(8232) || ' ]+', ' ', 'g')), chr(128512), ''), chr(128513), '')) AS t FROM n)
SELECT c_custkey, {oracles.vowels("regexp_replace(replace(t, '#', ''), ' +', ' ', 'g')")} AS normalized FROM t""")
def padded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_name(F.expr(PADDED)).alias("normalized"))


#: The two characters, each as two units of which the first is the same.
UNITS = "replace(replace({}, chr(128512), '!$'), chr(128513), '!%')"


@query(f"""WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN chr(128512) WHEN 1 THEN chr(128513) || chr(128512) ELSE '' END || c_name AS a, c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN chr(128512) ELSE chr(128513) END AS b FROM customer),
 u AS (SELECT c_custkey, {UNITS.format("a")} AS a, {UNITS.format("b")} AS b FROM n)
SELECT c_custkey, levenshtein(a, b)::INT AS distance, round(1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) AS similarity FROM u""")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in units of UTF-16."""
    smile, grin = ("decode(unhex('F09F988%d'), 'UTF-8')" % k for k in (0, 1))
    a = F.expr(f"concat(CASE c_custkey % 3 WHEN 0 THEN {smile} WHEN 1 THEN concat({grin}, {smile}) ELSE '' END, c_name)")
    b = F.expr(f"concat(c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN {smile} ELSE {grin} END)")
    return table(spark, sf_dir, "customer").select("c_custkey", text.distance(a, b).alias("distance"), F.round(text.text_similarity(a, b), 9).alias("similarity"))


@query(oracles.CORE_TOKENS)
def core_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.core_tokens(F.col("text")), " ").alias("tokens"))


@query("""WITH aliases(v, k) AS (VALUES ('zander', 'oleksandr'), ('alexander', 'oleksandr'), ('chris', 'christopher'), ('pepe', 'kepler'), ('cristiano', 'ronaldo'), ('nicola', 'nicholas'), ('joe', 'joseph'), ('gonzales', 'gonzales'))
SELECT DISTINCT p_name || ' ' || v AS name, list_reduce(list_prepend('', list_append(string_split(p_name, ' '), k)), lambda s, x: trim(s || ' ' || x)) AS tokens FROM part, aliases""")
def canonical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array(*[F.lit(x) for x in ("zander", "alexander", "chris", "pepe", "cristiano", "nicola", "joe", "gonzales")]))
    rows = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("w", words).select(F.concat_ws(" ", "p_name", "w").alias("name"))
    return rows.select("name", F.array_join(text.core_tokens(F.col("name")), " ").alias("tokens"))


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def sharing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two names that share a word."""
    words = name_words(spark, sf_dir).withColumn("w", F.explode(F.split("name", " ")))
    return words.selectExpr("name AS a", "w").join(words.selectExpr("name AS b", "w"), "w").where("a < b").select("a", "b").distinct()


@query(oracles.COMPARED)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    c = text.comparison(a, b)
    rows = sharing_pairs(spark, sf_dir).select("a", "b", F.levenshtein(a, b).alias("distance"), F.round(text.similarity(a, b), 9).alias("similarity"), F.round(text.jaccard(text.words(a), text.words(b)), 9).alias("overlap"), c.alias("c"))
    return rows.select("a", "b", "distance", "similarity", "overlap", F.round("c.primary", 9).alias("compared"), F.round("c.lenient", 9).alias("lenient"))


@query(oracles.SCORED)
def deterministic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharing_pairs(spark, sf_dir)
    norm = {c: text.normalize_name(F.col(c)) for c in "ab"}
    rows = rows.select("a", "b", *[norm[c].alias(f"n{c}") for c in "ab"], *[text.name_tokens(F.col(c), norm[c]).alias(f"t{c}") for c in "ab"])
    return text.with_name_score(rows, "ta", "na", "tb", "nb").select("a", "b", text.near_identical(F.col("na"), F.col("nb")).alias("near"), F.round("score", 9).alias("score"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN value ELSE CASE WHEN event_id % 4 = 1 THEN value ELSE 0 END END AS confidence, CASE WHEN event_id % 4 < 2 THEN value >= 50 ELSE false END AS is_match,
 CASE event_id % 4 WHEN 0 THEN event_type END AS reason, CASE event_id % 4 WHEN 2 THEN 'The answer is no valid JSON.' WHEN 3 THEN 'The answer can''t be read.' END AS error FROM events""")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = """CASE event_id % 4 WHEN 0 THEN concat('Sure: {"Confidence": ', value, ', "isMatch": true, "reason": "', event_type, '"} done') WHEN 1 THEN concat('"confidence": ', value)
 WHEN 2 THEN concat('{"confidence": ', value, ', oops }') ELSE 'no idea' END"""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{said} AS said").withColumn("r", responses.parse_one(F.col("said"), 50.0))
    return rows.select("event_id", "r.confidence", "r.is_match", F.element_at("r.metadata", "reason").alias("reason"), F.element_at("r.metadata", "error").alias("error"))


@query("""SELECT o_custkey, (i.k - 1)::INT AS index, i.c AS confidence FROM (SELECT o_custkey, unnest(list_transform(l, lambda x, k: {'k': k, 'c': x})) AS i FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS l FROM orders GROUP BY 1))""")
def parse_batch_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbering.numbered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])
    each = F.array_sort(F.collect_list(F.struct((F.col("place") - 1).cast("int").alias("index"), F.col("o_totalprice").alias("confidence"))))
    rows = rows.groupBy("o_custkey").agg(F.concat(F.lit("Here: "), F.to_json(F.struct(each.alias("results")))).alias("said"))
    out = rows.select("o_custkey", F.explode(responses.parse_many(F.col("said"))).alias("index", "r"))
    return out.select("o_custkey", "index", "r.confidence")


@query("""SELECT role, count(*) FILTER (turn % 3 <> 2)::BIGINT AS calls, sum(CASE WHEN turn % 3 = 0 THEN length(text) ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN turn % 3 = 0 THEN turn ELSE 0 END)::BIGINT AS completion,
 sum(CASE turn % 3 WHEN 0 THEN length(text) + turn WHEN 1 THEN length(text) * 2 ELSE 0 END)::BIGINT AS total FROM conversations GROUP BY role""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = """CASE turn % 3 WHEN 0 THEN map('usage_prompt_tokens', cast(length(text) as string), 'usage_output_tokens', cast(turn as string)) WHEN 1 THEN map('usage_total_tokens', cast(length(text) * 2 as string)) ELSE map('usage_total_tokens', 'none') END AS metadata"""
    return reports.token_usage(table(spark, sf_dir, "conversations").selectExpr("role", meta), by=("role",))


# --- matching ------------------------------------------------------------------------------------------------------------

LETTERS = "translate(cast({} as string), '0123456789', 'abcdefghij')"
#: In consonants, as doubled vowels count once in normalised names: a team's 105th and 1005th player would share one.
NUMBERED_NAME = "concat(translate(cast({} as string), '0123456789', 'bcdfghjklm'), 'x given')"


def people_and_photos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A player and a photo for every part; photos show the player's name in other orders, longer, cut short, misspelt, or not at all."""
    part = table(spark, sf_dir, "part")
    players = part.selectExpr("p_partkey AS player_seq", "cast(p_partkey AS int) AS PlayerId", "p_size AS TeamId", f"concat(p_name, ' ', {LETTERS.format('p_partkey')}, 'x') AS FullName", "CASE WHEN p_partkey % 10 = 0 THEN cast(p_partkey AS string) END AS External_Player_ID", "p_partkey % 10 = 0 AS ValidMapping", "CASE WHEN p_partkey % 10 = 0 THEN 1.0D ELSE 0.0D END AS Confidence")
    name = f"concat({LETTERS.format('p_partkey')}, 'x')"
    shown = f"CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' ', {name}) WHEN 1 THEN concat({name}, ' ', p_name) WHEN 2 THEN concat(split(p_name, ' ')[0], ' middle ', split(p_name, ' ')[1], ' ', {name}) WHEN 3 THEN concat(split(p_name, ' ')[1], ' ', {name}) WHEN 4 THEN concat(p_name, ' ', {name}, 's') ELSE p_name END"
    photos = part.selectExpr("p_partkey AS cand_seq", "concat('/photos/', p_partkey, '.png') AS path", "cast(p_partkey AS string) AS external_id", f"{shown} AS display_name")
    return players, photos


@query("""WITH asked AS (SELECT c_custkey, 'p' || (c_custkey % 1201) AS id FROM customer WHERE c_custkey % 4 > 0), photos AS (SELECT o_orderkey, 'P' || o_custkey AS id FROM orders),
 firsts AS (SELECT lower(id) AS id, min(c_custkey) AS owner FROM asked GROUP BY 1), have AS (SELECT lower(id) AS id, min(o_orderkey) AS cand_seq FROM photos GROUP BY 1)
SELECT c_custkey AS player_seq, a.id AS "External_Player_ID", CASE WHEN owner = c_custkey THEN cand_seq END AS cand_seq, CASE WHEN owner = c_custkey AND cand_seq IS NOT NULL THEN 'DirectIdMatch' ELSE 'NoMatch' END AS method
FROM asked a JOIN firsts f ON lower(a.id) = f.id LEFT JOIN have h ON h.id = f.id""")
def direct_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "customer").selectExpr("c_custkey AS player_seq", "CASE WHEN c_custkey % 4 > 0 THEN concat('p', c_custkey % 1201) ELSE ' ' END AS External_Player_ID")
    photos = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS cand_seq", "concat('/', o_orderkey) AS path", "concat('P', o_custkey) AS external_id")
    return matching.direct_matches(players, photos).select("player_seq", "External_Player_ID", "cand_seq", "method")


def named_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    players, photos = people_and_photos(spark, sf_dir)
    left, right = written(matching.with_names(players, "FullName"), "players"), written(matching.with_names(matching.rankable(photos), "display_name"), "photos")
    return left, right, matching.best_pairs(left, right, 0.8)


@query(oracles.RANKED)
def rank_topk_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, photos = people_and_photos(spark, sf_dir)
    left, right = written(matching.with_names(players, "FullName"), "players"), written(matching.with_names(matching.rankable(photos), "display_name"), "photos")
    best = {"k": 3, "least": 0.0, "gap": 1.0}
    ranked = matching.ranked_candidates(matching.listed_pairs(left, right, **best), right, **best)
    return left.select("player_seq", F.col("name").alias("left_name")).join(ranked, "left_name").select("player_seq", "cand_seq", "place", F.round("score", 9).alias("score"))


@query(oracles.PROPOSED)
def propose_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.proposals(*named_sides(spark, sf_dir), 0.8).select("player_seq", "cand_seq", F.round("score", 9).alias("score"))


@query(oracles.WON)
def assign_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, photos = people_and_photos(spark, sf_dir)
    return matching.assign(players, photos, 0.8, rounds=1).select("player_seq", "cand_seq", F.round("score", 9).alias("score"))


@query(oracles.all_rounds())
def assign_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, photos = people_and_photos(spark, sf_dir)
    return matching.assign(players, photos, 0.8).select("player_seq", "cand_seq", F.round("score", 9).alias("score"), "round")


@query("""WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part), o AS (SELECT s_suppkey, n, row_number() OVER (PARTITION BY n ORDER BY s_suppkey) AS k FROM (SELECT s_suppkey, name AS n FROM supplier JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT p_name AS name FROM part)) ON i = s_suppkey % 64))
SELECT p_partkey AS player_seq, s_suppkey AS cand_seq, p.k::INT AS round FROM p JOIN o ON p.p_name = o.n AND p.k = o.k""")
def assign_equal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against suppliers that bear the parts' names: people of one name pair off in order."""
    part = table(spark, sf_dir, "part")
    names = numbering.numbered(part.select(F.col("p_name").alias("name")).distinct(), [], ["name"], "i")
    photos = table(spark, sf_dir, "supplier").join(names, F.col("s_suppkey") % 64 == F.col("i") - 1).selectExpr("s_suppkey AS cand_seq", "cast(s_suppkey AS string) AS external_id", "name AS display_name")
    done = matching.assign(part.selectExpr("p_partkey AS player_seq", "p_name AS FullName"), photos, 0.98)
    return done.select("player_seq", "cand_seq", "round")


def letters_scorer(a: str, b: str) -> float:
    """A stand-in for a service: the share of common words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / max(1, min(len(x), len(y)))


@query(oracles.SHORTLISTS)
def scorer_shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, photos = people_and_photos(spark, sf_dir)
    return scorers.shortlists(players, photos, 0).select("player_seq", "cand_seq", "place", F.round("score", 9).alias("score"))


@query()
def scorer_pass_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, photos = people_and_photos(spark, sf_dir)
    return scorers.scorer_pass(players, photos, scorers.StubScorer(letters_scorer), 0.8, 0).won


@query()
def map_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, photos = people_and_photos(spark, sf_dir)
    run = mapping.map_players(players, photos, 0.8, scorer=scorers.StubScorer(letters_scorer), second_pass=True)
    return run.results.select("player_seq", "cand_seq", F.round("confidence", 9).alias("confidence"), "method", "model_used", "pass")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1) // 24)::BIGINT AS batch FROM lineitem""")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = numbering.numbered(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor((F.col("place") - 1) / 24).alias("batch"))


@query("""SELECT p_brand, lower(p_name) AS shown, arg_max(p_partkey, {'a': p_retailprice, 'b': -p_partkey}) AS p_partkey FROM part GROUP BY 1, 2""")
def dedupe_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey")))
    return table(spark, sf_dir, "part").groupBy("p_brand", F.lower("p_name").alias("shown")).agg(best.alias("p_partkey"))


# --- merging -------------------------------------------------------------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a player; two of three have an id."""
    ident = "CASE c_custkey % 3 WHEN 0 THEN CAST(NULL AS STRING) ELSE concat('X', c_custkey) END"
    rows = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS int) AS PlayerId", "c_nationkey AS TeamId", "c_mktsegment AS FamilyName", "c_name AS SurName", f"{ident} AS External_Player_ID")
    return people.as_players(rows)


CUSTOMERS_SQL = """WITH players AS (SELECT c_custkey::INT AS id, c_nationkey AS team, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 'X' || c_custkey END AS ext, c_custkey % 3 > 0 AS valid, CASE WHEN c_custkey % 3 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS conf, c_mktsegment || ' ' || c_name AS shown FROM customer)"""


@query(CUSTOMERS_SQL + """, prior AS (SELECT (o_custkey * 2)::INT AS id, max(o_orderkey)::VARCHAR AS ext FROM orders GROUP BY 1)
SELECT p.id AS "PlayerId", CASE WHEN coalesce(p.ext, '') = '' AND q.id IS NOT NULL THEN q.ext ELSE p.ext END AS "External_Player_ID", CASE WHEN coalesce(p.ext, '') = '' AND q.id IS NOT NULL THEN true ELSE valid END AS "ValidMapping",
 CASE WHEN coalesce(p.ext, '') = '' AND q.id IS NOT NULL THEN 0.5 ELSE conf END AS "Confidence", coalesce(p.ext, '') = '' AND q.id IS NOT NULL AS preserved FROM players p LEFT JOIN prior q ON p.id = q.id""")
def merge_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).cast("int").alias("PlayerId")).agg(F.max("o_orderkey").cast("string").alias("External_Player_ID"), F.lit(True).alias("ValidMapping"), F.lit(0.5).alias("Confidence"))
    return merging.merge_prior(customers(spark, sf_dir), prior).select("PlayerId", "External_Player_ID", "ValidMapping", "Confidence", "preserved")


@query(CUSTOMERS_SQL + """, edits AS (SELECT o_custkey::INT AS id, max(CASE WHEN o_orderstatus = 'F' THEN 'M' || o_custkey END) AS ext FROM orders GROUP BY 1)
SELECT p.id AS "PlayerId", coalesce(e.ext, p.ext) AS "External_Player_ID", valid OR e.ext IS NOT NULL AS "ValidMapping", CASE WHEN e.ext IS NOT NULL THEN 1.0 ELSE conf END AS "Confidence" FROM players p LEFT JOIN edits e ON p.id = e.id""")
def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey AS int) AS PlayerId", "CASE WHEN o_orderstatus = 'F' THEN concat('M', o_custkey) ELSE ' ' END AS External_Player_ID")
    return merging.apply_manual(customers(spark, sf_dir), edits).select("PlayerId", "External_Player_ID", "ValidMapping", "Confidence")


@query(CUSTOMERS_SQL + """ SELECT id AS "PlayerId", shown AS "FullName" FROM players WHERE NOT valid OR coalesce(trim(ext), '') = ''""")
def unmapped_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.unmapped_players(customers(spark, sf_dir)).select("PlayerId", "FullName").orderBy("FullName", "PlayerId")


def order_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a photo of its customer; one of five has no id."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS cand_seq", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('x', 2 * (o_custkey + o_orderkey % 3)) END AS external_id")


PHOTOS_SQL = CUSTOMERS_SQL + ", photos AS (SELECT o_orderkey AS cand_seq, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'x' || (2 * (o_custkey + o_orderkey % 3)) END AS external_id FROM orders)"


@query(PHOTOS_SQL + " SELECT cand_seq, external_id FROM photos WHERE external_id <> '' AND lower(external_id) NOT IN (SELECT lower(ext) FROM players WHERE ext IS NOT NULL)")
def free_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.free_photos(order_photos(spark, sf_dir), customers(spark, sf_dir))


STATES_SQL = PHOTOS_SQL + """, states AS (SELECT cand_seq, external_id, p.id AS "PlayerId", CASE WHEN external_id = '' THEN 'no_id' WHEN p.id IS NOT NULL THEN 'matched' ELSE 'not_in_csv' END AS state FROM photos LEFT JOIN players p ON lower(p.ext) = lower(external_id))"""


@query(STATES_SQL + " SELECT * FROM states")
def photo_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.photo_states(order_photos(spark, sf_dir), customers(spark, sf_dir))


@query(STATES_SQL + """ SELECT count(*) AS total, count(*) FILTER (state = 'matched') AS mapped, count(*) FILTER (state = 'not_in_csv') AS not_in_csv, count(*) FILTER (state = 'no_id') AS no_id,
 (SELECT count(*) FROM players WHERE ext IS NULL OR lower(ext) NOT IN (SELECT lower(external_id) FROM photos)) AS csv_without_photo FROM states""")
def photo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, players = order_photos(spark, sf_dir), customers(spark, sf_dir)
    return reports.photo_grid(merging.photo_states(photos, players), merging.without_photo(players, photos, blank_too=True))


@query(PHOTOS_SQL + """ SELECT id AS "PlayerId", ext AS "External_Player_ID" FROM players WHERE ext IS NOT NULL AND lower(ext) NOT IN (SELECT lower(external_id) FROM photos)""")
def players_without_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.without_photo(customers(spark, sf_dir), order_photos(spark, sf_dir)).select("PlayerId", "External_Player_ID")


@query("""SELECT n_nationkey::INT AS "TeamId", n_name AS "TeamName" FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def teams_with_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "supplier").selectExpr("concat('nation_', s_nationkey) AS folder")
    return merging.teams_with_folder(extract_teams(spark, sf_dir), folders).select("TeamId", "TeamName")


@query("SELECT user_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS event_type, max({'ts': ts, 'id': event_id}).id AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by a stream over the events."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    upserts.keep_upserted(rows, f"{folder}/table", f"{folder}/checkpoint", ["user_id"], "at").awaitTermination()
    return upserts.current(spark, f"{folder}/table", rows.schema).select("user_id", "event_type", "event_id")


# --- reports -------------------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS processed, count(*) FILTER (value >= 50) AS matched, count(*) FILTER (event_type = 'view') AS direct, count(*) FILTER (event_type = 'click') AS string, count(*) FILTER (event_type = 'signup') AS ai_pass_1,
 count(*) FILTER (event_type = 'purchase') AS ai_pass_2, count(*) FILTER (event_type IN ('signup', 'purchase')) AS ai_total, count(*) FILTER (event_type IN ('view', 'click')) AS first_round, count(*) FILTER (NOT value >= 50) AS unmapped FROM events""")
def mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = "CASE event_type WHEN 'view' THEN 'DirectIdMatch' WHEN 'error' THEN 'NoMatch' ELSE 'AiNameMatching' END AS method"
    rows = table(spark, sf_dir, "events").selectExpr(method, "CASE event_type WHEN 'click' THEN 'StringMatching' ELSE 'm' END AS model_used", "CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS pass", "value AS confidence", "50.0D AS threshold")
    return reports.mapping_summary(rows)


def tests(spark: SparkSession, sf_dir: str, late: bool | None = None) -> DataFrame:
    """Every event as a test of the model of its type; late: those of the second half of the table, or of the first."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS model", "user_id % 2 = 0 AS expected", "value >= 20 AS predicted", "value AS confidence", "event_id % 100 AS ms", "event_id", "hour(ts) >= 12 AS late")
    return rows if late is None else rows.where(F.col("late") == late)


METRICS_SQL = "SELECT event_type AS model, count(*) AS tests, sum(((user_id % 2 = 0) = (value >= 20))::INT)::BIGINT AS correct, avg(((user_id % 2 = 0) = (value >= 20))::INT) AS accuracy, avg(event_id % 100) AS avg_ms, coalesce(sum(value) FILTER (value >= 20) / count(*) FILTER (value >= 20), 0) AS avg_confidence FROM events"


@query("""WITH r AS (SELECT l_returnflag AS preset, expected_ AS expected, c FROM (SELECT l_returnflag, l_suppkey % 3 > 0 AS expected_, CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE (l_orderkey * 7 + l_linenumber * 13 + l_suppkey % 3 * 20) % 101 END AS c FROM lineitem)),
 g AS (SELECT preset, t FROM (SELECT DISTINCT preset FROM r), (SELECT unnest(range(0, 101)) AS t)),
 m AS (SELECT g.preset, t, count(*) AS tests, sum((c >= t)::INT) AS accepted, sum((c >= t AND expected)::INT) AS hits, sum(((c >= t) = expected)::INT) AS same, sum(expected::INT) AS positives FROM g JOIN r ON r.preset = g.preset GROUP BY g.preset, t)
SELECT preset, t / 100.0::DOUBLE AS threshold, tests, accepted::BIGINT AS accepted, hits::BIGINT AS "right", round(same / tests::DOUBLE, 9) AS accuracy, round(CASE WHEN accepted > 0 THEN hits / accepted::DOUBLE ELSE 1 END, 9) AS precision, round(CASE WHEN positives > 0 THEN hits / positives::DOUBLE ELSE 1 END, 9) AS recall FROM m""")
def sweep_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three presets at a hundred and one thresholds."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS preset", "l_suppkey % 3 > 0 AS expected", "CASE WHEN l_partkey % 50 > 0 THEN (l_orderkey * 7 + l_linenumber * 13 + l_suppkey % 3 * 20) % 101 / 100D END AS confidence")
    out = reports.threshold_sweep(rows)
    return out.select("preset", "threshold", "tests", "accepted", "right", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall")])


@query(f"SELECT model, tests, correct, round(accuracy, 6) AS accuracy, round(avg_ms, 6) AS avg_ms, round(avg_confidence, 6) AS avg_confidence FROM ({METRICS_SQL} GROUP BY 1)")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.benchmark_metrics(tests(spark, sf_dir)).select("model", "tests", "correct", *[F.round(c, 6).alias(c) for c in ("accuracy", "avg_ms", "avg_confidence")])


@query("SELECT event_type AS model, count(*) AS tests, sum((user_id % 3 = (value >= 20)::INT)::INT)::BIGINT AS correct, round(avg((user_id % 3 = (value >= 20)::INT)::INT), 6) AS accuracy, round(avg(value) FILTER (value >= 20), 6) AS avg_confidence FROM events GROUP BY 1")
def face_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS model", "user_id % 3 AS expected", "value >= 20 AS found", "value AS confidence", "1 AS ms")
    return reports.face_metrics(rows).select("model", "tests", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("avg_confidence", 6).alias("avg_confidence"))


@query(f"WITH m AS ({METRICS_SQL} GROUP BY 1) SELECT (SELECT model FROM m ORDER BY accuracy DESC, model LIMIT 1) AS most_accurate, (SELECT model FROM m ORDER BY avg_ms, model LIMIT 1) AS fastest")
def benchmark_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_models(reports.benchmark_metrics(tests(spark, sf_dir)))


@query(f"""WITH a AS ({METRICS_SQL} WHERE hour(ts) < 12 GROUP BY 1), b AS ({METRICS_SQL} WHERE hour(ts) >= 12 GROUP BY 1),
 pairs AS (SELECT a.model, unnest([{{'metric': 'accuracy', 'baseline': a.accuracy, 'candidate': b.accuracy}}, {{'metric': 'avg_ms', 'baseline': a.avg_ms, 'candidate': b.avg_ms}}, {{'metric': 'avg_confidence', 'baseline': a.avg_confidence, 'candidate': b.avg_confidence}}, {{'metric': 'tests', 'baseline': a.tests::DOUBLE, 'candidate': b.tests::DOUBLE}}]) AS m FROM a JOIN b ON lower(a.model) = lower(b.model))
SELECT model, m.metric AS metric, round(m.baseline, 6) AS baseline, round(m.candidate, 6) AS candidate, round(m.candidate - m.baseline, 6) AS delta FROM pairs""")
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (reports.benchmark_metrics(tests(spark, sf_dir, late)) for late in (False, True))
    return reports.compare_all(a, b).select("model", "metric", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")])


@query("SELECT event_type AS model, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 10")
def first_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_rows(tests(spark, sf_dir), "model", "event_id", 10).select("model", "event_id")


def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = "CASE TeamId % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Skipped' ELSE 'Completed' END AS status"
    rows = customers(spark, sf_dir).groupBy("TeamId").agg(F.count("*").cast("int").alias("extracted"), F.count_if("ValidMapping").cast("int").alias("mapped"), F.array_sort(F.collect_list(F.when(~F.col("ValidMapping"), F.col("FullName")))).alias("unmapped_names"))
    return rows.selectExpr("concat('T', TeamId) AS team", states, "concat('state of ', TeamId) AS message", "extracted", "CASE WHEN TeamId % 7 = 0 THEN extracted ELSE mapped END AS mapped", "unmapped_names")


TEAMS_SQL = CUSTOMERS_SQL + """, teams AS (SELECT 'T' || team AS team, CASE team % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Skipped' ELSE 'Completed' END AS status, 'state of ' || team AS message, count(*)::INT AS extracted,
 (CASE WHEN team % 7 = 0 THEN count(*) ELSE count(*) FILTER (valid) END)::INT AS mapped, list(shown ORDER BY shown) FILTER (NOT valid) AS names FROM players GROUP BY players.team),
 issues AS (SELECT *, greatest(0, extracted - mapped) AS missing, status = 'Completed' AND extracted > mapped AS short FROM teams)"""


@query(TEAMS_SQL + """ SELECT team, status, CASE WHEN status = 'Completed' THEN 'Unmapped players: ' || missing ELSE message END AS message, status = 'Failed' OR short AS critical, CASE WHEN short THEN array_to_string(names, ', ') ELSE '' END AS details FROM issues WHERE status <> 'Completed' OR short""")
def batch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.team_issues(team_rows(spark, sf_dir))


@query(TEAMS_SQL + """, s AS (SELECT count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Skipped') AS skipped, count(*) FILTER (short) AS unmapped_teams, coalesce(sum(missing) FILTER (short), 0)::BIGINT AS unmapped_players, sum(extracted)::BIGINT AS players, sum(mapped)::BIGINT AS mapped FROM issues)
SELECT *, 'Issues: ' || failed || ' failed, ' || skipped || ' skipped, ' || unmapped_players || ' unmapped players (' || unmapped_teams || ' teams); mapped ' || mapped || '/' || players AS title FROM s""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_summary(team_rows(spark, sf_dir))


@query("""SELECT event_type AS label, count(*) AS n, array_to_string((list(event_id::VARCHAR ORDER BY event_id::VARCHAR))[1:50], ', ') AS details FROM events GROUP BY 1""")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_counts(table(spark, sf_dir, "events").selectExpr("event_type AS label", "cast(event_id AS string) AS detail"))


@query("""SELECT event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY event_id::VARCHAR) AS place, event_id::VARCHAR AS detail FROM events""")
def issue_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_details(table(spark, sf_dir, "events").selectExpr("event_type AS label", "cast(event_id AS string) AS detail"))


@query("""WITH t AS (SELECT *, n_nationkey NOT IN (3, 4) AND n_nationkey IN (SELECT s_nationkey FROM supplier) AS done FROM nation)
SELECT n_nationkey::INT AS "TeamId", n_name AS team, CASE WHEN done THEN 'Completed' ELSE 'Skipped' END AS status, count(c_custkey)::INT AS extracted, (CASE WHEN done THEN count(c_custkey) FILTER (c_custkey % 3 > 0) ELSE 0 END)::INT AS mapped
FROM t LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, done""")
def team_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "supplier").selectExpr("concat('nation_', s_nationkey) AS folder")
    return batches.team_states(extract_teams(spark, sf_dir), customers(spark, sf_dir), folders, disabled=[3, 4]).select("TeamId", "team", "status", "extracted", "mapped")


@query("""SELECT n_nationkey::INT AS "TeamId", step FROM nation, (VALUES ('extract'), ('map'), ('generate')) s(step) WHERE (n_nationkey, step) NOT IN (SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'map' ELSE 'none' END FROM customer)""")
def left_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "customer").selectExpr("cast(c_nationkey AS int) AS TeamId", "CASE c_custkey % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'map' ELSE 'none' END AS step")
    return batches.left_to_do(extract_teams(spark, sf_dir), outputs)


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey AS team, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
 spoilt AS (SELECT team, min('no. ' || id) AS first, count(*) AS n FROM p WHERE team IN (5, 11) AND k % 20 = 2 GROUP BY 1),
 s AS (SELECT n_nationkey AS team, CASE WHEN n_nationkey = 3 THEN 'Skipped' WHEN first IS NOT NULL THEN 'Failed' WHEN n_nationkey = 6 THEN 'Skipped' ELSE 'Completed' END AS status,
   CASE WHEN n_nationkey = 3 THEN 'switched off' WHEN first IS NOT NULL THEN 'PlayerId isn''t a number: ' || first || CASE WHEN n > 1 THEN ', and ' || (n - 1) || ' more' ELSE '' END WHEN n_nationkey = 6 THEN 'no folder of photos' ELSE '' END AS message FROM nation LEFT JOIN spoilt ON team = n_nationkey),
 m AS (SELECT p.team, id, status, message, CASE WHEN status <> 'Completed' THEN 'old' || id WHEN k % 3 > 0 THEN 'x' || k WHEN k % 7 > 0 THEN 'N' || k WHEN k % 2 = 0 THEN 'old' || id END AS ext, k FROM p JOIN s ON p.team = s.team WHERE status = 'Completed' OR k % 2 = 0)
SELECT team::INT AS "TeamId", status, message, id::INT AS "PlayerId", CASE WHEN status = 'Completed' AND k % 3 > 0 AND k % 5 > 0 THEN upper(ext) ELSE ext END AS "External_Player_ID", ext IS NOT NULL AS "ValidMapping", (CASE WHEN ext LIKE 'old%' THEN 0.9 WHEN ext IS NULL THEN 0 ELSE 1 END)::DOUBLE AS "Confidence" FROM m""")
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players of their nations: ids and names are the same in every team. Two teams have rows that can't be read, one no
    folder, and one is switched off: they keep what lay there, a row for every second player."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = written(numbering.numbered(rows, ["c_nationkey"], ["c_custkey"], "k"), "rows")
    name = f"{NUMBERED_NAME.format('k')} AS"
    players = rows.selectExpr("CASE WHEN c_nationkey IN (5, 11) AND k % 20 = 2 THEN concat('no. ', c_custkey) ELSE string(c_custkey) END AS PlayerId", "string(c_nationkey) AS TeamId", f"{name} FamilyName", "'' AS SurName", "CASE WHEN k % 3 > 0 THEN concat('x', k) END AS External_Player_ID", "c_custkey AS seq")
    ident = "CASE WHEN k % 3 > 0 THEN concat('X', k) ELSE concat('N', k) END AS external_id"
    photos = rows.where("c_nationkey <> 6 AND CASE WHEN k % 3 > 0 THEN k % 5 > 0 ELSE k % 7 > 0 END").selectExpr("concat('nation_', c_nationkey) AS folder", "concat('/', c_custkey, '.png') AS path", ident, f"{name} display_name", "c_custkey AS seq")
    path = f"{shared_dir(spark)}/teams-{uuid.uuid4().hex}"
    before = people.as_players(rows.where("k % 2 = 0").selectExpr("c_custkey AS PlayerId", "c_nationkey AS TeamId", "'' AS FamilyName", "'' AS SurName", "concat('old', c_custkey) AS External_Player_ID", "true AS ValidMapping", "0.9D AS Confidence"), keep_flags=True)
    teams = extract_teams(spark, sf_dir)
    batches.write_outputs(before, teams, path)
    done = batches.run_teams(teams, players, photos, path, disabled=[3], keep_prior=True)
    return done.states.select("TeamId", "status", "message").join(done.output, "TeamId").select("TeamId", "status", "message", "PlayerId", "External_Player_ID", "ValidMapping", "Confidence")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference names of customers against the names that orders show, by nation."""
    reference = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS string) AS external_id", "concat(c_mktsegment, ' ', c_nationkey) AS reference_name", "c_nationkey AS team")
    photos = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + F.col("o_custkey") % 2 * 500).cast("string").alias("external_id")).agg(F.count("*").alias("n"))
    names = photos.join(reference.select("external_id", F.col("reference_name").alias("r")), "external_id", "left").selectExpr("external_id", "CASE n % 4 WHEN 0 THEN concat(r, ' extra') WHEN 1 THEN 'Zoé' WHEN 2 THEN r ELSE 'other' END AS p").selectExpr("external_id", "coalesce(p, 'unknown') AS photo_name")
    return reports.validation_status(reference, names, text.validation_name(F.col("reference_name")) == text.validation_name(F.col("photo_name"))).withColumn("team", (F.col("external_id").cast("long") % 25).cast("int"))


CHECKED_SQL = """WITH reference AS (SELECT c_custkey::VARCHAR AS id, c_mktsegment || ' ' || c_nationkey AS r FROM customer), counts AS (SELECT (o_custkey + o_custkey % 2 * 500)::VARCHAR AS id, count(*) AS n FROM orders GROUP BY 1),
 photos AS (SELECT c.id, coalesce(CASE n % 4 WHEN 0 THEN r || ' extra' WHEN 1 THEN 'Zoé' WHEN 2 THEN r ELSE 'other' END, 'unknown') AS p FROM counts c LEFT JOIN reference f ON c.id = f.id),
 checked AS (SELECT coalesce(f.id, c.id) AS external_id, coalesce(r, '') AS reference_name, coalesce(p, '') AS photo_name, CASE WHEN p IS NULL THEN 'missing' WHEN r IS NULL THEN 'extra' WHEN lower(r) = lower(p) THEN 'correct' ELSE 'incorrect' END AS status, (coalesce(f.id, c.id)::BIGINT % 25)::INT AS team FROM reference f FULL JOIN photos c ON f.id = c.id)"""


@query(CHECKED_SQL + " SELECT * FROM checked")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir)


ACCURACY_SQL = CHECKED_SQL + """, acc AS (SELECT team, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'incorrect') AS incorrect, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra, count(*) AS rows FROM checked GROUP BY ROLLUP (team)),
 shares AS (SELECT *, CASE WHEN correct + incorrect + missing > 0 THEN 100.0::DOUBLE * correct / (correct + incorrect + missing) ELSE 0 END AS accuracy, 100.0::DOUBLE * correct / rows AS accuracy_of_rows FROM acc)"""
ROUNDED = ("accuracy", "accuracy_of_rows")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.team_accuracy(checked(spark, sf_dir))


@query(ACCURACY_SQL + " SELECT * REPLACE (round(accuracy, 6) AS accuracy, round(accuracy_of_rows, 6) AS accuracy_of_rows) FROM shares")
def team_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ROUNDED})


@query(ACCURACY_SQL + " SELECT team, row_number() OVER (ORDER BY accuracy_of_rows DESC, team)::INT AS place FROM shares WHERE team IS NOT NULL")
def rank_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked_teams(accuracy(spark, sf_dir)).select("team", "place")


@query(ACCURACY_SQL + " SELECT team, round(incorrect::DOUBLE / rows, 6) AS rate FROM shares WHERE team IS NOT NULL AND incorrect::DOUBLE / rows > 0.3")
def problem_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.problem_teams(accuracy(spark, sf_dir)).select("team", F.round("rate", 6).alias("rate"))


@query(CHECKED_SQL + """, kinds AS (SELECT CASE WHEN contains(photo_name, reference_name) OR contains(reference_name, photo_name) THEN 'missing_middle_name' WHEN regexp_matches(photo_name, '[áéíóúñ]') THEN 'encoding'
 WHEN contains(photo_name, split_part(reference_name, ' ', 1) || ' ' || split_part(reference_name, ' ', 1)) THEN 'duplicate' ELSE 'other' END AS category FROM checked WHERE status = 'incorrect')
SELECT category, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM kinds GROUP BY 1""")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_categories(checked(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS team, c_custkey AS id FROM customer), m AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F') SELECT team, count(*) AS expected, count(m.id) AS made, count(*) - count(m.id) AS missing, round(100.0::DOUBLE * count(m.id) / count(*), 6) AS percent FROM e LEFT JOIN m ON e.id = m.id GROUP BY 1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS team", "c_custkey AS id")
    made = expected.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS id").distinct(), "id", "left_semi")
    return reports.coverage(expected, made, "id", by=("team",)).withColumn("percent", F.round("percent", 6))


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right' WHEN b.id IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT c_custkey AS id FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 100 AS id FROM orders) b ON a.id = b.id""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.set_difference(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id"), table(spark, sf_dir, "orders").selectExpr("o_custkey + 100 AS id"), "id")


@query("SELECT source, count(*) AS files, round(avg(strlen(text)) / 1024, 2) AS mean_kb FROM documents GROUP BY 1")
def avg_size_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mean_kb(table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("length")), by=("source",))


@query("SELECT p_size AS width, (p_partkey % 7)::BIGINT AS height, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, width, height LIMIT 5")
def top_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_sizes(table(spark, sf_dir, "part").selectExpr("p_size AS width", "p_partkey % 7 AS height"))


@query("""WITH h AS (SELECT 'a' AS run, doc_id AS id, sha256(text) AS d FROM documents UNION ALL SELECT 'b', doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END) FROM documents UNION ALL SELECT 'c', doc_id + 10, sha256(text) FROM documents)
SELECT a.run AS run_a, b.run AS run_b, count(*) AS common, count(*) FILTER (a.d = b.d) AS same, count(*) FILTER (a.d <> b.d) AS different FROM h a JOIN h b ON a.id = b.id AND a.run < b.run GROUP BY 1, 2""")
def hash_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = docs.selectExpr("doc_id", "text", "inline(array(struct('a' AS run, doc_id AS id, text AS t), struct('b' AS run, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN concat(text, '.') ELSE text END AS t), struct('c' AS run, doc_id + 10 AS id, text AS t)))")
    return reports.compare_runs(runs.select("run", "id", F.sha2("t", 256).alias("digest")))


# --- rules ---------------------------------------------------------------------------------------------------------------

MODELS = ["openai:gpt", "claude:x", "qwen3:8b", "kimi-k2.5:cloud", "coder:480b-cloud", "llama", "mistral/free", "nomic-embed", " ", "ZAI:glm", "phi:free", "minimax:m2", "Llama"]
MODELS_SQL = "WITH models AS (SELECT p_partkey, [" + ", ".join(f"'{m}'" for m in MODELS) + f"][p_partkey % {len(MODELS)} + 1] AS model FROM part)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array(*[F.lit(m) for m in MODELS])[(F.col("p_partkey") % len(MODELS)).cast("int")].alias("model"))


@query(MODELS_SQL + """ SELECT p_partkey, model, CASE WHEN trim(model) = '' OR contains(lower(model), 'embed') THEN NULL WHEN regexp_matches(lower(model), '^(openai|anthropic|claude|zai|minimax):') THEN 'paid'
 WHEN regexp_matches(lower(model), '(:cloud|-cloud|/free)$') OR contains(lower(model), ':free') THEN 'free' ELSE 'local' END AS tier FROM models""")
def model_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).withColumn("tier", rules.model_tier(F.col("model")))


@query(MODELS_SQL + """ SELECT p_partkey, CASE WHEN regexp_matches(lower(model), '^(ollama|openai|anthropic|claude|zai|minimax):') THEN lower(split_part(model, ':', 1)) ELSE 'ollama' END AS provider,
 CASE WHEN regexp_matches(lower(model), '^(ollama|openai|anthropic|claude|zai|minimax):') THEN substr(model, strpos(model, ':') + 1) ELSE model END AS model FROM models""")
def provider_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("p_partkey", rules.provider_and_model(F.col("model")).alias("r")).select("p_partkey", "r.provider", "r.model")


@query(MODELS_SQL + " SELECT min(model) AS model FROM models WHERE trim(model) <> '' AND NOT regexp_matches(lower(trim(model)), '(:cloud|-cloud)$') AND lower(model) <> 'qwen3:8b' GROUP BY lower(model)")
def models_to_unload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.models_to_unload(models(spark, sf_dir), "qwen3:8b")


@query(MODELS_SQL + ", c AS (SELECT lower(p_brand) AS model, 0 AS rank FROM part UNION ALL SELECT p_brand, 1 FROM part UNION ALL SELECT model, 1 FROM models) SELECT min({'rank': rank, 'model': model}).model AS model, min({'rank': rank, 'model': model}).rank AS rank FROM c WHERE trim(model) <> '' GROUP BY lower(trim(model))")
def merged_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return reports.merged_models(part.selectExpr("lower(p_brand) AS model"), part.selectExpr("p_brand AS model").unionByName(models(spark, sf_dir).select("model")))


# --- geometry ------------------------------------------------------------------------------------------------------------

BOX = """cast(l_partkey % 900 AS int) AS fx, cast(l_orderkey % 700 AS int) AS fy, cast(l_quantity * 7 AS int) AS fw, cast(l_quantity * 9 AS int) AS fh, l_linenumber AS kind, cast(1000 + l_suppkey % 13 * 50 AS int) AS w, cast(800 + l_partkey % 11 * 70 AS int) AS h,
 cast(l_partkey % 900 + l_quantity * 2 AS int) AS lx, cast(l_orderkey % 700 + l_quantity * 3 AS int) AS ly, cast(l_partkey % 900 + l_quantity * (l_linenumber % 3 + 3) AS int) AS rx, cast(l_orderkey % 700 + l_quantity * 3 + l_linenumber % 4 AS int) AS ry"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face, eyes and a picture's size from every line of an order; by line number a face with both eyes, one, none; eyes alone; nothing."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *split_columns(BOX))
    pt = lambda x, y, cond: F.when(F.expr(cond), geometry.point(F.col(x), F.col(y)))
    face = F.when(F.expr("kind not in (4, 6)"), geometry.rect(*[F.col(c) for c in ("fx", "fy", "fw", "fh")]))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "w", "h", F.expr("kind <> 6").alias("found"), face.alias("face"), pt("lx", "ly", "kind in (1, 2, 4, 7)").alias("left"), pt("rx", "ry", "kind in (1, 3, 7)").alias("right"))


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 4 AS kind, CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 3 = 1 THEN 2 ELSE 3 END AS attempt, l_partkey % 60 AS x, l_suppkey % 40 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, attempt, kind < 2 AS face_detected, CASE kind WHEN 0 THEN trunc((x + 1) / 100.0::DOUBLE * 800)::INT WHEN 1 THEN (x + 1) * 8 END AS face_x, CASE kind WHEN 0 THEN trunc((y + 1) / 100.0::DOUBLE * 600)::INT WHEN 1 THEN (y + 1) * 6 END AS face_y,
 CASE WHEN kind < 2 THEN 160 END AS face_width, CASE WHEN kind = 0 THEN trunc(((x + 1) / 100.0::DOUBLE + 0.05::DOUBLE) * 800)::INT END AS eye_x,
 CASE kind WHEN 2 THEN 'no_json' WHEN 3 THEN 'broken_json' END AS error FROM a""")
def parse_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in prose and code fences, in fractions or pixels, some without JSON or with a broken one; up to three attempts a picture."""
    x, y = "(l_partkey % 60 + 1)", "(l_suppkey % 40 + 1)"
    said = f"""CASE l_orderkey % 4 WHEN 0 THEN concat('Sure: ```json {{"faceDetected": true, "bothEyesDetected": true, "faceRect": {{"x": ', {x} / 100D, ', "y": ', {y} / 100D, ', "width": 0.2, "height": 0.25}}, "leftEye": {{"x": ', {x} / 100D + 0.05, ', "y": ', {y} / 100D + 0.1, '}}, "confidence": 0.9}} ```')
      WHEN 1 THEN concat('{{"faceDetected": true, "faceRect": {{"x": ', {x} * 8, ', "y": ', {y} * 6, ', "width": 160, "height": 150}}, "confidence": 0.8}}') WHEN 2 THEN 'I see nobody.' ELSE 'Well {{"faceDetected": true, }} indeed' END"""
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("path"), F.expr(said).alias("said"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    attempts = rows.select("path", "attempt", F.when(F.col("attempt") > F.col("path.l_orderkey") % 3, F.col("said")).alias("response"), F.lit("timeout").alias("error"))
    first = images.first_answers(attempts).withColumn("p", responses.parse_landmarks(F.col("response"), F.lit(800), F.lit(600)))
    return first.select("path.l_orderkey", "path.l_linenumber", "path.l_partkey", "path.l_suppkey", "attempt", "p.face_detected", F.col("p.face.x").alias("face_x"), F.col("p.face.y").alias("face_y"), F.col("p.face.width").alias("face_width"), F.col("p.left_eye.x").alias("eye_x"), "p.error")


@query(oracles.landmarks(BOX))
def landmark_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(*LINE, geometry.landmark_error(*[F.col(c) for c in ("found", "face", "left", "right", "w", "h")]).alias("error"))


@query(oracles.crops(BOX))
def crop_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.with_crop(boxes(spark, sf_dir), 200, 300, 4.0, -6.0, out="c").withColumn("t", geometry.aspect_trim(F.col("c"), 150, 200))
    return rows.select(*LINE, *[F.col(f"c.{k}").alias(k) for k in ("x", "y", "width", "height")], F.col("t.x").alias("trim_x"), F.col("t.width").alias("trim_width"), F.col("t.height").alias("trim_height"))


VARIANTS = [("x34x50", 34, 50, "small", "p34.png"), ("x200x300", 200, 300, "", "p200.png"), ("big", 200, 300, "big", "p200.png"), ("x100x150", 100, 150, None, "p100.png")]


@query("""WITH v AS (SELECT * FROM (VALUES ('x34x50', 34, 50, 'small', 'p34.png'), ('x200x300', 200, 300, '', 'p200.png'), ('big', 200, 300, 'big', 'p200.png'), ('x100x150', 100, 150, NULL, 'p100.png')) t(variant, width, height, folder, placeholder))
SELECT p_partkey::INT AS "PlayerId", variant, width, height, variant = 'x200x300' AS is_base, CASE WHEN p_partkey % 4 = 0 THEN 'placeholder' ELSE 'portrait' END AS status, CASE WHEN p_partkey % 4 = 0 THEN placeholder ELSE '/photos/' || p_partkey || '.png' END AS source,
 CASE WHEN coalesce(trim(folder), '') <> '' THEN folder || '/' ELSE '' END || p_partkey || '.jpg' AS output FROM part, v""")
def variant_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "cast(null AS struct<x:int,y:int>)"
    rows = table(spark, sf_dir, "part").selectExpr("cast(p_partkey AS int) AS PlayerId", "CASE WHEN p_partkey % 4 > 0 THEN concat('/photos/', p_partkey, '.png') END AS path", "false AS found", "cast(null AS struct<x:int,y:int,width:int,height:int>) AS face", f"{none} AS left_eye", f"{none} AS right_eye", "1000 AS image_w", "1500 AS image_h")
    return images.fan_out(rows, VARIANTS).drop("crop")


@query("""WITH d AS (SELECT l_orderkey AS path, ['a', 'b', 'c'][l_linenumber % 3 + 1] AS detector, l_returnflag <> 'N' AS face_detected, l_quantity AS q, CASE WHEN l_tax > 0.06 THEN 'failed' END AS error FROM lineitem),
 r AS (SELECT *, list_position(['b', 'a', 'c'], detector) AS rank FROM d), m AS (SELECT path, min({'rank': rank, 'q': q, 'detector': detector}) FILTER (face_detected AND error IS NULL) AS r FROM r GROUP BY 1)
SELECT path, r IS NOT NULL AS found, r.detector AS detector, r.q AS q FROM m""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS path", "l_quantity AS q", "element_at(array('a', 'b', 'c'), l_linenumber % 3 + 1) AS detector", "l_returnflag <> 'N' AS face_detected", "CASE WHEN l_tax > 0.06 THEN 'failed' END AS error")
    return images.first_found(rows, ["b", "a", "c"]).select("path", "found", "detector", "q")


@query("""WITH c AS (SELECT 'f' || o_custkey AS p, arg_max({'s': o_orderkey % 5, 't': o_orderdate, 'k': o_orderkey}, {'t': o_orderdate, 's': o_orderkey % 5, 'k': o_orderkey}) AS e FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN e.s = c_custkey % 5 AND e.t = (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) THEN false ELSE true END AS due FROM customer LEFT JOIN c ON p = 'f' || c_custkey""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = "CASE o_orderstatus WHEN 'P' THEN map('error', 'x') ELSE map('k', 'v') END"
    mark = f"named_struct('face_detected', true, 'model_used', CASE o_orderkey % 2 WHEN 0 THEN 'M' ELSE '' END, 'metadata', {meta})"
    orders = table(spark, sf_dir, "orders")
    # of the entries of one picture and time the one with the largest size and key was written last
    entries = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey", "o_orderdate").agg(F.max(F.struct((F.col("o_orderkey") % 5).alias("s"), F.col("o_orderkey"))).alias("e")).selectExpr("o_custkey", "o_orderdate", "e.s", "e.o_orderkey", "'F' AS o_orderstatus")
    entries = entries.unionByName(orders.where("o_orderstatus = 'P'").selectExpr("o_custkey", "o_orderdate", "o_orderkey % 5 AS s", "o_orderkey", "o_orderstatus"))
    cache = entries.selectExpr("concat('F', o_custkey) AS ImagePath", "s AS FileSize", "cast(o_orderdate AS timestamp) AS LastModified", f"{mark} AS Landmarks", "'m' AS Model")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("modified"))
    files = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr("c_custkey AS id", "concat('f', c_custkey) AS path", "c_custkey % 5 AS length", "modified")
    return images.cached_or_due(files, cache, "M").select("id", "due")


@query(oracles.SUPPRESSED)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS picture", "l_orderkey * 8 + l_linenumber AS box_id", "cast(l_suppkey % 60 AS double) AS x", "cast(l_orderkey % 50 AS double) AS y", "l_quantity + 20 AS width", "l_quantity + 30 AS height", "l_extendedprice AS score")
    return images.suppress(rows, "picture").select("picture", "box_id")


@query(oracles.SUPPRESSED_IN_ROUNDS)
def nms_huge_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes in two pictures, which grow with the table; in tiles at every size, as huge pictures are."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber <= 3 AS picture", "l_orderkey * 8 + l_linenumber AS box_id", "l_orderkey * 0.5D AS x", "l_suppkey * 37 % 1009 + l_linenumber * 0.25D AS y", "l_quantity + 20 AS width", "l_partkey % 90 + 4 AS height", "l_extendedprice AS score")
    return images.suppress(rows, "picture", most=1_000_000, stream=0).select("picture", "box_id")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS c, 0.1 + (l_partkey % 50) / 100.0::DOUBLE AS x, 0.2 + (l_orderkey % 30) / 100.0::DOUBLE AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(x * 640)::INT AS face_x, trunc(y * 480)::INT AS face_y, trunc((x + 0.25) * 640 - x * 640)::INT AS face_w, (trunc(y * 480) + trunc(trunc((y + 0.375) * 480 - y * 480) * 0.4::DOUBLE))::INT AS eye_y FROM b WHERE round(c, 6) >= 0.7""")
def decode_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*LINE, "round(l_discount * 10, 6) AS c", "0.1D + (l_partkey % 50) / 100.0D AS x", "0.2D + (l_orderkey % 30) / 100.0D AS y")
    box = F.struct(F.col("c").alias("confidence"), F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + 0.25).alias("right"), (F.col("y") + 0.375).alias("bottom"))
    weak = F.struct(F.lit(0.1).alias("confidence"), *[F.lit(0.0).alias(k) for k in ("left", "top", "right", "bottom")])
    rows = rows.select(*LINE, geometry.decode_box(F.array(weak, box), F.lit(640), F.lit(480)).alias("d")).where("d is not null")
    rows = rows.withColumn("eyes", geometry.estimated_eyes(F.col("d.face"), F.lit(640), F.lit(480)))
    return rows.select(*LINE, F.col("d.face.x").alias("face_x"), F.col("d.face.y").alias("face_y"), F.col("d.face.width").alias("face_w"), F.col("eyes.left.y").alias("eye_y"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN w / h::DOUBLE > 2 THEN 160 ELSE trunc(80 * (w / h::DOUBLE)) END::INT AS thumb_w, CASE WHEN w / h::DOUBLE > 2 THEN trunc(160 / (w / h::DOUBLE)) ELSE 80 END::INT AS thumb_h, greatest(20, round_even(w * 1.5::DOUBLE, 0))::INT AS frame_h,
 CASE WHEN l_discount > 0 AND l_discount < 1 THEN trunc(l_discount * w) ELSE trunc(l_discount) END::INT AS scaled FROM (SELECT *, 100 + l_partkey % 900 AS w, 100 + l_orderkey % 300 AS h FROM lineitem)""")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*LINE, "l_discount", "cast(100 + l_partkey % 900 AS int) AS w", "cast(100 + l_orderkey % 300 AS int) AS h")
    thumb = geometry.thumbnail(F.col("w"), F.col("h"))
    return rows.select(*LINE, thumb["width"].alias("thumb_w"), thumb["height"].alias("thumb_h"), geometry.locked_frame(F.col("w"), None, 200, 300).alias("frame_h"), geometry.scaled(F.col("l_discount"), F.col("w")).alias("scaled"))


@query("""WITH f AS (SELECT l_orderkey, list({'w': (l_quantity * 4)::INT, 'h': (l_quantity * 5)::INT, 'c': l_discount} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_max(list_transform(list_filter(l, lambda x: x.w >= 50 AND x.h >= 50), lambda x: x.w * x.h)) AS largest, round(list_max(list_transform(l, lambda x: x.w * x.h * greatest(x.c, 0.1))), 6) AS surest FROM f""")
def picked_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("l_quantity") * 4).cast("int").alias("width"), (F.col("l_quantity") * 5).cast("int").alias("height"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(face.alias("face"), F.col("l_discount").alias("confidence"))).alias("l"))
    big, sure = geometry.largest_face(F.transform("l", lambda x: x["face"])), geometry.surest_face(F.col("l"))
    weight = sure["face"]["width"] * sure["face"]["height"] * F.greatest(sure["confidence"], F.lit(0.1))
    return rows.select("l_orderkey", (big["width"] * big["height"]).alias("largest"), F.round(weight, 6).alias("surest"))


@query(oracles.EYES)
def merged_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    eye = F.struct((F.col("l_partkey") % 200).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), (F.col("l_quantity") + 5).cast("int").alias("width"), (F.col("l_quantity") + 8).cast("int").alias("height"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", eye.alias("eye")))).alias("l"))
    return rows.select("l_orderkey", geometry.merged_eyes(F.transform("l", lambda x: x["eye"])).alias("eyes")).select("l_orderkey", F.explode("eyes").alias("e")).select("l_orderkey", "e.*")
