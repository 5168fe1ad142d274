"""DuckDB SQL for the longer queries, put together from parts."""

from __future__ import annotations

from ..functions import geometry as g
from ..functions.filenames import IMAGE, LAYOUTS
from ..functions.text import AFRICAN, EUROPEAN, IBERIAN, ICELANDIC, PARTICLES, canonical
from ..operators.images import MOST_BOXES, OVERLAP
from ..schemas import MARGIN, PASSES, SURE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def detected(files: str) -> str:
    """What the layouts make of files.name, the first that fits."""
    fits = [quoted(f"(?i){regex}{IMAGE}") for regex, *_ in LAYOUTS]
    which = "CASE " + " ".join(f"WHEN regexp_matches(name, {r}) THEN {k}" for k, r in enumerate(fits, 1)) + " END"
    part = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN " + (f"regexp_extract(name, {r}, {at[i]})" if at[i] else "''") for k, (r, (_, *at)) in enumerate(zip(fits, LAYOUTS, strict=True), 1)) + " END"
    return f""", hit AS (SELECT *, {which} AS k FROM {files}), parts AS (SELECT *, {part(0)} AS external_id, {part(1)} AS family_name, {part(2)} AS sur_name FROM hit)
SELECT p_partkey, name, external_id, trim(family_name || ' ' || sur_name, ' ') AS full_name, family_name, sur_name, 'layout ' || k AS pattern_used FROM parts"""


def written_out(column: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        column = f"replace({column}, {quoted(k)}, {quoted(v)})"
        if len(k.upper()) == 1 and k.upper() != k and k not in "ıì" and k.upper() not in table:
            column = f"replace({column}, {quoted(k.upper())}, {quoted(v.capitalize())})"
    return column


def vowels(column: str) -> str:
    for v in "aeiou":
        column = f"regexp_replace({column}, '{v}+', '{v}', 'g')"
    return column


#: White space of all scripts, inside a character class.
WHITE = r"\s\x0B\x{85}\p{Z}"

NORMALIZED = f"""WITH a AS (SELECT doc_id, {written_out("translate(coalesce(text, ''), '-_', '  ')", EUROPEAN | IBERIAN | AFRICAN)} AS t FROM documents),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(t)), '^[{WHITE}]+|[{WHITE}]+$', '', 'g'), '[^\\p{{L}}\\p{{Nd}}{WHITE}]|[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS t FROM a)
SELECT doc_id, {vowels(f"regexp_replace(t, '[{WHITE}]+', ' ', 'g')")} AS normalized FROM b"""

CORE_TOKENS = f"""WITH spelling(v, k) AS (VALUES {", ".join(f"({quoted(v)}, {quoted(k)})" for v, k in canonical().items())}),
 m AS (SELECT map(list(v), list(k)) AS m FROM spelling),
 a AS (SELECT doc_id, regexp_replace(lower(strip_accents({written_out("coalesce(text, '')", EUROPEAN | ICELANDIC | AFRICAN)})), '[^a-z0-9]+', ' ', 'g') AS t FROM documents),
 w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '' AND NOT list_contains([{", ".join(map(quoted, PARTICLES))}], x) AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM a)
SELECT doc_id, coalesce(array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), ' '), '') AS tokens FROM w, m"""

#: Each two part names that share a word; part names are two ASCII words, without vowels twice, so they are their own normal form
#: but for vowels.
PAIRS = """WITH names AS (SELECT DISTINCT p_name AS n, string_split(p_name, ' ') AS w FROM part),
 pairs AS (SELECT x.n AS a, y.n AS b, x.w AS wa, y.w AS wb FROM names x JOIN names y ON x.n < y.n AND len(list_intersect(x.w, y.w)) > 0)"""


def alike(a: str, b: str) -> str:
    return f"(CASE WHEN lower({a}) = lower({b}) THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def best(few: str, many: str) -> str:
    return f"list_sum(list_transform({few}, lambda x: list_max(list_transform({many}, lambda y: {alike('x', 'y')}))))"


def inside(few: str, many: str) -> str:
    pair = "length(x) >= 4 AND length(y) >= 4 AND x <> y AND ((contains(x, y) AND length(y) * 2 >= length(x)) OR (contains(y, x) AND length(x) * 2 >= length(y)))"
    return f"len(list_filter({few}, lambda x: len(list_filter({many}, lambda y: {pair})) > 0)) > 0"


NORMAL_PAIRS = PAIRS + f""", normal AS (SELECT a, b, {vowels("a")} AS na, {vowels("b")} AS nb FROM pairs),
 split AS (SELECT *, string_split(na, ' ') AS wa, string_split(nb, ' ') AS wb, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM normal)"""

COMPARED = NORMAL_PAIRS + f""", c AS (SELECT *, len(list_intersect(wa, wb)) AS joint, len(wa) + len(wb) - len(list_intersect(wa, wb)) AS every FROM split)
SELECT a, b, levenshtein(a, b)::INT AS distance, round({alike("a", "b")}, 9) AS similarity, round(len(list_intersect(ta, tb))::DOUBLE / (len(ta) + len(tb) - len(list_intersect(ta, tb))), 9) AS overlap,
 round(CASE WHEN na = nb THEN 1.0 WHEN list_sort(wa) = list_sort(wb) THEN 1.0 WHEN joint = least(len(wa), len(wb)) AND joint >= 2 THEN 0.93 WHEN joint::DOUBLE / every >= 0.8 THEN joint::DOUBLE / every
  WHEN contains(na, nb) OR contains(nb, na) THEN 0.95 WHEN {inside("wa", "wb")} THEN 0.90 ELSE greatest({alike("na", "nb")}, joint::DOUBLE / every) END::DOUBLE, 9) AS compared,
 round({best("wa", "wb")} / greatest(len(wa), len(wb)), 9) AS lenient FROM c"""

#: Two words each and one in common: the other two decide. Tokens keep their vowels, normal forms don't.
SCORED = NORMAL_PAIRS + f""", c AS (SELECT *, list_filter(ta, lambda x: NOT list_contains(tb, x))[1] AS missing, list_filter(tb, lambda x: NOT list_contains(ta, x))[1] AS extra, greatest(length(na), length(nb)) AS longest,
  len(list_filter(range(1, greatest(length(na), length(nb)) + 1), lambda i: substr(na, i, 1) <> substr(nb, i, 1))) AS differ FROM split),
 near AS (SELECT *, abs(length(na) - length(nb)) <= 2 AND differ <= CASE WHEN longest <= 10 THEN 1 ELSE 2 END AS near,
  0.45::DOUBLE * 0.5 + 0.20::DOUBLE * (1::DOUBLE / 3) + 0.20::DOUBLE * ({best("ta", "tb")} / 2) + 0.15::DOUBLE * {alike("na", "nb")} AS base,
  substr(missing, 1, 1) = substr(extra, 1, 1) AND ({alike("missing", "extra")} >= 0.5 OR substr(missing, 1, 2) = substr(extra, 1, 2)) AS boosted FROM c)
SELECT a, b, near, round(CASE WHEN na = nb THEN 1.0 WHEN near THEN 0.95 ELSE greatest(CASE WHEN boosted THEN greatest(base, 0.84) ELSE least(base, 0.79) END, CASE WHEN {inside("ta", "tb")} THEN 0.90 ELSE 0 END) END::DOUBLE, 9) AS score FROM near"""


def lines(box: str) -> str:
    return f"WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {box} FROM lineitem), boxes AS (SELECT *, kind <> 6 AS found, kind NOT IN (4, 6) AS has_face, kind IN (1, 2, 4, 7) AS has_left, kind IN (1, 3, 7) AS has_right FROM lines)"


def landmarks(box: str) -> str:
    out = lambda x, y: f"NOT ({x} BETWEEN fx AND fx + fw AND {y} BETWEEN fy AND fy + fh)"
    odd = f"fw / w::DOUBLE < {g.LEAST_RATIO} OR fw / w::DOUBLE > {g.MOST_RATIO} OR fh / h::DOUBLE < {g.LEAST_RATIO} OR fh / h::DOUBLE > {g.MOST_RATIO}"
    return lines(box) + f""" SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT found THEN NULL WHEN NOT has_face THEN 'face_detected_without_face_rect' WHEN fw <= 0 OR fh <= 0 THEN 'invalid_face_rect_dimensions'
 WHEN fx < 0 OR fy < 0 OR fx + fw > w OR fy + fh > h THEN 'face_rect_out_of_bounds' WHEN {odd} THEN 'unrealistic_face_ratio_w' || round((fw / w::DOUBLE)::DECIMAL(18, 12), 3)::VARCHAR || '_h' || round((fh / h::DOUBLE)::DECIMAL(18, 12), 3)::VARCHAR
 WHEN has_left AND {out("lx", "ly")} THEN 'left_eye_outside_face_rect' WHEN has_right AND {out("rx", "ry")} THEN 'right_eye_outside_face_rect' WHEN has_left AND has_right AND lx >= rx THEN 'eye_order_invalid' END AS error FROM boxes"""


def crops(box: str) -> str:
    """A frame of 200 by 300, moved by 4 % and -6 %, then cut to 150 by 200; both scales are 1."""
    return lines(box) + f""", eyes AS (SELECT *, has_left AND has_right AND has_face AS two, has_left OR has_right AS one, sqrt(((lx - rx)::DOUBLE) ** 2 + ((ly - ry)::DOUBLE) ** 2) AS apart FROM boxes),
 face AS (SELECT *, CASE WHEN two AND apart > 0 THEN (fw + apart * {g.WIDTH_PER_EYES}) / 2 ELSE fw END::DOUBLE AS ew, CASE WHEN two AND apart > 0 THEN (fh + apart * {g.HEIGHT_PER_EYES}) / 2 ELSE fh END::DOUBLE AS eh FROM eyes),
 base AS (SELECT *, greatest(1, ceil(ew / {g.FACE_WIDTH_SHARE}::DOUBLE)) AS bw, greatest(1, ceil(eh / {g.FACE_HEIGHT_SHARE}::DOUBLE)) AS bh, greatest(1, ceil(ew * {g.LEAST_VISIBLE}::DOUBLE)) AS lw, greatest(1, ceil(eh * {g.LEAST_VISIBLE}::DOUBLE)) AS lh FROM face),
 tall AS (SELECT *, CASE WHEN has_face THEN greatest(bh, ceil(bw / (200::DOUBLE / 300))) WHEN one THEN greatest(1, round_even(h * {g.ONE_EYE_HEIGHT}::DOUBLE, 0)) ELSE greatest(1, round_even(h * {g.NO_FACE_HEIGHT}::DOUBLE, 0)) END AS t FROM base),
 size AS (SELECT *, CASE WHEN has_face THEN greatest(lw, bw, round_even(t * (200::DOUBLE / 300), 0)) ELSE greatest(1, round_even(t * (200::DOUBLE / 300), 0)) END::INT AS cw, CASE WHEN has_face THEN greatest(lh, t) ELSE t END::INT AS ch FROM tall),
 center AS (SELECT *, least(cw, w) AS kw, least(ch, h) AS kh, CASE WHEN two THEN (lx + rx) // 2 WHEN one THEN CASE WHEN has_left THEN lx + trunc(cw * {g.ONE_EYE_SHIFT}::DOUBLE)::INT ELSE rx - trunc(cw * {g.ONE_EYE_SHIFT}::DOUBLE)::INT END WHEN has_face THEN fx + fw // 2 ELSE w // 2 END AS cx,
  CASE WHEN two THEN (ly + ry) // 2 WHEN one THEN CASE WHEN has_left THEN ly ELSE ry END WHEN has_face THEN fy + trunc(fh * {g.FACE_EYES}::DOUBLE)::INT ELSE trunc(h * {g.NO_FACE_EYES}::DOUBLE)::INT END AS cy FROM size),
 top AS (SELECT *, cy - round_even(kh * {g.EYE_LINE}::DOUBLE, 0)::INT AS by_eyes, round_even((fy + fh / 2.0::DOUBLE) - kh * {g.FACE_LINE}::DOUBLE, 0)::INT AS by_face FROM center),
 placed AS (SELECT *, greatest(0, least(cx - kw // 2, w - kw)) AS x0, greatest(0, least(CASE WHEN has_face THEN round_even(by_eyes * {g.EYE_SHARE}::DOUBLE + by_face * (1.0::DOUBLE - {g.EYE_SHARE}::DOUBLE), 0)::INT ELSE by_eyes END, h - kh)) AS y0 FROM top),
 moved AS (SELECT *, greatest(0, least(x0 + round_even(kw * (4.0::DOUBLE / 100.0::DOUBLE), 0)::INT, w - kw)) AS x, greatest(0, least(y0 + round_even(kh * (-6.0::DOUBLE / 100.0::DOUBLE), 0)::INT, h - kh)) AS y, kw / kh::DOUBLE AS aspect FROM placed),
 trimmed AS (SELECT *, CASE WHEN abs(aspect - 0.75) <= 0.01 OR aspect < 0.75 THEN kw ELSE least(greatest(1, round_even(kh * 0.75::DOUBLE, 0)::INT), kw) END AS tw, CASE WHEN abs(aspect - 0.75) > 0.01 AND aspect < 0.75 THEN least(greatest(1, round_even(kw / 0.75::DOUBLE, 0)::INT), kh) ELSE kh END AS th FROM moved)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x::INT AS x, y::INT AS y, kw::INT AS width, kh::INT AS height, (x + greatest(0, (kw - tw) // 2))::INT AS trim_x, tw::INT AS trim_width, th::INT AS trim_height FROM trimmed"""


#: A player and a photo for every part, as people_and_photos makes them. All are ASCII, and all tokens are words that name_tokens keeps
#: as they are but for their spelling.
NAMED = f"""WITH spelling(v, k) AS (VALUES {", ".join(f"({quoted(v)}, {quoted(k)})" for v, k in canonical().items())}),
 m AS (SELECT map(list(v), list(k)) AS m FROM spelling),
 part_names AS (SELECT p_partkey AS seq, p_name AS n, translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') || 'x' AS x, string_split(p_name, ' ') AS w FROM part),
 shown AS (SELECT seq, n || ' ' || x AS player, CASE seq % 6 WHEN 0 THEN n || ' ' || x WHEN 1 THEN x || ' ' || n WHEN 2 THEN w[1] || ' middle ' || w[2] || ' ' || x WHEN 3 THEN w[2] || ' ' || x WHEN 4 THEN n || ' ' || x || 's' ELSE n END AS photo FROM part_names),
 players AS (SELECT seq, {vowels("lower(player)")} AS norm, list_transform(list_filter(string_split(lower(player), ' '), lambda t: NOT list_contains([{", ".join(map(quoted, PARTICLES))}], t)), lambda t: coalesce(m[t], t)) AS tokens FROM shown, m),
 photos AS (SELECT seq, {vowels("lower(photo)")} AS norm, list_transform(list_filter(string_split(lower(photo), ' '), lambda t: NOT list_contains([{", ".join(map(quoted, PARTICLES))}], t)), lambda t: coalesce(m[t], t)) AS tokens FROM shown, m)"""


def token_pair(x: str, y: str) -> str:
    return f"length({x}) >= 4 AND length({y}) >= 4 AND {x} <> {y} AND ((contains({x}, {y}) AND length({y}) * 2 >= length({x})) OR (contains({y}, {x}) AND length({x}) * 2 >= length({y})))"


#: The score of each player with each photo that shares a token or is nearly the same: (player, photo, score). Others score 0.35 at most,
#: and every player has three that score more.
ALL_SCORES = NAMED + f""", met AS (
  SELECT p.seq AS player, c.seq AS photo, p.norm AS ln, c.norm AS rn, p.tokens AS lt, c.tokens AS rt, list_filter(p.tokens, lambda t, i: list_position(p.tokens, t) = i) AS ls, list_filter(c.tokens, lambda t, i: list_position(c.tokens, t) = i) AS rs,
    len(list_intersect(p.tokens, c.tokens)) AS n, greatest(length(p.norm), length(c.norm)) AS longest
  FROM players p JOIN photos c ON len(list_intersect(p.tokens, c.tokens)) > 0 OR (abs(length(p.norm) - length(c.norm)) <= 2 AND levenshtein(p.norm, c.norm) <= 2)),
 sized AS (SELECT *, least(len(ls), len(rs)) AS few, len(ls) + len(rs) - n AS every, CASE WHEN len(ls) <= len(rs) THEN ls ELSE rs END AS small, CASE WHEN len(ls) <= len(rs) THEN rs ELSE ls END AS large,
    abs(length(ln) - length(rn)) <= 2 AND len(list_filter(range(1, longest + 1), lambda i: substr(ln, i, 1) <> substr(rn, i, 1))) <= CASE WHEN longest <= 10 THEN 1 ELSE 2 END AS near FROM met),
 lacking AS (SELECT *, CASE WHEN few >= 2 AND n = few - 1 THEN list_filter(small, lambda t: NOT list_contains(large, t))[1] END AS lacks, list_filter(large, lambda t: NOT list_contains(small, t)) AS extra FROM sized),
 likest AS (SELECT *, list_max(list_transform(extra, lambda e, i: {{'s': {alike("lacks", "e")}, 'k': -i, 'e': e}})) AS best,
    CASE WHEN len(lt) <= len(rt) THEN {best("lt", "rt")} / len(lt) ELSE {best("rt", "lt")} / len(rt) END AS average FROM lacking WHERE n > 0 OR near),
 rules AS (SELECT *, lacks IS NOT NULL AND len(list_filter(extra, lambda e: substr(e, 1, 1) = substr(lacks, 1, 1))) > 0 AND substr(lacks, 1, 1) = substr(best.e, 1, 1)
      AND (best.s >= 0.5 OR (substr(lacks, 1, 2) = substr(best.e, 1, 2) AND least(length(lacks), length(best.e)) >= 2)) AS boosted,
    n = 1 AND few = 1 AND least(length(ln), length(rn)) <= 8 AND len(large) >= 3 AND length(list_intersect(lt, rt)[1]) >= 4 AS lone,
    n > 0 AND len(list_filter(lt, lambda x: len(list_filter(rt, lambda y: {token_pair("x", "y")})) > 0)) > 0 AS part,
    0.45::DOUBLE * (n::DOUBLE / few) + 0.20::DOUBLE * (n::DOUBLE / every) + 0.15::DOUBLE * {alike("ln", "rn")} + 0.20::DOUBLE * average AS plain FROM likest),
 floored AS (SELECT *, coalesce(boosted, false) AS b, greatest(plain, CASE WHEN n = few AND few >= 2 THEN 0.93 ELSE 0 END, CASE WHEN coalesce(lone, false) THEN 0.88 ELSE 0 END, CASE WHEN coalesce(boosted, false) THEN 0.84 ELSE 0 END)::DOUBLE AS f FROM rules),
 scores AS (SELECT player, photo, ln = rn AS same, (CASE WHEN ln = rn THEN 1.0 WHEN near THEN 0.95
    ELSE least(1.0, greatest(CASE WHEN n = 0 THEN least(f, 0.35) WHEN n = 1 AND few >= 2 AND NOT b THEN least(f, 0.79) ELSE f END, CASE WHEN part THEN 0.90 ELSE 0 END)) END)::DOUBLE AS score FROM floored)"""

RANKED = ALL_SCORES + """
SELECT player AS player_seq, photo AS cand_seq, k AS place, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY score DESC, photo)::INT AS k FROM scores) WHERE k <= 3"""

#: Names are all different, so that each player asks for themselves.
ASKED = ALL_SCORES + f""",
 ranked AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY score DESC, photo) AS k, lead(score, 1, 0::DOUBLE) OVER (PARTITION BY player ORDER BY score DESC, photo) AS second FROM scores),
 asked AS (SELECT * FROM ranked WHERE k = 1 AND score >= 0.8::DOUBLE AND (score - second >= {MARGIN}::DOUBLE OR score >= {SURE}::DOUBLE))"""

PROPOSED = ASKED + " SELECT player AS player_seq, photo AS cand_seq, round(score, 9) AS score FROM asked"

WON = ASKED + """ SELECT player AS player_seq, photo AS cand_seq, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY score DESC, player) AS turn FROM asked) WHERE turn = 1"""

#: The lists of the scorers' first pass: the first eight photos, as far as they reach 0.40 or are within 0.30 of the best, and of photos shown
#: by the same name the first. Every player has eight that share a token.
SHORTLISTS = ALL_SCORES + f""",
 placed AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY score DESC, photo)::INT AS place, max(score) OVER (PARTITION BY player) AS top FROM scores),
 listed AS (SELECT p.player, p.photo, p.place, p.score, lower(s.photo) AS name FROM placed p JOIN shown s ON s.seq = p.photo WHERE place <= {PASSES[0]["k"]} AND (score >= {PASSES[0]["least"]}::DOUBLE OR top - score <= {PASSES[0]["gap"]}::DOUBLE))
SELECT player AS player_seq, arg_min(photo, place) AS cand_seq, min(place) AS place, round(arg_min(score, place), 9) AS score FROM listed GROUP BY player, name"""


def all_rounds(most: int = 16) -> str:
    """Rounds of asking and winning over all pairs of what is left, one after another; the last ones find nothing more to take."""
    steps = [ALL_SCORES + """, pairs AS MATERIALIZED (SELECT player, photo, score FROM scores WHERE score > 0.73::DOUBLE),
 won0 AS MATERIALIZED (SELECT player, photo, score, 0 AS round FROM pairs WHERE false)"""]
    for r in range(1, most + 1):
        steps.append(f""", ranked{r} AS (SELECT *, row_number() OVER w AS k, lead(score, 1, 0::DOUBLE) OVER w AS second FROM pairs
   WHERE player NOT IN (SELECT player FROM won{r - 1}) AND photo NOT IN (SELECT photo FROM won{r - 1}) WINDOW w AS (PARTITION BY player ORDER BY score DESC, photo)),
 won{r} AS MATERIALIZED (SELECT * FROM won{r - 1} UNION ALL SELECT player, photo, score, {r} FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY score DESC, player) AS turn FROM ranked{r}
   WHERE k = 1 AND score >= 0.8::DOUBLE AND (score - second >= {MARGIN}::DOUBLE OR score >= {SURE}::DOUBLE)) WHERE turn = 1)""")
    return "".join(steps) + f" SELECT player AS player_seq, photo AS cand_seq, round(score, 9) AS score, round FROM won{most}"


#: Boxes are taken one after another into the list of kept ones.
SUPPRESSED = f"""WITH boxes AS (SELECT l_partkey AS picture, {{'id': l_orderkey * 8 + l_linenumber, 'x': (l_suppkey % 60)::DOUBLE, 'y': (l_orderkey % 50)::DOUBLE, 'w': (l_quantity + 20)::DOUBLE, 'h': (l_quantity + 30)::DOUBLE, 's': l_extendedprice::DOUBLE}} AS b FROM lineitem),
 ordered AS (SELECT picture, list([b] ORDER BY b.s DESC, b.id) AS l FROM boxes GROUP BY picture),
 kept AS (SELECT picture, list_reduce(l, lambda done, e: CASE WHEN len(list_filter(done, lambda k:
     greatest(least(k.x + k.w, e[1].x + e[1].w) - greatest(k.x, e[1].x), 0) * greatest(least(k.y + k.h, e[1].y + e[1].h) - greatest(k.y, e[1].y), 0)
     >= {OVERLAP}::DOUBLE * (k.w * k.h + e[1].w * e[1].h - greatest(least(k.x + k.w, e[1].x + e[1].w) - greatest(k.x, e[1].x), 0) * greatest(least(k.y + k.h, e[1].y + e[1].h) - greatest(k.y, e[1].y), 0)))) > 0 THEN done ELSE done || e END) AS l FROM ordered)
SELECT picture, unnest(l[1:{MOST_BOXES}]).id AS box_id FROM kept"""

#: Rounds: an open box that no better open one overlaps is kept, and what it overlaps goes. A box is kept if none of those that overlap
#: it was open when it left.
SUPPRESSED_IN_ROUNDS = f"""WITH RECURSIVE raw AS (SELECT l_linenumber <= 3 AS picture, l_orderkey * 8 + l_linenumber AS box_id, l_orderkey * 0.5::DOUBLE AS x, l_suppkey * 37 % 1009 + l_linenumber * 0.25::DOUBLE AS y, (l_quantity + 20)::DOUBLE AS w, (l_partkey % 90 + 4)::DOUBLE AS h, l_extendedprice AS s FROM lineitem),
 boxes AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY s DESC, box_id, x, y, w, h) AS k FROM raw),
 near AS (SELECT *, unnest(range((x // 70)::BIGINT - 1, (x // 70)::BIGINT + 2)) AS cell FROM boxes),
 pairs AS (SELECT a.k AS better, b.k AS worse, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS shared, a.w * a.h + b.w * b.h AS areas
   FROM near a JOIN boxes b ON a.picture = b.picture AND a.cell = (b.x // 70)::BIGINT WHERE a.k < b.k),
 links AS MATERIALIZED (SELECT better, worse FROM pairs WHERE shared >= {OVERLAP}::DOUBLE * (areas - shared)),
 rounds AS (SELECT k, 0 AS round FROM boxes UNION ALL
   (WITH held AS (SELECT DISTINCT worse FROM links JOIN rounds o ON o.k = better), best AS (SELECT k FROM rounds WHERE k NOT IN (SELECT worse FROM held))
    SELECT k, round + 1 FROM rounds WHERE k IN (SELECT worse FROM held) AND k NOT IN (SELECT worse FROM links JOIN best ON best.k = better))),
 ends AS (SELECT k, max(round) AS left_at FROM rounds GROUP BY 1),
 lost AS (SELECT worse FROM links JOIN ends b ON b.k = better JOIN ends w ON w.k = worse WHERE b.left_at >= w.left_at)
SELECT picture, box_id FROM boxes WHERE k NOT IN (SELECT worse FROM lost)"""

#: Each eye joins the first kept one that it overlaps, whose place at the end of the list their union takes.
EYES = """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, {'x': (l_partkey % 200)::INT, 'y': (l_suppkey % 40)::INT, 'width': (l_quantity + 5)::INT, 'height': (l_quantity + 8)::INT} AS e FROM lineitem),
 l AS (SELECT l_orderkey, list([e] ORDER BY l_linenumber, l_partkey, e) AS l FROM f WHERE e.width >= 20 AND e.height >= 20 GROUP BY 1),
 step AS (SELECT l_orderkey, list_reduce(l, lambda done, n: list_transform([list_position(list_transform(done, lambda d: d.x < n[1].x + n[1].width AND n[1].x < d.x + d.width AND d.y < n[1].y + n[1].height AND n[1].y < d.y + d.height), true)],
   lambda i: CASE WHEN coalesce(i, 0) = 0 THEN done || n ELSE list_filter(done, lambda d, k: k <> i) || [{'x': least(done[i].x, n[1].x), 'y': least(done[i].y, n[1].y),
     'width': greatest(done[i].x + done[i].width, n[1].x + n[1].width) - least(done[i].x, n[1].x), 'height': greatest(done[i].y + done[i].height, n[1].y + n[1].height) - least(done[i].y, n[1].y)}] END)[1]) AS l FROM l)
SELECT l_orderkey, unnest(l, recursive := true) FROM step"""
