"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX_SOURCES = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
turned AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS turn FROM src),
weighed AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM turned),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed),
free AS (SELECT level FROM levels WHERE cap::DOUBLE / weight > level ORDER BY cap::DOUBLE / weight, turn LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN cap::DOUBLE / weight <= level THEN cap::DOUBLE ELSE (SELECT level FROM free) * weight END AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM goals),
runs AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) - sum(size) OVER (PARTITION BY d.source, h) AS before, sum(size) OVER (PARTITION BY d.source, h) AS words
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN whole < 2 AND (before::DOUBLE + words / 2.0::DOUBLE <= rest OR before + words <= rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
"""

#: All pairs of distinct n-gram sets that share an n-gram, without banding; components by following the links.
NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g
  FROM words),
sets AS (SELECT g, row_number() OVER () AS s, count(*) AS copies, min(doc_id) AS least FROM grams WHERE len(g) > 0 GROUP BY g),
each_gram AS (SELECT s, len(g) AS n, unnest(g) AS x FROM sets),
shared AS (SELECT a.s AS a, b.s AS b, a.n AS na, b.n AS nb, count(*) AS joint FROM each_gram a JOIN each_gram b ON a.x = b.x AND a.s <> b.s GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 5 * joint >= 4 * (na + nb - joint)),
reach(a, b) AS (SELECT s, s FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT r.a AS s, min(t.least) AS class_id FROM reach r JOIN sets t ON r.b = t.s GROUP BY r.a),
linked AS (SELECT l.a AS s, sum(t.copies) AS n FROM links l JOIN sets t ON l.b = t.s GROUP BY l.a)
SELECT d.doc_id, CASE WHEN len(d.g) = 0 THEN d.doc_id ELSE c.class_id END AS class_id, coalesce(t.copies - 1, 0)::BIGINT AS n_copies, (coalesce(t.copies - 1, 0) + coalesce(l.n, 0))::BIGINT AS n_links
FROM grams d LEFT JOIN sets t ON d.g = t.g LEFT JOIN classes c ON c.s = t.s LEFT JOIN linked l ON l.s = t.s
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM payloads)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM digests
"""

#: CRC-32 by its table, made from the polynomial; byte by byte.
SHARDS = """
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(0, 256) r(n)),
bytes AS (
  SELECT doc_id, source, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
docs AS (
  SELECT doc_id, source, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM bytes, crc_table),
hashed AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '20241', coalesce(doc_id::VARCHAR, ''), text_crc32, size)), 1, 15))::BIGINT AS h FROM docs),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM hashed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 16 // total)::INTEGER AS shard,
  (place - ((place * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

#: longest: a run of windows found one after another on one diagonal is one match.
DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS item, coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, item_id, w, least(len(w), 10) AS width, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS q FROM items WHERE len(w) > 0),
item_windows AS (SELECT item, item_id, width, q, array_to_string(w[q:q + width - 1], ' ') AS g FROM starts),
places AS (SELECT row, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM docs, (SELECT DISTINCT width FROM item_windows) WHERE len(w) >= width),
windows AS (SELECT row, width, p, array_to_string(w[p:p + width - 1], ' ') AS g FROM places),
hits AS (SELECT row, width, p, item, item_id, q FROM windows JOIN item_windows USING (width, g)),
covered AS (SELECT row, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT row, p, unnest(range(0, width)) AS o FROM hits) GROUP BY row),
named AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY row),
islands AS (SELECT row, item, width, p - q AS diagonal, p - row_number() OVER (PARTITION BY row, item, p - q ORDER BY p) AS island FROM hits),
runs AS (SELECT row, count(*) + any_value(width) - 1 AS n FROM islands GROUP BY row, item, diagonal, island)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
  c.row IS NOT NULL AS contaminated, coalesce((SELECT max(n) FROM runs r WHERE r.row = d.row), 0)::BIGINT AS longest
FROM docs d LEFT JOIN covered c ON c.row = d.row LEFT JOIN named n ON n.row = d.row
"""


def annulus_clusters(k: int = 8, rounds: int = 10) -> str:
    """Every round compares all vectors with all centroids, a row a component."""
    steps = ["""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
cells AS MATERIALIZED (SELECT row, unnest(range(1, 65)) AS j, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS j, unnest(x)::HUGEINT AS v FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM kept) WHERE c < %d)""" % k]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT row, c, sum((a.v - b.v) * (a.v - b.v)) AS d FROM cells a JOIN c{r} b USING (j) GROUP BY row, c),
a{r} AS MATERIALIZED (SELECT row, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM d{r} GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (SELECT c, j, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM cells JOIN a{r} USING (row) GROUP BY c, j),
c{r + 1} AS MATERIALIZED (SELECT c, j, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} LEFT JOIN m{r} USING (c, j))""")
    return ",".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN kept USING (row) JOIN (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c) h ON a.c = h.c
"""


#: The places in order of their length; the patterns each as a regular expression of its own.
URL_FILTERS = r"""
WITH tails AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1) AS rest FROM tails),
cut AS (SELECT page_id, host, regexp_extract(rest, '^[^?#]*') AS path, host || rest AS subject FROM parts),
places(text, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
patterns(text, expression, verdict) AS (
  VALUES ('^utm_source=', '.*E_utm_source=', 'block'), ('^utm_campaign=', '.*E_utm_campaign=', 'block'), ('^ref=', '.*E_ref=', 'block'), ('^sessionid=', '.*E_sessionid=', 'block'),
         ('^phpsessid=', '.*E_phpsessid=', 'block'), ('^replytocom=', '.*E_replytocom=', 'block'), ('^add-to-cart=', '.*E_add-to-cart=', 'block'), ('/cgi-bin/', '.*/cgi-bin/', 'block'),
         ('/wp-admin/', '.*/wp-admin/', 'block'), ('/wp-login.php', '.*/wp-login\.php', 'block'), ('/login^', '.*/loginE_', 'block'), ('/logout^', '.*/logoutE_', 'block'),
         ('/signup^', '.*/signupE_', 'block'), ('/cart^', '.*/cartE_', 'block'), ('/checkout^', '.*/checkoutE_', 'block'), ('||ads.*^', '([^/?#]*\.)?ads\..*E_', 'block'),
         ('||doubleclick.net^', '([^/?#]*\.)?doubleclick\.netE_', 'block'), ('@@||web.archive.org^', '([^/?#]*\.)?web\.archive\.orgE_', 'allow'), ('@@^page=1^', '.*E_page=1E_', 'allow')),
placed AS (
  SELECT page_id, max_by(p.text, length(p.text)) AS rule, max_by(p.verdict, length(p.text)) AS verdict FROM cut c
  JOIN places p ON (c.host = p.host OR ends_with(c.host, '.' || p.host)) AND starts_with(c.path, p.path) GROUP BY page_id),
met AS (
  SELECT page_id, max_by(p.text, (p.verdict = 'allow', length(p.text), p.text)) AS pattern, max_by(p.verdict, (p.verdict = 'allow', length(p.text), p.text)) AS verdict FROM cut c
  JOIN patterns p ON c.subject <> '' AND regexp_matches(c.subject, '^(?:' || replace(p.expression, 'E_', '(?:[^0-9A-Za-z_\-.%\x{80}-\x{10FFFF}]|$)') || ')', 's') GROUP BY page_id)
SELECT page_id, c.host, c.path, placed.rule, coalesce(placed.verdict, met.verdict, 'allow') AS verdict, CASE WHEN placed.rule IS NULL THEN met.pattern END AS pattern
FROM cut c LEFT JOIN placed USING (page_id) LEFT JOIN met USING (page_id)
"""

SQL = {
    "op1_mix_sources": MIX_SOURCES,
    "op2_ngram_jaccard_join": NGRAM_JACCARD,
    "op4_warc": WARC,
    "op5_shards": SHARDS,
    "op6_decontamination": DECONTAMINATION,
    "op11_annulus_clusters": annulus_clusters(),
    "op13_url_filters": URL_FILTERS,
}
