"""DuckDB SQL for the operators whose result SQL can express."""

from __future__ import annotations

from bindery.llm import equal_average as ea, four_russians as fr
from bindery.llm.rows import UPPER
from bindery.llm.url_filter import HREF, LINK_TAG, REFRESH_TAG, REFRESH_TO, RULES, URL

LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)})"


BENCHMARK = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER, r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words(LOWER, r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
  FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM d, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)),
hits AS (SELECT DISTINCT doc_id, s, n, item FROM doc_windows JOIN item_windows USING (win, n)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, s, n FROM hits), LATERAL (SELECT unnest(range(s, s + n)) AS p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')", r'[^\x20\x09-\x0D]+')} AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS s)),
least_doc AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, p FROM windows JOIN least_doc USING (win), LATERAL (SELECT unnest(range(s, s + 50)) AS p)
  WHERE low < doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER, r'[^\x20\x09-\x0D]+')} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(len(w), 5) - 1], ' ') AS sh
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 5) + 2)) AS s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY x, y, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT doc_id, y FROM reach JOIN links ON x = r)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def spelling(url: str) -> str:
    rest = f"regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*(.*)$', 1), '(?s)#.*$', '')"
    tracking = r"(?i)([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*(?:&|$))+"
    rest = f"regexp_replace(regexp_replace({rest}, '{tracking}', '\\1', 'g'), '[?&]$', '')"
    rest = f"regexp_replace({rest}, '^([^?]*)/(\\?|$)', '\\1\\2')"
    return f"regexp_replace({host(url)}, '^www\\.|:(?:80|443)$', '', 'g') || {rest}"


def host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, {quoted(URL)}, 1), ''), '{UPPER}', '{UPPER.lower()}')"


RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
LINKS = " || ".join(
    f"list_transform(regexp_extract_all(html, {quoted(tag)}), lambda t: regexp_extract(t, {quoted(target)}, 1))"
    for tag, target in ((LINK_TAG, HREF), (REFRESH_TAG, REFRESH_TO))
)
SITE = f"regexp_extract(base, '(?s)^(.*?://)', 1) || regexp_extract(base, {quoted(URL)}, 1)"
BASE_PATH = f"regexp_extract(base, {quoted(URL)}, 2)"
LINK_PATH, LINK_TAIL = (f"regexp_extract(link, '{p}', 1)" for p in ("(?s)^([^?#]*)", "(?s)^[^?#]*(.*)$"))
FOLDER = f"CASE WHEN regexp_extract({BASE_PATH}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({BASE_PATH}, '(?s)^(.*/)', 1) END"


def without_dots(path: str) -> str:
    parts = f"string_split(substr({path}, 2), '/')"
    parts = f"({parts} || CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END)"
    step = "CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] WHEN x[1] = '.' THEN a ELSE a || x END"
    return f"'/' || array_to_string(list_reduce(list_transform({parts}, lambda s: [s]), lambda a, x: {step}, CAST([] AS VARCHAR[])), '/')"


URLS = f"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES {RULE_ROWS}),
links AS (
  SELECT DISTINCT url AS base, unnest({LINKS}) AS link FROM pages),
targets AS (
  SELECT base, CASE WHEN link = '' OR starts_with(link, '#') THEN NULL
    WHEN regexp_matches(link, '(?is)^[a-z][a-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(base, '^(.*?:)//', 1) || link
    WHEN regexp_matches(link, '(?is)^[a-z][a-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '?') THEN {SITE} || {BASE_PATH} || link
    WHEN starts_with(link, '/') THEN {SITE} || {without_dots(LINK_PATH)} || {LINK_TAIL}
    ELSE {SITE} || {without_dots(FOLDER + " || " + LINK_PATH)} || {LINK_TAIL} END AS url FROM links),
urls AS (
  SELECT url, {host('url')} AS host, coalesce(regexp_extract(url, {quoted(URL)}, 2), '') AS path, {spelling('url')} AS node
  FROM (SELECT DISTINCT url FROM pages UNION SELECT DISTINCT url FROM targets WHERE url IS NOT NULL)),
ruled AS (
  SELECT u.*, best.rule, best.verdict AS own FROM urls u LEFT JOIN LATERAL (
    SELECT rh || rp AS rule, verdict FROM rules
    WHERE (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
    ORDER BY length(rh || rp) DESC, verdict LIMIT 1) best ON TRUE),
edges AS (
  SELECT a.node AS x, b.node AS y FROM targets t JOIN urls a ON a.url = t.base JOIN urls b ON b.url = t.url
  WHERE a.host <> '' AND b.host <> ''),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT DISTINCT node, node AS r FROM urls WHERE host <> '' UNION SELECT node, y FROM reach JOIN both_ways ON x = r),
alias AS (
  SELECT reach.node, min(own) AS verdict FROM reach JOIN ruled ON ruled.node = reach.r
  WHERE own IS NOT NULL AND ruled.host <> '' GROUP BY reach.node)
SELECT p.page_id, r.host, r.path, r.rule, coalesce(r.own, a.verdict, 'allow') AS verdict,
  r.own IS NULL AND a.verdict IS NOT NULL AS by_alias
FROM pages p JOIN ruled r ON r.url IS NOT DISTINCT FROM p.url LEFT JOIN alias a ON a.node = r.node AND r.host <> ''
"""

def integers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


ALL_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def clustering() -> str:
    """Every round as two steps: who is nearest, and where the centroids go."""

    def nearest(i: int) -> str:
        off = "(v.q[i] - c.q[i])"
        apart = f"list_sum(list_transform(range(1, {ea.DIMS + 1}), lambda i: {off} * {off}))"
        return f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, CAST(min(distance) AS BIGINT) AS distance
  FROM (SELECT v.r, c.cluster, {apart} AS distance FROM v, c{i} c) GROUP BY r)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS q FROM (
      SELECT cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT cluster, unnest(q) AS x, unnest(range({ea.DIMS})) AS p FROM a{i} JOIN v USING (r)) GROUP BY cluster, p)
    GROUP BY cluster) m USING (cluster))"""

    rounds = ",\n".join(f"{nearest(i)},\n{moved(i)}" for i in range(ea.ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {integers(ea.SCALE)} AS q FROM embeddings
  WHERE len(embedding) = {ea.DIMS} AND {ALL_FINITE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM (
    SELECT sha256('{ea.SALT}' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {ea.CLUSTERS})),
{rounds},
{nearest(ea.ROUNDS)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ea.ROUNDS} JOIN v USING (r) JOIN c{ea.ROUNDS} c USING (cluster)
"""


HARD_NEGATIVES = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    {integers(fr.SCALE)} AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {ALL_FINITE}),
scored AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r AS other, c.vec_id, a.label = c.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(c.q)) + 1), lambda i: a.q[i] * c.q[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.r <> c.r),
positives AS (
  SELECT anchor, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= {fr.POSITIVES}),
negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor, positive ORDER BY s.score DESC, s.vec_id, s.other) AS rank
  FROM positives p JOIN scored s USING (anchor)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= {fr.NEGATIVES}
"""

# Bytes as pairs of hexadecimal digits; a window is 200 of them.
BYTES = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, s, md5(h[2 * s + 1:2 * s + 200]) AS win FROM d, LATERAL (SELECT unnest(range(len(h) // 2 - 99)) AS s)),
first_place AS (SELECT win, min((doc_id, s)) AS place FROM windows GROUP BY win),
starts AS (SELECT doc_id, s FROM windows JOIN first_place USING (win) WHERE (doc_id, s) > place),
runs AS (
  SELECT doc_id, s, s > 100 + coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -101) AS opens FROM starts),
spans AS (
  SELECT doc_id, min(s) AS low, max(s) + 100 AS high FROM (
    SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM runs) GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, high AS low, coalesce(lead(low) OVER (PARTITION BY doc_id ORDER BY low), 1000000000000) AS high FROM spans
  UNION ALL SELECT doc_id, 0, coalesce(min(low), 1000000000000) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, coalesce(string_agg(h[2 * low + 1:2 * high], '' ORDER BY low), '') AS k FROM d JOIN gaps USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - len(k)) // 2 AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

ORACLES = {
    "op2_url_filter": URLS,
    "op4_benchmark_decontamination": BENCHMARK,
    "op7_substring_dedup": SUBSTRINGS,
    "op10_ngram_jaccard_join": JACCARD,
    "op11_centroid_clustering": clustering(),
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_suffix_array_dedup": BYTES,
}
