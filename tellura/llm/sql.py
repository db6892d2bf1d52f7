"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _u(*parts: str) -> str:
    """uniform() of the given SQL strings."""
    return f"((('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


# sharding: regions, racks and shards in turn; each level keeps the child of the least draw
_LEVEL = """
{name} AS (SELECT doc_id, arg_min(n.path, -ln({u}) / w) AS path FROM {src} p JOIN nodes{n} n ON {on} GROUP BY doc_id)"""


def _descend(n: int) -> str:
    parts, src = [], "keys"
    for level in (1, 2, 3):
        on = f"n.n = {n} AND n.level = {level} AND n.parent = p.path"
        parts.append(_LEVEL.format(name=f"t{n}_{level}", u=_u("coalesce(p.doc_id::VARCHAR, '~')", "'0'", "n.path"), src=src, n="", on=on))
        src = f"t{n}_{level}"
    return ",".join(parts)


ORACLES["op1_sharding"] = f"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM crc WHERE k = 8),
leaf AS (
  SELECT n, s, CASE WHEN s < 40 THEN s // 10 ELSE 4 + s - 40 END AS r, CASE WHEN s < 40 THEN (s // 5) % 2 ELSE 0 END AS k
  FROM (VALUES (40), (41)) v(n), range(41) g(s) WHERE s < n),
named AS (SELECT n, s, 'r' || r AS p1, 'r' || r || '/k' || k AS p2, 'r' || r || '/k' || k || '/s' || s AS p3 FROM leaf),
nodes AS (
  SELECT n, 1 AS level, '' AS parent, p1 AS path, count(*)::DOUBLE AS w FROM named GROUP BY ALL
  UNION ALL SELECT n, 2, p1, p2, count(*)::DOUBLE FROM named GROUP BY ALL
  UNION ALL SELECT n, 3, p2, p3, count(*)::DOUBLE FROM named GROUP BY ALL),
keys AS (SELECT DISTINCT doc_id, '' AS path FROM documents),
{_descend(40)},{_descend(41)},
base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT)),
      lambda c, b: xor(c >> 8, l[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, tab),
binned AS (SELECT *, floor({_u("coalesce(doc_id::VARCHAR, '~')", "'0'", "'slot'")} * 1024) AS bin FROM base)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, split_part(a.path, '/s', 2)::INTEGER AS shard,
  (row_number() OVER (PARTITION BY a.path ORDER BY bin, doc_id, text_crc32, size) - 1)::BIGINT AS slot, split_part(b.path, '/s', 2)::INTEGER AS grown_shard
FROM binned JOIN t40_3 a USING (doc_id) JOIN t41_3 b USING (doc_id)
"""

_WS = "[\\x20\\x09-\\x0D]"
ORACLES["op3_quality_rules"] = f"""
WITH base AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce('=' || source, '~') AS host, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS raw FROM base),
win AS (
  SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
  FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rn, count(DISTINCT i + o) AS n FROM twice, range(5) r(o) GROUP BY rn),
texts AS (SELECT host, t, any_value(raw) AS raw, count(DISTINCT coalesce('=' || doc_id::VARCHAR, '~')) AS copies FROM words WHERE t <> '' GROUP BY host, t),
lines AS (
  SELECT host, t, copies, line, sum(n) AS n FROM (
    SELECT host, t, copies, array_to_string(p, ' ') AS line, len(p) AS n FROM (
      SELECT host, t, copies, list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'), lambda y: y <> '') AS p
      FROM (SELECT host, t, copies, unnest(raw) AS x FROM texts)) WHERE len(p) > 0)
  GROUP BY ALL),
held AS (SELECT host, sum(copies) AS n_docs FROM (SELECT DISTINCT host, t, copies FROM lines) GROUP BY host),
above AS (SELECT host, line FROM lines JOIN held USING (host) GROUP BY host, line, n_docs HAVING sum(copies) > 20 AND sum(copies) > 0.002 * n_docs),
gone AS (SELECT host, t, sum(n) AS n FROM lines JOIN above USING (host, line) GROUP BY ALL),
counted AS (
  SELECT doc_id, host, t, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(raw, lambda x: regexp_replace(x, '{_WS}+', '', 'g') <> '')) - len(list_distinct(list_filter(raw, lambda x: regexp_replace(x, '{_WS}+', '', 'g') <> ''))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN rep USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, coalesce(gone.n, 0)::BIGINT AS n_removed_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - coalesce(gone.n, 0)) >= 30 * n_words AS kept
FROM counted LEFT JOIN gone USING (host, t)
"""

ORACLES["op7_url_filters"] = """
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS fields
  FROM u),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '([.]html)?/*$', '')
    || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical_url FROM parts),
rules(rule, h, p, v) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (
  SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(v, len(rule)) AS v FROM canon JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (SELECT DISTINCT canonical_url AS c FROM canon WHERE regexp_matches(host, 'ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm') AND canonical_url IS NOT NULL)
SELECT page_id, host, path, rule, canonical_url, coalesce(v, CASE WHEN c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN best USING (page_id) LEFT JOIN listed ON canonical_url = c
"""

ORACLES["op10_source_mixing"] = f"""
WITH stats AS (SELECT coalesce('=' || source, '~') AS k, sum(coalesce(strlen(text), 0))::DOUBLE AS b FROM documents GROUP BY 1),
rates AS (
  SELECT k, CASE WHEN b > 0 THEN pow(b, 0.7) / sum(pow(b, 0.7)) OVER () * sum(b) OVER () / b ELSE 0 END AS rate FROM stats),
tables AS (
  SELECT k, rate, list_transform(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1))) AS p FROM rates WHERE rate > 0),
cdf AS (SELECT k, rate, list_transform(range(1, len(p) + 1), lambda i: list_sum(p[1:i])) AS c FROM tables),
counted AS (
  SELECT d.*, rate, len(list_filter(c, lambda x: x < {_u("coalesce(doc_id::VARCHAR, '~')", "'0'", "'count'")})) AS n FROM documents d JOIN cdf ON coalesce('=' || source, '~') = k)
SELECT doc_id, text, lang, source, n_chars, i::INTEGER AS copy, round(rate, 6) AS rate, substr(md5(concat_ws('/', coalesce(doc_id::VARCHAR, '~'), i::VARCHAR, '0', 'order')), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS i FROM counted WHERE n > 0)
"""

ORACLES["op2_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""

ORACLES["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

ORACLES["op4_substring_dedup"] = f"""
WITH w AS (
  SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rn, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rn, i + o AS j FROM rep, range(35) r(o)),
pos AS (SELECT rn, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w),
kept AS (SELECT rn, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (rn, j) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rn)
"""
