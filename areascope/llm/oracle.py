"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, NOTICES

_W = r"[^\x20\x09-\x0D]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(phrase: str) -> str:
    return "".join("\\" + c if c in "().[]*+?^$|" else c for c in phrase).replace("'", "''")


_BOILER = r"\b(?:" + "|".join(_quoted(p) for p in BOILERPLATE) + r")\b"
_NOTICE = "^(?:" + "|".join(_quoted(p) for p in NOTICES) + ")"
_BARE = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_W}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM rep WHERE k > 1)
        GROUP BY doc_id),
ln AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_W}')) AS n,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
v AS (SELECT doc_id, n, again, again
         OR len(regexp_extract_all(line, '[|»›•·]')) > 0.2::DOUBLE * n
         OR (n <= 40 AND (regexp_matches(bare, '{_NOTICE}') OR (regexp_matches(bare, '{_BOILER}')
             AND length(array_to_string(regexp_extract_all(bare, '{_BOILER}'), '')) >= 0.25::DOUBLE * length(bare))))
         OR len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.2::DOUBLE * n
         OR len(regexp_extract_all(line, '[!?]{{2,}}')) > greatest(1, 0.2::DOUBLE * n)
         OR (n > 30 AND NOT regexp_matches(line, '[.!?…,:;。！？、]'))
         OR (n < 4 AND NOT regexp_matches(line, '[.!?…:;。！？][)"''»”’\\]]*[\\x20\\x09-\\x0D]*$')) AS bad
      FROM (SELECT *, {_LOW.format(_BARE.format("line"))} AS bare FROM ln) WHERE n > 0),
f AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup, count(*) FILTER (bad) AS n_bad,
        coalesce(sum(n) FILTER (bad), 0) AS lost FROM v GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(f.n_dup, 0) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.n_bad, 0) AS n_bad_lines,
        coalesce(f.lost, 0) AS n_lost_words FROM w LEFT JOIN f USING (doc_id) LEFT JOIN cov USING (doc_id)),
k AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_lost_words <= 0.5::DOUBLE * n_words AS kept, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(n_lost_words AS BIGINT) AS n_lost_words
FROM k
"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TOKEN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TOKEN}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (
    SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

URLS = f"""
WITH u AS (SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT u.page_id, host, path, h || p AS rule, v,
        row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLE = {
    "op4_jaccard_join": JACCARD,
    "op5_quality_rules": QUALITY,
    "op6_decontaminate": DECONTAMINATE,
    "op9_url_rules": URLS,
}
