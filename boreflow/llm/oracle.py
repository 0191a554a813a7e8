"""DuckDB SQL for the operators that SQL can express, written from their definitions.

The others are tested against brute force, round trips or held-out accuracy (tests/llm).
"""

from __future__ import annotations

from boreflow.llm import mixing, urls
from boreflow.llm.text import UPPER

ORACLE: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"
_LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _fold(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"


ORACLE["op2_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS n_tokens,
    coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS key
  FROM documents),
src AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n_docs FROM d GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(tokens) AS t, count(*) AS k, list(tokens) AS each FROM src),
p AS (SELECT t, k, [x / t FOR x IN each] AS p, {mixing.ENTROPY_SHARE} * ln(k) AS target FROM tot),
h(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1,
    CASE WHEN ent >= target THEN mid ELSE lo END, CASE WHEN ent >= target THEN hi ELSE mid END
  FROM (SELECT h.i, h.lo, h.hi, (lo + hi) / 2 AS mid, p.target,
          ln(list_sum([pow(x, (lo + hi) / 2) FOR x IN p.p]))
          - (lo + hi) / 2 * list_sum([pow(x, (lo + hi) / 2) * ln(x) FOR x IN p.p])
            / list_sum([pow(x, (lo + hi) / 2) FOR x IN p.p]) AS ent
        FROM h, p) WHERE i < 45),
r(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1,
    CASE WHEN rep <= {mixing.MAX_PASSES} THEN lo ELSE mid END, CASE WHEN rep <= {mixing.MAX_PASSES} THEN mid ELSE hi END
  FROM (SELECT r.i, r.lo, r.hi, (lo + hi) / 2 AS mid,
          list_max([pow(x, (lo + hi) / 2 - 1) FOR x IN p.p])
            / list_sum([pow(x, (lo + hi) / 2) FOR x IN p.p]) AS rep
        FROM r, p) WHERE i < 45),
r0 AS (SELECT list_max([pow(x, -1) FOR x IN p]) / len(p) AS rep FROM p),
a AS (SELECT round(greatest((SELECT lo FROM h WHERE i = 45),
                            (SELECT CASE WHEN r0.rep <= {mixing.MAX_PASSES} THEN 0 ELSE (SELECT hi FROM r WHERE i = 45) END FROM r0)), {mixing.DIGITS}) AS a),
w AS (SELECT source, tokens, n_docs, pow(tokens / t, a) / (SELECT sum(pow(tokens / t, a)) FROM src, tot, a) AS weight, t, a
      FROM src, tot, a),
plan AS (SELECT *, CAST(least(round(weight * t), floor(tokens * {mixing.MAX_PASSES})) AS BIGINT) AS quota, CAST(ceil(sqrt(n_docs)) AS BIGINT) AS n_blocks FROM w),
cut AS (SELECT *, CAST(floor(quota / tokens) AS BIGINT) AS whole, CAST(quota - floor(quota / tokens) * tokens AS BIGINT) AS rest FROM plan),
passes AS (
  SELECT d.doc_id, d.source, unnest(range(whole + 1)) AS pass, d.n_tokens, d.key, weight, a, whole, rest, n_blocks
  FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source),
keyed AS (SELECT *, md5('{mixing.SEED}:' || pass || ':' || key) AS order_key FROM passes),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY CAST('0x' || substr(order_key, 1, 8) AS BIGINT) % n_blocks, order_key, doc_id
                                      ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, n_tokens, order_key, round(weight, 9) AS weight, a AS exponent
FROM run WHERE pass < whole OR (rest > 0 AND upto <= rest)"""

ORACLE["op4_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, i + k AS pos FROM (
  SELECT win.doc_id, win.i, unnest(range(13)) AS k FROM win JOIN first USING (s) WHERE first.f < win.doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
marked AS (SELECT word.doc_id, word.x, word.pos, hit.pos IS NOT NULL AS gone
           FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.pos = hit.pos),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_passages,
                string_agg(x, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM edge GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_passages, 0) AS n_passages
FROM d LEFT JOIN sums USING (doc_id)"""


def _shingles(table: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, regexp_extract_all({_fold('text')}, '{_LETTER_WORD}') AS w FROM {table})"""


ORACLE["op5_decontamination"] = f"""
WITH item AS ({_shingles('benchmark', 'item_id')}),
doc AS ({_shingles('documents', 'doc_id')}),
size AS (SELECT item_id, count(*) AS n_shingles FROM item GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM found JOIN size USING (item_id) WHERE n_found / n_shingles >= 0.8"""

ORACLE["op6_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({_fold('text')}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


def _terms(terms: tuple[str, ...], distinct: bool) -> str:
    count = [f"len(regexp_extract_all(wide, '(^|[^a-z]){t}([^a-z]|$)'))" for t in terms]
    return " + ".join(f"least({c}, 1)" if distinct else c for c in count)


_FITS = [(h + p, a, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for a, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]

ORACLE["op8_url_filter"] = rf"""
WITH u AS (SELECT page_id, {_fold('url')} AS low, url, contains(coalesce(url, ''), '://') AS has,
                  substr(url, strpos(url, '://') + 3) AS rest FROM pages),
hp AS (SELECT page_id, regexp_replace(low, '([^a-z])', '\1\1', 'g') AS wide,
              CASE WHEN has THEN {_fold("regexp_extract(rest, '^([^/?#]*)', 1)")} ELSE '' END AS host,
              CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
hit AS (SELECT *, {_terms(urls.STRICT, False)} AS n_strict, {_terms(urls.SOFT, False)} AS n_soft, {_terms(urls.SOFT, True)} AS n_soft_distinct FROM hp),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r}'" for r, _, f in _FITS)} END AS rule,
                 CASE {' '.join(f"WHEN {f} THEN '{a}'" for _, a, f in _FITS)} END AS act FROM hit)
SELECT page_id, host, path, rule,
       coalesce(act, CASE WHEN n_strict >= 1 OR n_soft_distinct >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft, n_soft_distinct FROM ruled"""

# CRC-32 of a decimal id, byte by byte and bit by bit.
_CRC = """crc(doc_id, s, i, c) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce(list_prepend(xor(c, CAST(ascii(substr(s, i, 1)) AS BIGINT)), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)
  FROM crc WHERE i <= length(s))"""

ORACLE["op11_periodic_runs"] = rf"""
WITH RECURSIVE {_CRC},
h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = length(s) + 1),
src AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents JOIN h USING (doc_id)),
cut AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, CASE WHEN len(w) > 0 THEN g % len(w) ELSE 0 END AS a, g FROM src),
d AS (SELECT doc_id, n, CASE WHEN tail THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END FOR i IN range(n)] ELSE w END AS w FROM cut),
pos AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
eq AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 4),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq),
rep AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM rep r WHERE NOT EXISTS (
  SELECT 1 FROM rep o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS k FROM run) WHERE k = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE["op12_minhash_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_fold('text')}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON x = doc_id"""

ORACLE["op13_filter_audit"] = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
f AS (SELECT doc_id, part,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m FROM d),
lab AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, m, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, m),
l(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e
      WHERE a.b + b.b + c.b + d.b + e.b = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & CAST(before AS INTEGER) > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x"""
