"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from .secrets import PATTERNS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def _near(percent: int, columns: str) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
         GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id{columns}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


OP2 = _near(80, ",\n  d.doc_id <= coalesce(c.low, d.doc_id) AS kept")
OP12 = _near(85, "")

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000
                THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS origin FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM o
"""


def _spans(kind: str, rank: int) -> str:
    pattern, group, least = PATTERNS[kind]
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, v AS value, s AS a, s + length(m) AS b FROM (
  SELECT doc_id, source, ms[i] AS m, vs[i] AS v,
    list_sum(list_transform(gs[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs,
      regexp_split_to_array(t, '{p}') AS gs FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents))))
WHERE length(v) >= {least}"""


OP8 = f"""
WITH base AS ({" UNION ALL ".join(_spans(k, i) for i, k in enumerate(PATTERNS))}),
own AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT doc_id) AS repos FROM base GROUP BY value),
judged AS (SELECT b.*, CASE WHEN owners >= 3 OR repos >= 10 THEN 'example'
    WHEN regexp_matches(b.value, '[0-9]') AND regexp_matches(b.value, '[A-Za-z]')
      AND len(list_distinct(string_split(b.value, ''))) >= 8 THEN 'live' ELSE 'weak' END AS verdict
  FROM base b JOIN own o ON o.value = b.value),
every AS (SELECT doc_id, a, rank, kind, b FROM judged
  UNION SELECT doc_id, b - length(value), 3, 'live', b FROM judged WHERE verdict = 'live'),
s AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM every GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (verdict = 'live') AS n_live,
    count(*) FILTER (verdict = 'example') AS n_example, count(*) FILTER (verdict = 'weak') AS n_weak,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS base FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(n_weak, 0)::BIGINT AS n_weak
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[k:k + 12], ' ') AS x
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS k FROM i)),
place AS (SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS x
       FROM (SELECT d.doc_id, d.w, z.l, unnest(range(1, len(d.w) - z.l + 2)) AS k FROM d, (SELECT DISTINCT l FROM win) z)),
occ AS (SELECT doc_id, item_id, k, place.l AS l FROM place JOIN win ON win.x = place.x AND win.l = place.l),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

OP13 = r"""
WITH RECURSIVE steps AS (SELECT b, b AS v, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
t AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1])), 4294967295) AS h FROM documents, t),
g AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM h),
a AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
word AS (SELECT doc_id, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS x
  FROM (SELECT doc_id, w, a, p, unnest(range(n)) AS i FROM p)),
-- a run of lag q has at least six matches in a row: only places of six equal words
gram AS (SELECT doc_id, i, x, array_agg(x) OVER (PARTITION BY doc_id ORDER BY i ROWS 5 PRECEDING) AS g FROM word),
cell AS (SELECT b.doc_id, b.i - a.i AS q, b.i FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
  WHERE len(a.g) = 6),
stretch AS (SELECT doc_id, q, min(i) - 5 - q AS s, max(i) AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM cell) GROUP BY doc_id, q, island),
run AS (SELECT doc_id, s, e - s + 1 AS l, min(q) AS q FROM stretch WHERE e - s + 1 >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'l': l, 'q': q}, {'a': -l, 'b': s, 'c': q}) AS top,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS "start", top.l::BIGINT AS length,
  top.q::BIGINT AS period, (1000 * top.l // top.q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
