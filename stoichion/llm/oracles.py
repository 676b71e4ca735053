"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from stoichion.llm import secret_scan

OP4 = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS gram FROM win),
dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT k FROM wins),
dg AS (
  SELECT rid, k, p, list_slice(w, p, p + k - 1) AS gram
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT rid, dg.k, p, item_id FROM dg JOIN wins ON dg.k = wins.k AND dg.gram = wins.gram),
nhit AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(generate_series(p, p + k - 1)) AS q FROM hits) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(nhit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(nhit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN nhit USING (rid) LEFT JOIN ids USING (rid)
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l0 AS (SELECT rid, host, md5(t) AS tk, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT rid, host, tk, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
             lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm FROM l0),
lines AS (SELECT * FROM l WHERE nw > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
frequent AS (SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT tk) > 100),
lost AS (SELECT rid, sum(nw) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY rid),
g AS (SELECT rid, p, w[p:p + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS p FROM w WHERE len(w) >= 3)),
again AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY rid),
base AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(lost.n, 0) >= CAST(0.3 AS DOUBLE) * n_words AS kept
FROM base LEFT JOIN lost USING (rid)
"""



def _secret_sql() -> str:
    """Matches and the pieces between them give the positions; assign is matched with its own minimum dropped after."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, rule in enumerate(secret_scan.RULES):
        own = f"regexp_extract_all(t, {quoted(rule.pattern)}, {rule.least[0] if rule.least else 0})"
        parts.append(
            f"SELECT rid, {i} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, {quoted(rule.pattern)}, 0) AS m, "
            f"{own} AS g, string_split_regex(t, {quoted(rule.pattern)}) AS c, {rule.least[1] if rule.least else 0} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
hit AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found WHERE len(m) > 0),
pos AS (
  SELECT rid, k, kind, CAST(list_sum(list_transform(c[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
         length(m[i]) AS n
  FROM hit WHERE length(g[i]) >= least),
spans AS (SELECT rid, k, s, kind || ':' || s || ':' || (s + n) AS x FROM pos),
agg AS (
  SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
         string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(x, ',' ORDER BY s, k) AS x
  FROM spans GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM d LEFT JOIN agg USING (rid)
"""

OP12 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS tab),
f AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '-') AS g, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS b,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents, crc),
h AS (
  SELECT *, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
         CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || b) END AS seen
  FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM h),
nodes AS (
  SELECT 0 AS k, g, pos, m, leaf AS h FROM leaves
  UNION ALL
  SELECT k + 1, g, pos // 2, (max(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE m > 1 GROUP BY k, g, pos // 2),
subs AS (SELECT g, h AS subroot, k AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM nodes WHERE m = 1),
tops AS (
  SELECT 0 AS k, pos, m, subroot AS h FROM subs
  UNION ALL
  SELECT k + 1, pos // 2, (max(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE m > 1 GROUP BY k, pos // 2),
root AS (SELECT h AS root, k AS height FROM tops WHERE m = 1),
low AS (
  SELECT l.rid, n.k, CASE WHEN s.h IS NULL THEN 'S' WHEN s.pos < n.pos THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM leaves l JOIN nodes n ON n.g = l.g AND n.pos = l.pos // (1 << n.k) AND n.m > 1
  LEFT JOIN nodes s ON s.k = n.k AND s.g = n.g AND s.pos = xor(n.pos, 1)),
high AS (
  SELECT u.g, n.k, CASE WHEN s.h IS NULL THEN 'S' WHEN s.pos < n.pos THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM subs u JOIN tops n ON n.pos = u.pos // (1 << n.k) AND n.m > 1 LEFT JOIN tops s ON s.k = n.k AND s.pos = xor(n.pos, 1)),
lowl AS (SELECT rid, list(step ORDER BY k) AS steps FROM low GROUP BY rid),
highl AS (SELECT g, list(step ORDER BY k) AS steps FROM high GROUP BY g),
path AS (
  SELECT l.*, u.subroot, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN subs u USING (g) LEFT JOIN lowl a USING (rid) LEFT JOIN highl b USING (g)),
done AS (
  SELECT *, list_reduce(list_prepend(coalesce(seen, leaf), steps), lambda x, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || x WHEN 'R' THEN x || s[2:] ELSE x END)) AS folded_root
  FROM path)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM done, root
"""


ORACLES = {"op3_line_rules": OP3, "op4_decontamination": OP4, "op6_secret_scan": _secret_sql(), "op12_merkle_manifest": OP12}
