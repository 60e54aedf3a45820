"""DuckDB SQL of the personal-data query."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _placed(source: str, pattern: str, more: str) -> str:
    """Rows (r, start, v) of a pattern's matches; start from 0."""
    return f"""SELECT r, {more} vs[i] AS v, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g)))
         + coalesce(list_sum(list_transform(vs[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM
        (SELECT r, t, regexp_extract_all(t, '{pattern}') AS vs, regexp_split_to_array(t, '{pattern}') AS gs FROM {source}))"""


_FOUND = " UNION ALL ".join(f"({_placed('d', p, f'{k} AS k,')})" for k, p in enumerate(_RAW.values()))

SANITISE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
found AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM ({_FOUND})),
base AS (SELECT r, k, start, start + length(v) AS stop, v, digits FROM found WHERE CASE k
  WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INTEGER), 0) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
       CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INTEGER)
            ELSE 2 * CAST(digits[-i] AS INTEGER) - CASE WHEN digits[-i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(digits) BETWEEN 10 AND 15 END),
l AS (SELECT r, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d),
around AS (
  SELECT r, k || ':' || CASE k WHEN 0 THEN translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 1 THEN v ELSE digits END AS e,
         CASE WHEN start > 60 THEN regexp_replace(substr(t, start - 60, 61), '^{_WORD}', '') ELSE left(t, start) END || ' ' ||
         CASE WHEN length(t) - stop > 60 THEN regexp_replace(substr(t, stop + 1, 61), '{_WORD}$', '') ELSE substr(t, stop + 1) END AS a
  FROM base JOIN l USING (r)),
near AS (SELECT DISTINCT r, e, a, unnest(regexp_extract_all(a, '{_WORD}')) AS w FROM around),
pairs AS (SELECT e, w, count(DISTINCT r) AS n_et FROM near GROUP BY e, w HAVING count(DISTINCT a) >= 3),
held AS (SELECT e, count(DISTINCT r) AS n_e FROM around GROUP BY e),
words AS (SELECT DISTINCT r, unnest(regexp_extract_all(t, '{_WORD}')) AS w FROM l),
often AS (SELECT w, count(*) AS n_t FROM words WHERE w IN (SELECT w FROM pairs) GROUP BY w),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
terms AS (SELECT DISTINCT w FROM pairs JOIN held USING (e) JOIN often USING (w), n
          WHERE n * n_et >= 64.0 * n_e * n_t AND log2(n * n_et / (n_e * n_t)) >= 0.9 * log2(n / n_e)),
hit AS (SELECT * FROM l WHERE r IN (SELECT r FROM words WHERE w IN (SELECT w FROM terms))),
term AS (SELECT r, 4 AS k, start, start + length(v) AS stop FROM ({_placed('hit', _WORD, '')}) WHERE v IN (SELECT w FROM terms)),
spans AS (SELECT r, k, start, stop FROM base UNION ALL
          SELECT * FROM term WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = term.r AND b.start < term.stop AND term.start < b.stop)),
listed AS (SELECT r, k, start, ['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || start || ':' || stop AS s FROM spans),
per AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card,
               count(*) FILTER (WHERE k = 3) AS n_phone, string_agg(s, ',' ORDER BY start, k) FILTER (WHERE k < 4) AS own,
               string_agg(s, ',' ORDER BY start, k) AS spans FROM listed GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""
