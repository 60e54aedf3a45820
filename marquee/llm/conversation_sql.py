"""DuckDB SQL of the conversation queries."""

from __future__ import annotations

#: crc32 over text, bit by bit: the table of 256 entries, then a fold.
_CRC = """crc AS (SELECT list(c ORDER BY n) AS tab FROM (
  SELECT n, list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(n)))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"""


PREFIX_TRIE = f"""
WITH {_CRC},
own AS (SELECT conv_id AS c, octet_length(encode(coalesce(text, ''))) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest
        FROM (SELECT *, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest
              FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, n, h, c - c % 5 AS base FROM (SELECT c, count(*) AS n FROM own GROUP BY c), (SELECT tab FROM crc),
          LATERAL (SELECT {_crc32("CAST(c AS VARCHAR)")} % 9 AS h)),
taken AS (SELECT convs.c, own.place, digest, size FROM convs JOIN own ON own.c = base AND own.place <= h),
heads AS (SELECT convs.c, h, n, count(taken.c) AS nb FROM convs LEFT JOIN taken USING (c) GROUP BY convs.c, h, n),
built AS (SELECT c, place, digest, size FROM taken
          UNION ALL SELECT c, nb + place - h, digest, size FROM own JOIN heads USING (c) WHERE place > h),
pre AS (SELECT c, place AS depth, size, md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY place)) AS k FROM built
        UNION ALL SELECT c, 0, 0, '' FROM heads),
up AS (SELECT *, lag(k) OVER w AS parent, lead(k) OVER w IS NULL AS last FROM pre WINDOW w AS (PARTITION BY c ORDER BY depth)),
nodes AS (SELECT k, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                 coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM up GROUP BY k, depth),
kids AS (SELECT parent AS k, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
-- every node with each of the prefixes it begins with
sums AS (SELECT a.k, sum((f.n_convs - 1) * f.size) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves
         FROM full_ f JOIN pre a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY a.k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums USING (k) LEFT JOIN nodes p ON p.k = f.parent
"""

REPAIR = rf"""
WITH RECURSIVE {_CRC},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h
        FROM conversations, crc),
r AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM (SELECT *, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM hit)),
p AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM r),
f AS (SELECT *, CASE WHEN solid = '' THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                     WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i NOT IN ('su', 'ua', 'au') AS illegal FROM p),
-- what a row may do: state before (0 nothing, 1 system, 2 user, 3 assistant), initial needed, state after
nxt(state, who, after) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
own AS (SELECT state, NULL AS need, state AS after, 'D' AS letters, 2 AS cost FROM nxt
        UNION ALL SELECT state, NULL, after, 'R', 1 FROM nxt
        UNION ALL SELECT state, who, after, 'K', 0 FROM nxt UNION ALL SELECT 0, 's', 1, 'K', 0),
added AS (SELECT state, state AS after, '' AS letters, 0 AS cost FROM nxt
          UNION ALL SELECT state, after, 'I', 5 FROM nxt
          UNION ALL SELECT a.state, b.after, 'II', 10 FROM nxt a JOIN nxt b ON b.state = a.after),
edge AS (SELECT own.state, need, added.after, own.letters || added.letters AS letters, own.cost + added.cost AS cost
         FROM own JOIN added ON added.state = own.after),
dp AS (
  SELECT conv_id, 0::BIGINT AS place, after AS state, cost, letters AS audit
  FROM (SELECT DISTINCT conv_id FROM r), added WHERE added.state = 0
  UNION ALL
  SELECT conv_id, place, state, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT f.conv_id, f.place, edge.after AS state, dp.cost + edge.cost + CASE WHEN fault = 'truncated' AND letters[1] <> 'D' THEN 5 ELSE 0 END AS cost,
           dp.audit || edge.letters AS audit
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.place = dp.place + 1 JOIN edge ON edge.state = dp.state
    WHERE (need IS NULL OR need = f.i) AND (letters[1] = 'D' OR fault NOT IN ('blank', 'duplicate'))
  ) GROUP BY conv_id, place, state
),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
      FROM f GROUP BY conv_id),
best AS (SELECT c.conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit
         FROM c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.place = c.n WHERE state IN (0, 3) GROUP BY c.conv_id),
-- replay: every letter with the row it uses and the role it leaves
letter AS (SELECT conv_id, pos, audit[pos] AS l, length(replace(left(audit, pos), 'I', '')) AS row,
                  length(replace(left(audit, pos), 'D', '')) AS out FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM best)),
spoken AS (SELECT letter.*, CASE WHEN l = 'I' THEN '' ELSE f.text END AS text, f.role, f.i,
                  max(CASE WHEN l = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY letter.conv_id) AS system
           FROM letter LEFT JOIN f ON l <> 'I' AND f.conv_id IS NOT DISTINCT FROM letter.conv_id AND f.place = letter.row WHERE l <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS t
             FROM spoken GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM i.conv_id
"""
