"""DuckDB SQL for the training-data queries that SQL can express."""

SUBSTRING = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM windows) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM again, range(0, 50) AS r(j)
), marked AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), each AS (
  SELECT w.doc_id, w.w, generate_subscripts(w.w, 1) AS p FROM words w
), kept AS (
  SELECT e.doc_id, array_to_string(list(e.w[e.p] ORDER BY e.p), ' ') AS t
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(m.ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN marked m USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def _crc32(byte_list: str) -> str:
    """Unsigned CRC-32 of a list of bytes, bit by bit: a byte is taken in with the first of its eight steps."""
    steps = f"flatten(list_transform({byte_list}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: {step}), 4294967295)"


_ASCII = "list_transform(range(1, length(s) + 1), lambda i: CAST(ord(substr(s, i, 1)) AS BIGINT))"

PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(role) || ':' || role || ':' || text) AS t, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, t, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS d FROM turns
), ids AS (
  SELECT conv_id, size, conv_id - conv_id % 20 AS base, {_crc32(_ASCII)} % 4 AS h FROM (SELECT conv_id, max(d) AS size, CAST(conv_id AS VARCHAR) AS s FROM own GROUP BY conv_id)
), plan AS (
  SELECT i.conv_id, i.h, i.base, least(i.h, coalesce(b.size, 0)) AS m FROM ids i LEFT JOIN ids b ON b.conv_id = i.base
), rebuilt AS (
  SELECT p.conv_id, o.d, o.t, o.w FROM plan p JOIN own o ON o.conv_id = p.base AND o.d <= p.m
  UNION ALL SELECT p.conv_id, o.d - p.h + p.m, o.t, o.w FROM plan p JOIN own o ON o.conv_id = p.conv_id AND o.d > p.h
), seqs AS (
  SELECT p.conv_id, coalesce(string_agg(r.t, '' ORDER BY r.d), '') AS path, coalesce(list(r.w ORDER BY r.d) FILTER (r.w IS NOT NULL), []) AS ws FROM plan p LEFT JOIN rebuilt r USING (conv_id) GROUP BY p.conv_id
), places AS (
  SELECT conv_id, depth, substr(path, 1, 32 * depth) AS p, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w, depth * 32 = length(path) AS ends
  FROM (SELECT *, unnest(range(0, length(path) // 32 + 1)) AS depth FROM seqs)
), nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM places GROUP BY p, depth
), kids AS (
  SELECT substr(p, 1, 32 * (depth - 1)) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT substr(p, 1, 32 * k) AS p, sum((n - 1) * w) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT n.*, k.p IS NULL AS leaf, unnest(range(0, depth + 1)) AS k FROM nodes n LEFT JOIN kids k USING (p)) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b USING (p) LEFT JOIN kids k USING (p) LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = substr(n.p, 1, 32 * (n.depth - 1))
"""

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING = rf"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY k) AS tab FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k)
), runs AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_A}', '{_Z}') AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL
), keyed AS (
  SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM runs
), summed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM keyed, bits
), words AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN c % 97 = 0 THEN substr(w, 1, CAST(c % length(w) AS INT)) || substr(w, CAST(c % length(w) AS INT) + 2) ELSE w END AS w FROM summed) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), cuts AS (
  SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, CAST(unnest(range(1, length(w) + 1)) AS INT) AS i FROM words)
), pairs AS (
  SELECT a.w AS a, b.w AS b, b.n AS n FROM cuts a JOIN cuts b ON a.i = b.i AND a.v = b.v AND a.w <> b.w
  UNION SELECT c.w, u.w, u.n FROM cuts c JOIN words u ON u.w = c.v
  UNION SELECT u.w, c.w, c.n FROM cuts c JOIN words u ON u.w = c.v
), best AS (
  SELECT a, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS b FROM pairs GROUP BY a
), forms AS (
  SELECT w.w AS word, CASE WHEN -b.b.m >= 2 * w.n THEN b.b.w END AS form, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CASE WHEN -b.b.m >= 2 * w.n THEN -b.b.m END AS form_n FROM words w LEFT JOIN best b ON b.a = w.w
), walk AS (
  SELECT word, word AS at, form AS nxt FROM forms UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.nxt
)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN walk k ON k.word = f.word AND k.nxt IS NULL
"""
