"""DuckDB SQL for the dealt operators that SQL can express; each states the contract anew."""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, md5(concat_ws(':', '20', doc_id::VARCHAR)) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS top,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE]
           [1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM docs GROUP BY source),
levels AS (
  SELECT *, top / w AS ratio,
    ((SELECT sum(source_size)::BIGINT FROM sources)::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(top) OVER earlier, 0.0::DOUBLE)) / sum(w) OVER later AS level
  FROM sources
  WINDOW earlier AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
free AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level < ratio),
targets AS (
  SELECT source, source_size,
    CASE WHEN f.level IS NULL OR f.level * w >= top THEN top ELSE f.level * w END AS target,
    (('0x' || substr(md5(concat_ws(':', '20', 'offset', (source IS NULL)::VARCHAR, coalesce(source, ''))), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM levels, free f),
ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) - 1)::DOUBLE AS place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(u + (place + 1) * rate) - floor(u + place * rate), 2) * size)::BIGINT AS taken
FROM ranked
"""

_NAME = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    for w in ["password", "passwd", "secret", "token", "api_?key"]
)


def _spans(kind: str, rank: int, pattern: str, longest: int, group: int = 0) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(list_filter(list_transform(
    range(1, len(found) + 1),
    lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0),
          'n': length(found[i]), 'g': length(kept[i])}}), lambda s: s.g >= {longest})) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
          regexp_extract_all(text, '{pattern}', {group}) AS kept,
          string_split_regex(text, '{pattern}') AS gaps
        FROM docs)"""


SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
{_spans("assign", 1, "(" + _NAME + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2)} UNION ALL
{_spans("access", 2, "AKIA[A-Z0-9]+", 16)} UNION ALL
{_spans("hex", 3, "[0-9a-f]+", 32)} UNION ALL
{_spans("pem", 4, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1)} UNION ALL
{_spans("jwt", 5, "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 1)}),
listed AS (
  SELECT doc_id, kind, rank, s.start::BIGINT AS start,
    kind || ':' || s.start::BIGINT || ':' || (s.start + s.n)::BIGINT AS span FROM found),
grouped AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'pem') AS n_pem,
    count(*) FILTER (kind = 'jwt') AS n_jwt,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM listed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_pem, 0) AS n_pem, coalesce(n_jwt, 0) AS n_jwt, sha256(d.text) AS blob
FROM docs d LEFT JOIN grouped g ON d.doc_id = g.doc_id
"""

LINES = r"""
WITH lined AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS idx
  FROM documents),
solid AS (
  SELECT doc_id, idx, trim(raw, ' ' || chr(9) || chr(13)) AS line,
    row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lined WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
runs AS (
  SELECT doc_id, j, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run,
    [idx, lead(idx, 1) OVER w, lead(idx, 2) OVER w] AS ats
  FROM solid WHERE n >= 3 WINDOW w AS (PARTITION BY doc_id ORDER BY j)
  UNION ALL
  SELECT doc_id, 0, n || chr(10) || string_agg(line, chr(10) ORDER BY j), list(idx ORDER BY j)
  FROM solid WHERE n < 3 GROUP BY doc_id, n),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY md5(run) ORDER BY doc_id, j) AS k FROM runs WHERE run IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(ats) AS idx FROM ranked WHERE k > 1),
counted AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.idx IS NULL THEN raw END, chr(10) ORDER BY l.idx) AS rest, count(g.idx) AS removed
  FROM lined l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.idx = g.idx GROUP BY l.doc_id),
lengths AS (SELECT doc_id, max(n) AS n FROM solid GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN coalesce(removed, 0) = 0 THEN d.text WHEN removed = n THEN '' ELSE rest END AS text,
  coalesce(n, 0) AS lines, coalesce(removed, 0) AS removed
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN lengths USING (doc_id)
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS keeper FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM kept
"""

TRIE = r"""
WITH crcs AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))),
turns AS (
  SELECT conv_id, coalesce(text, '') AS text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos FROM turns),
convs AS (
  SELECT conv_id, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crcs),
rebuilt AS (
  SELECT conv_id, said, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM (
    SELECT c.conv_id, said, text, pos FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
    UNION ALL SELECT c.conv_id, said, text, pos FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos > h)),
paths AS (
  SELECT conv_id, depth, length(text) AS chars,
    list(said) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
ends AS (
  SELECT path, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS hash
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE depth = last GROUP BY path, depth),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path, depth)),
subtrees AS (
  SELECT path[1:up] AS path, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY path[1:up], up)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
  coalesce(hash, sha256('')) AS ends_sha256
FROM full_nodes n JOIN subtrees s ON n.path = s.path AND n.depth = s.depth
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
LEFT JOIN ends e ON n.path = e.path AND n.depth = e.depth
"""

SQL: dict[str, str] = {
    "op2_line_dedup": LINES,
    "op3_secret_scan": SECRETS,
    "op5_mixing": MIXING,
    "op9_warc": WARC,
    "op12_prefix_trie": TRIE,
}
