"""SQL beside the queries that SQL can say."""

SAID = "<|im_end|><|im_start|>assistant ok"

CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
l AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2 AS body,
  length(role) + length(role) - length(replace(role, '\\', '')) + (length(role) - length(replace(role, '<|', ''))) // 2
    + length(role) - length(replace(role, chr(10), '')) AS head FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
CAST(sum(CASE WHEN before IS NOT DISTINCT FROM role THEN length('<|im_sep|>') ELSE length('<|im_start|>') + head + 1 END
  + body + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
v AS (SELECT page_id, strlen(body) AS payload_bytes, h, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS INTEGER)) AS g FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(g, lambda x: substr(abc, (x >> 15) % 32 + 1, 1) || substr(abc, (x >> 10) % 32 + 1, 1)
  || substr(abc, (x >> 5) % 32 + 1, 1) || substr(abc, x % 32 + 1, 1)), '') AS payload_digest
  FROM v, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc)),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN origin <> page_id THEN origin END AS refers_to FROM m"""

EMBEDDINGS = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a"""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM s)),
p AS (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
  FROM (SELECT d.doc_id, d.w, z.size, unnest(range(1, len(d.w) - z.size + 2)) AS pos FROM d JOIN (SELECT DISTINCT size FROM t) z ON z.size <= len(d.w))),
h AS (SELECT p.doc_id, p.pos, p.size, t.item_id FROM p JOIN t ON p.size = t.size AND p.win = t.win),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(k.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

TRIE = """WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) r(i))),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, n, c - c % 5 AS b, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), t),
m AS (SELECT n.c, n.b, n.h, least(n.h, coalesce(k.n, 0)) AS head FROM n LEFT JOIN n k ON k.c = n.b),
s AS (SELECT c, 0 AS d, '' AS role, '' AS text FROM m
  UNION ALL SELECT m.c, o.pos, o.role, o.text FROM m JOIN o ON o.c = m.b AND o.pos <= m.h
  UNION ALL SELECT m.c, m.head + o.pos - m.h, o.role, o.text FROM m JOIN o ON o.c = m.c AND o.pos > m.h),
p AS (SELECT c, d, strlen(text) AS size, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path,
  max(d) OVER (PARTITION BY c) AS len FROM s),
q AS (SELECT *, min(c) OVER w AS node, count(*) OVER w AS n, count(*) FILTER (len = d) OVER w AS over FROM p WINDOW w AS (PARTITION BY d, path)),
v AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, CASE WHEN c = node THEN (n - 1) * size ELSE 0 END AS kept,
  CASE WHEN c = node AND over = n THEN 1 ELSE 0 END AS leaf, coalesce(CASE WHEN lead(node) OVER (PARTITION BY c ORDER BY d) = c THEN 1 END, 0) AS child FROM q),
y AS (SELECT *, sum(kept) OVER z AS kepts, sum(leaf) OVER z AS leaves FROM v WINDOW z AS (PARTITION BY c ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT node AS conv_id, d AS depth, any_value(up) AS parent_conv_id, count(*) AS n_convs, CAST(sum(child) AS BIGINT) AS n_children,
CAST(sum(leaves) AS BIGINT) AS n_leaves, CAST(sum(kepts) AS BIGINT) AS saved_tokens,
sha256(coalesce(string_agg(CASE WHEN len = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM y GROUP BY node, d"""
