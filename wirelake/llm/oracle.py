"""SQL for the corpus queries that SQL can express."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
n AS (SELECT doc_id, CAST(coalesce(len(shingles), 0) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT n.doc_id, n_shingles, min(other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n_shingles"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, words, least(10, len(words)) AS width FROM i WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(words) - width + 2), lambda j: array_to_string(words[j : j + width - 1], ' '))) AS gram FROM k),
widths AS (SELECT DISTINCT width FROM win),
g AS (SELECT doc_id, width, unnest(range(1, len(words) - width + 2)) AS pos, words FROM d CROSS JOIN widths WHERE len(words) >= width),
t AS (SELECT doc_id, width, pos, array_to_string(words[pos : pos + width - 1], ' ') AS gram FROM g),
h AS (SELECT doc_id, item_id, pos, t.width FROM t JOIN win ON t.gram = win.gram AND t.width = win.width),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

RANKED = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
c AS (SELECT row_number() OVER () AS r, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM c),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM c) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f CROSS JOIN g),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score FROM t JOIN w USING (term) JOIN i USING (term) CROSS JOIN g GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""

#: The checksum of conv_id in decimal, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)))"""

TRIE = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(role)), ':', role, text))) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.conv_id, base, h, (SELECT count(*) FROM o WHERE o.conv_id = c.base AND o.i <= c.h) AS k FROM c),
r AS (SELECT k.conv_id, o.i AS pos, role, text FROM k JOIN o ON o.conv_id = k.base AND o.i <= k.h UNION ALL SELECT k.conv_id, k.k + o.i - k.h, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND o.i > k.h),
p AS (SELECT conv_id, pos, text, string_agg(sha256(concat(octet_length(encode(role)), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r),
z AS (SELECT conv_id, CAST(pos AS BIGINT) AS depth, sha256(path) AS id, lag(sha256(path), 1, 'root') OVER (PARTITION BY conv_id ORDER BY pos) AS parent, octet_length(encode(text)) AS bytes FROM p UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
n AS (SELECT id, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM z GROUP BY id),
b AS (SELECT parent AS id, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN b USING (id)),
s AS (SELECT z.id, CAST(sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens FROM v JOIN z ON z.conv_id = v.conv_id AND z.depth <= v.depth GROUP BY z.id),
l AS (SELECT conv_id, max(depth) AS depth FROM z GROUP BY conv_id),
e AS (SELECT z.id, sha256(string_agg(CAST(z.conv_id AS VARCHAR), ',' ORDER BY z.conv_id)) AS ends_sha256 FROM z JOIN l USING (conv_id, depth) GROUP BY z.id)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM v JOIN s USING (id) LEFT JOIN e USING (id) LEFT JOIN v u ON u.id = v.parent"""

LINKED_VECTORS = """WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT r, vec_id, label, e FROM r WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(e, lambda y: y <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a),
reach(r, other) AS (SELECT r, r FROM r UNION SELECT reach.r, p.b FROM reach JOIN p ON p.a = reach.other)
SELECT r.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(o.vec_id) AS component_id, coalesce(r.vec_id = min(o.vec_id), false) AS kept
FROM r JOIN reach USING (r) JOIN r o ON o.r = reach.other LEFT JOIN n ON n.r = r.r GROUP BY r.r, r.vec_id"""
