"""SQL, for DuckDB, of those corpus queries that SQL can state whole."""

CHAT_FORMATTING = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
  n AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
  p AS (SELECT conv_id, pos, n_turns, string_agg(CAST(json_array(role, text) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM n),
  whole AS (SELECT so_far, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY 1),
  stay AS (SELECT * FROM whole WHERE so_far NOT IN (SELECT so_far FROM p WHERE pos < n_turns))
SELECT n.conv_id, n.n_turns, stay.n_copies, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS chat, 0::BIGINT AS block
FROM n JOIN stay ON n.conv_id IS NOT DISTINCT FROM stay.conv_id GROUP BY 1, 2, 3
"""

_SHINGLES = r"""list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""

DECONTAMINATION = rf"""
WITH i AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark)),
  sized AS (SELECT item_id, s, count(*) OVER (PARTITION BY item_id) AS n_item FROM i),
  short AS (SELECT coalesce(list(DISTINCT n) FILTER (n BETWEEN 1 AND 4), []) AS ks FROM (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'))::BIGINT AS n FROM benchmark)),
  d AS (SELECT DISTINCT doc_id, text, unnest(list_concat({_SHINGLES}, flatten(list_transform(ks, lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))))) AS s FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents), short)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM d JOIN sized USING (s) GROUP BY doc_id, text, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""

MIXING = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS h FROM documents),
  own AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
  s AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS cap FROM own),
  fill AS (SELECT 0 AS i, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s) AS level
    UNION ALL SELECT i + 1, now FROM (SELECT i, level, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce((SELECT sum(cap) FROM s WHERE weight * level >= cap), 0)) / (SELECT sum(weight) FROM s WHERE weight * level < cap) AS now FROM fill) WHERE now > level),
  goal AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM fill)) AS target FROM s),
  r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM goal),
  q AS (SELECT *, least(source_size, floor(target - copies * source_size + 0.5)::BIGINT) AS rest FROM r),
  placed AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begins FROM d),
  taken AS (SELECT placed.*, q.source_size, q.target, q.copies, greatest(0, least(size, q.rest - begins))::BIGINT AS part FROM placed JOIN q ON placed.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, copies * size + part AS taken, source, copies, part FROM taken
"""

# The checksum of a number's decimal digits, byte by byte and bit by bit.
_CRC = "xor(list_reduce(list_transform(range(1, len({x}) + 1), lambda i: ascii(substr({x}, i, 1))::UBIGINT), lambda c, b: list_reduce(range(8)::UBIGINT[], lambda y, k: xor(y >> 1, 3988292384::UBIGINT * (y & 1)), xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}))::VARCHAR || ':' || {x} END"


_FIELDS = " || ".join(_field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))
_SIDES = "coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"

MERKLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS} || {_field('text')}) AS leaf,
    CASE WHEN {_CRC.format(x="(doc_id::VARCHAR)")} % 3 = 0 THEN sha256({_FIELDS} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS shown FROM documents),
  t AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS id FROM d),
  n AS (SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS total FROM t
    UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (total + 7) // 8 FROM n WHERE total > 1 GROUP BY tree, level, idx // 8, total),
  roots AS (SELECT tree, level, h, row_number() OVER (ORDER BY tree) - 1 AS idx FROM n WHERE total = 1),
  top AS (SELECT 0 AS level, idx, h, count(*) OVER () AS total FROM roots UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (total + 7) // 8 FROM top WHERE total > 1 GROUP BY level, idx // 8, total),
  s1 AS (SELECT tree, level, idx, {_SIDES} FROM n WHERE total > 1 WINDOW w AS (PARTITION BY tree, level, idx // 8 ORDER BY idx)),
  s2 AS (SELECT level, idx, {_SIDES} FROM top WHERE total > 1 WINDOW w AS (PARTITION BY level, idx // 8 ORDER BY idx)),
  w1 AS (SELECT id, tree, 0 AS level, idx, coalesce(shown, leaf) AS node, '' AS proof FROM t UNION ALL SELECT id, w1.tree, w1.level + 1, w1.idx // 8, sha256(l || node || r), proof || l || r FROM w1 JOIN s1 ON s1.tree = w1.tree AND s1.level = w1.level AND s1.idx = w1.idx),
  w2 AS (SELECT id, 0 AS level, roots.idx, node, proof FROM w1 JOIN roots ON roots.tree = w1.tree AND roots.level = w1.level UNION ALL SELECT id, w2.level + 1, w2.idx // 8, sha256(l || node || r), proof || l || r FROM w2 JOIN s2 ON s2.level = w2.level AND s2.idx = w2.idx),
  root AS (SELECT level, h FROM top WHERE total = 1)
SELECT doc_id, leaf, roots.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = root.h AS verified FROM t JOIN roots USING (tree) JOIN root ON true JOIN w2 ON w2.id = t.id AND w2.level = root.level
"""

TRIE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, count(*) AS n, ({_CRC.format(x="(conv_id::VARCHAR)")} % 9)::BIGINT AS h, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
  b AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(o.n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c o ON o.conv_id = c.base WHERE t.pos >= c.h),
  p AS (SELECT conv_id, pos + 1 AS depth, octet_length(encode(text)) AS size, string_agg(sha256(json_array(role, text)::VARCHAR), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM b UNION ALL SELECT conv_id, 0, 0, '' FROM c),
  node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM p GROUP BY ALL),
  kids AS (SELECT left(path, (depth - 1) * 64) AS path, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
  ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) USING (conv_id, depth) GROUP BY 1),
  whole AS (SELECT a.path, sum((u.n_convs - 1) * u.size)::BIGINT AS saved, count(*) FILTER (u.path NOT IN (SELECT path FROM kids)) AS leaves FROM node a JOIN node u ON left(u.path, a.depth * 64) = a.path GROUP BY 1)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN whole USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN node up ON node.depth > 0 AND up.path = left(node.path, (node.depth - 1) * 64)
"""

ORACLES = {"op5_chat_formatting": CHAT_FORMATTING.strip(), "op7_decontamination": DECONTAMINATION.strip(), "op9_mixing": MIXING.strip(), "op12_merkle_manifest": MERKLE.strip(), "op13_prefix_trie": TRIE.strip()}
