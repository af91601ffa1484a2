"""DuckDB SQL for the queries of this subpackage that SQL can state."""

QUALITY = r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tri AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f GROUP BY source),
s AS (SELECT count(*)::DOUBLE AS hosts, sum(n) AS docs, sum(x) AS fails, sum(n * n) AS squares, sum(x * x / n) AS spread FROM h),
p AS (SELECT *, (fails + 0.5) / (docs + 1) AS mean FROM s),
v AS (SELECT *, CASE WHEN docs - squares / docs > 0 THEN (spread - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / (docs - squares / docs) ELSE 0 END AS variance FROM p),
b AS (SELECT mean, CASE WHEN variance > 0 THEN least(greatest(docs, 1), greatest(1, mean * (1 - mean) / variance - 1)) ELSE greatest(docs, 1) END AS strength FROM v)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (h.x + b.mean * b.strength) / (h.n + b.strength) <= 0.5 AS kept
FROM f JOIN h ON h.source IS NOT DISTINCT FROM f.source, b"""

LEAKS = r"""WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS k FROM
  (SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (SELECT r, i, size, array_to_string(words[i : i + size - 1], ' ') AS k FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM low, sizes WHERE len(words) >= size)),
hit AS (SELECT d.r, d.i, d.size, w.item_id FROM dwin d JOIN win w ON w.k = d.k AND w.size = d.size),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM low LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""

CHATS = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:INST|SYS|ROLE)\]|:\])', '\1\3\\\2\4', 'g') AS safe,
  regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:INST|SYS|ROLE)\]|:\])', '\1\3\\\2\4', 'g') AS safe_role FROM c),
s AS (SELECT *, CASE role WHEN 'system' THEN '[SYS] ' || safe || ' [/SYS]' WHEN 'user' THEN '[INST] ' || safe || ' [/INST]' WHEN 'assistant' THEN '<s>' || safe || '</s>'
  ELSE '[ROLE]' || safe_role || '[:]' || safe || '[/ROLE]' END AS made FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(made))::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""

#: The checksum of a number's digits is a fold over bits, table-free.
TRIE = r"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, length(coalesce(text, ''))::BIGINT AS chars FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT m.c, 0 AS part, t.pos, t.turn, t.chars FROM m JOIN t ON t.c = m.base AND t.pos <= m.h UNION ALL SELECT m.c, 1, t.pos, t.turn, t.chars FROM m JOIN t ON t.c = m.c AND t.pos > m.h),
s AS (SELECT c, turn, chars, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM r),
l AS (SELECT m.c, coalesce(list(s.turn ORDER BY s.d) FILTER (s.turn IS NOT NULL), []) AS turns, coalesce(list(s.chars ORDER BY s.d) FILTER (s.turn IS NOT NULL), []) AS chars FROM m LEFT JOIN s USING (c) GROUP BY m.c),
p AS (SELECT c, d, array_to_string(turns[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(turns[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(turns) AS ends
  FROM (SELECT c, turns, chars, unnest(range(0, len(turns) + 1)) AS d FROM l)),
n AS (SELECT k, d, min(up) AS up, min(c) AS rep, count(*) AS n, (count(*) - 1) * min(chars) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended FROM p GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d),
below AS (SELECT p.k, p.d, sum((f.n_children = 0)::BIGINT) AS leaves, sum(f.saved) AS saved FROM f JOIN p AS q ON q.c = f.rep AND q.d = f.d JOIN p ON p.c = f.rep AND p.d <= f.d GROUP BY p.k, p.d)
SELECT f.rep AS conv_id, f.d::BIGINT AS depth, up.rep AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens,
  sha256(f.ended) AS ends_sha256
FROM f JOIN below ON below.k = f.k AND below.d = f.d LEFT JOIN f AS up ON up.k = f.up AND up.d = f.d - 1"""
