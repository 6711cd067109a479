"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP2_MIXING = r"""
WITH r AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS spot
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM r GROUP BY k),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             2 * source_size::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS pool FROM s),
v AS (SELECT *, pool - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
             row_number() OVER (ORDER BY cap / w, k) AS place FROM w),
f AS (SELECT place AS p, rest AS l_rest, w_rest AS l_w FROM v WHERE rest * w <= cap * w_rest ORDER BY place LIMIT 1),
t AS (SELECT k, source_size, CASE WHEN p IS NULL OR place < p THEN cap ELSE w * l_rest / l_w END AS target FROM v LEFT JOIN f ON true),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target + 0.5)::BIGINT // source_size) END AS whole FROM t),
c AS (SELECT r.*, b.source_size, b.target, b.whole, floor(b.target + 0.5)::BIGINT - b.whole * b.source_size AS budget,
             coalesce(sum(r.size) OVER (PARTITION BY r.k ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM r JOIN b USING (k))
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - ahead)))::BIGINT AS taken FROM c
"""

OP3_EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""

#: CRC-32 byte by byte with the usual table, which is worked out from its polynomial.
OP9_SHARDING = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
r AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k, md5('interleave-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
             (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
e AS (SELECT doc_id, source, k, h, size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c // 256, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
      FROM r, tab),
f AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY h, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY k) AS frac,
             row_number() OVER (PARTITION BY k ORDER BY h, doc_id, text_crc32, size) AS rk, count(*) OVER () AS n FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY frac, k, rk) - 1 AS pos FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // n)::INTEGER AS shard,
       (pos - (((pos * 16 // n) * n + 15) // 16))::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM p
"""

_CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def _escaped(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for c in _CONTROL:
        out = f"replace({out}, '{c}', '{'&lt;' if c[0] == '<' else '&#91;'}{c[1:]}')"
    return out


OP4_CHAT_FORMATTING = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(replace({_escaped("role")}, chr(10), '&#10;')) + 1 + length({_escaped("text")}) + 11)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP6_WARC = r"""
WITH n AS (SELECT greatest(1, (count(*) + 1999) // 2000) AS archives FROM pages),
p AS (SELECT page_id, url, html, ('0x' || substr(md5('warc:' || coalesce(page_id::VARCHAR, 'null')), 1, 8))::BIGINT % archives AS archive,
             ('0x' || substr(md5('damage:' || coalesce(page_id::VARCHAR, 'null')), 1, 8))::BIGINT % 50 AS fate,
             'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
             || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
             chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages, n),
r AS (SELECT *, head || coalesce(html, '') || tail AS rec, head || regexp_replace(coalesce(html, ''), '^[!-~]', '~') || tail AS rot FROM p),
o AS (SELECT *, coalesce(sum(octet_length(encode(rec))) OVER (PARTITION BY archive ORDER BY page_id, url, html ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r)
SELECT archive, "offset", page_id, CASE WHEN fate = 1 THEN 'missing' ELSE 'altered' END AS state, sha256(rec) AS expected, CASE WHEN fate = 0 THEN sha256(rot) END AS found
FROM o WHERE fate = 1 OR (fate = 0 AND rec <> rot)
"""

OP7_NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n_shingles + q.n_shingles - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

#: Forward dynamic programming over structs (cost, edits, repaired text) for the four states of the pattern; structs compare by
#: cost, then edits.
OP11_CONVERSATION_REPAIR = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, 'null') AS k,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT)),
                             lambda c, x: xor(c // 256, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS fate FROM conversations, tab),
d AS (SELECT k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM b, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 2
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY pos) AS before FROM o),
far AS (SELECT {'c': 1000000000, 'e': '', 't': ''} AS far),
z AS (SELECT DISTINCT k, 0 AS pos, {'c': 0, 'e': '', 't': ''} AS n, far AS s, {'c': 5, 'e': 'I', 't': chr(10) || 'user:'} AS u, {'c': 10, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM b, far
      UNION ALL
      SELECT k, pos, n, s, u, least(a0, {'c': u.c + 5, 'e': u.e || 'I', 't': u.t || chr(10) || 'assistant:'}) FROM (
        SELECT k, pos, n, s, a0, least(u0, {'c': n.c + 5, 'e': n.e || 'I', 't': n.t || chr(10) || 'user:'}, {'c': s.c + 5, 'e': s.e || 'I', 't': s.t || chr(10) || 'user:'}, {'c': a0.c + 5, 'e': a0.e || 'I', 't': a0.t || chr(10) || 'user:'}) AS u
        FROM (
          SELECT z.k, f.pos, {'c': z.n.c + 2, 'e': z.n.e || 'D', 't': z.n.t} AS n,
                 least({'c': z.s.c + 2, 'e': z.s.e || 'D', 't': z.s.t}, CASE WHEN i = 's' THEN {'c': z.n.c + y, 'e': z.n.e || 'K', 't': z.n.t || line} ELSE far END) AS s,
                 least({'c': z.u.c + 2, 'e': z.u.e || 'D', 't': z.u.t},
                       CASE WHEN i = 'u' THEN {'c': z.n.c + y, 'e': z.n.e || 'K', 't': z.n.t || line} ELSE far END, CASE WHEN i = 'u' THEN {'c': z.s.c + y, 'e': z.s.e || 'K', 't': z.s.t || line} ELSE far END,
                       CASE WHEN i = 'u' THEN {'c': z.a.c + y, 'e': z.a.e || 'K', 't': z.a.t || line} ELSE far END,
                       {'c': z.n.c + y + 1, 'e': z.n.e || 'R', 't': z.n.t || chr(10) || 'user:' || text}, {'c': z.s.c + y + 1, 'e': z.s.e || 'R', 't': z.s.t || chr(10) || 'user:' || text},
                       {'c': z.a.c + y + 1, 'e': z.a.e || 'R', 't': z.a.t || chr(10) || 'user:' || text}) AS u0,
                 least({'c': z.a.c + 2, 'e': z.a.e || 'D', 't': z.a.t}, CASE WHEN i = 'a' THEN {'c': z.u.c + y, 'e': z.u.e || 'K', 't': z.u.t || line} ELSE far END,
                       {'c': z.u.c + y + 1, 'e': z.u.e || 'R', 't': z.u.t || chr(10) || 'assistant:' || text}) AS a0
          FROM z JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS y, chr(10) || role || ':' || text AS line FROM f) f ON f.k = z.k AND f.pos = z.pos + 1, far))),
r AS (SELECT z.k, least(n, a) AS best FROM z JOIN (SELECT k, max(pos) AS pos FROM z GROUP BY k) USING (k, pos)),
g AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       best.c::BIGINT AS cost, best.e AS audit, sha256(best.t[2:]) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM b) JOIN r USING (k) LEFT JOIN g USING (k)
"""

#: The tree level by level as lists; a proof is a list of `left,right` strings, folded from below.
OP12_MERKLE_MANIFEST = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
b AS (SELECT doc_id, source, text, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
             || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                             lambda c, x: xor(c // 256, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 2 = 0 AS hit FROM documents, tab),
c AS (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS cut FROM b),
r AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) AS cut_leaf FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM r),
t AS (SELECT g, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM o GROUP BY g
      UNION ALL SELECT g, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY idx) AS nodes FROM s
      UNION ALL SELECT level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM u WHERE len(nodes) > 1),
p AS (SELECT o.doc_id, o.g, o.idx, t.level, t.nodes, o.idx // (3 ** t.level)::BIGINT AS k FROM o JOIN t USING (g) WHERE len(nodes) > 1
      UNION ALL SELECT o.doc_id, o.g, o.idx, 100 + u.level, u.nodes, s.idx // (3 ** u.level)::BIGINT FROM o JOIN s USING (g), u WHERE len(nodes) > 1),
q AS (SELECT g, idx, list(array_to_string(nodes[k // 3 * 3 + 1:k], '') || ',' || array_to_string(nodes[k + 2:k // 3 * 3 + 3], '') ORDER BY level) AS steps FROM p GROUP BY g, idx),
f AS (SELECT o.doc_id, o.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(replace(array_to_string(coalesce(q.steps, []), ''), ',', '')) AS proof_sha256,
             list_reduce(list_prepend(o.cut_leaf, coalesce(q.steps, [])), lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2))) AS folded_root
      FROM o JOIN s USING (g) LEFT JOIN q ON q.g = o.g AND q.idx = o.idx)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLES = {"op2_mixing": OP2_MIXING, "op3_exact_dedup": OP3_EXACT_DEDUP, "op4_chat_formatting": OP4_CHAT_FORMATTING, "op6_warc": OP6_WARC, "op7_near_dedup": OP7_NEAR_DEDUP, "op9_sharding": OP9_SHARDING, "op11_conversation_repair": OP11_CONVERSATION_REPAIR, "op12_merkle_manifest": OP12_MERKLE_MANIFEST}
