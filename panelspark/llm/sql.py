"""SQL for what SQL can express: ops 5 and 7 as a whole, and the base figures of ops 3, 4 and 10, as DuckDB writes it."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

REACHED = "reached AS (SELECT id AS node, id AS root FROM ids UNION SELECT l.b, r.root FROM reached r JOIN both_ways l ON l.a = r.node), comps AS (SELECT node AS id, min(root) AS component_id FROM reached GROUP BY node)"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), ids AS (SELECT DISTINCT doc_id AS id FROM documents), {REACHED}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN comps ON comps.id = d.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id < y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), counts AS (SELECT a AS id, count(*) AS k FROM both_ways GROUP BY a), ids AS (SELECT DISTINCT id FROM v), {REACHED}
SELECT v.id AS vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, v.id = component_id AS kept FROM v LEFT JOIN counts USING (id) JOIN comps USING (id)"""


def places(words: list[str]) -> str:
    """The places of a phrase in the list ws."""
    n = len(words)
    return f"list_filter(range(0, len(ws) - {n - 1}), lambda i: ws[i + 1:i + {n}] = {words})"


PHRASES = {"gpl": "gnu general public license".split(), "apache": "apache license".split(), "cc-by": "cc by".split(), "mit": "mit license".split()}
LICENSE_BASE = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, {", ".join(f'{places(v)} AS "{k}"' for k, v in PHRASES.items())} FROM w),
q AS (SELECT *, list_concat({", ".join(f'"{k}"' for k in PHRASES)}) AS every FROM p)
SELECT doc_id, n::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
array_to_string(list_filter([{", ".join(f'''CASE WHEN len("{k}") > 0 THEN '{k}' END''' for k in sorted(PHRASES))}], lambda x: x IS NOT NULL), ',') AS base_labels FROM q"""
LICENSE_BASE = LICENSE_BASE.replace("list_concat(\"gpl\", \"apache\", \"cc-by\", \"mit\")", 'list_concat(list_concat("gpl", "apache"), list_concat("cc-by", "mit"))')

QUALITY_BASE = rf"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
lines AS (SELECT r, len(x) - len(list_distinct(x)) AS dup FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS x FROM w)),
windows AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM windows) WHERE k >= 2),
cover AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM w JOIN lines USING (r) LEFT JOIN cover USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m"""

#: The remainder of a doc_id's crc32, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"
LM_BASE = rf"""WITH w AS (SELECT doc_id, {CRC} % 5 = 1 AS held_out, list_append(regexp_extract_all({LOWER}, {WORD}), 'end of text') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM w), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), total AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 5) AS base_score
FROM t LEFT JOIN c USING (w), total GROUP BY doc_id, held_out"""

ORACLE_SQL = {"op5_ngram_jaccard": JACCARD, "op7_vector_dedup": VECTORS, "license_base": LICENSE_BASE, "quality_base": QUALITY_BASE, "lm_base": LM_BASE}

MIXING = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM s),
c AS (SELECT *, sum(source_size) OVER o AS cs, sum(w) OVER o AS cw, sum(w) OVER () AS tw, sum(source_size) OVER () AS total FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT greatest(max(1.5::DOUBLE * total / tw), max(CASE WHEN cw < tw THEN (1.5::DOUBLE * total - 2.0::DOUBLE * cs) / (tw - cw) END)) AS level FROM c),
t AS (SELECT source, source_size, least(level * w, 2.0::DOUBLE * source_size) AS target FROM w, l),
r AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS part FROM t),
k AS (SELECT d.*, r.* EXCLUDE (source), k, ('0x' || substr(md5((k // 4)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 8 * (k % 4) + 1, 8))::BIGINT / 4294967296::DOUBLE < part AS more FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(16) x(k)),
b AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN more THEN size ELSE 0 END) - any_value(target)), k) AS n FROM k GROUP BY source, k) WHERE n = 1)
SELECT doc_id, size, source_size, target, (size * (whole + more::INT))::BIGINT AS taken FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.k = b.k"""

ORACLE_SQL["op11_mixing"] = MIXING

TRIE = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS item, len(regexp_extract_all(text, {WORD})) AS words FROM t),
c AS (SELECT conv_id, list({{'item': item, 'words': words}} ORDER BY turn NULLS FIRST, role, item) AS own, {CRC.replace("doc_id", "conv_id")} % 4 AS h FROM d GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
e AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
p AS (SELECT conv_id, depth, depth = len(seq) AS ends, array_to_string(list_transform(seq[1:depth], lambda x: x.item), ',') AS k, CASE WHEN depth > 0 THEN array_to_string(list_transform(seq[1:depth - 1], lambda x: x.item), ',') END AS up, CASE WHEN depth > 0 THEN seq[depth].words ELSE 0 END AS words FROM e),
n AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY k),
ch AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saves FROM n LEFT JOIN ch USING (k)),
sub AS (SELECT a.k, sum(f.saves) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves FROM (SELECT DISTINCT q.k, z.k AS below FROM p q JOIN p z ON q.conv_id = z.conv_id AND q.depth <= z.depth) a JOIN f ON f.k = a.below GROUP BY a.k)
SELECT f.conv_id, f.depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256 FROM f JOIN sub USING (k) LEFT JOIN f m ON m.k = f.up AND f.depth > 0"""

ORACLE_SQL["op12_conversation_trie"] = TRIE

NEGATIVES = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLE_SQL["op13_hard_negatives"] = NEGATIVES
