"""SQL for the registered queries that SQL can express; names are those of the queries.

The others need fingerprints of XXH64, component search, token merges or span
positions, and are tested against brute-force versions.
"""

from __future__ import annotations

WORD = "'[^\\x20\\x09-\\x0D]+'"
_WORDS = f"words AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents)"

QUALITY = f"""
WITH {_WORDS},
tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
win AS (SELECT doc_id, i, x, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM tok),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS r FROM win WHERE len(g) = 8),
cov AS (SELECT w.doc_id, w.i, w.x, w.before, coalesce(max(r::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0) AS c FROM win w LEFT JOIN rep USING (doc_id, i)),
per_word AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words, sum((x = before)::INT) AS n_stutter, sum(regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')::INT) AS n_lettered FROM cov GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
per_line AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(l, {WORD})) - count(DISTINCT l) FILTER (regexp_matches(l, {WORD})) AS n_dup_lines,
  sum(regexp_matches(l, '^\\s*[-*\\x{{2022}}]\\s')::INT) AS n_bullets, sum(regexp_matches(l, '(\\.\\.\\.|\\x{{2026}})\\s*$')::INT) AS n_ellipses FROM line GROUP BY 1),
base AS (SELECT s.doc_id, s.text, len(s.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(s.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(s.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, l.n_dup_lines::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words,
  l.n_lines, l.n_bullets, l.n_ellipses, p.n_stutter, p.n_lettered, length(regexp_replace(coalesce(s.text, ''), '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(coalesce(s.text, ''), '[^a-z]', '', 'g')) AS lower_,
  length(regexp_replace(coalesce(s.text, ''), '[^!]', '', 'g')) AS n_marks FROM words s JOIN per_line l USING (doc_id) LEFT JOIN per_word p USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols / n_words > 0.1 OR word_chars / n_words < 2.5 OR word_chars / n_words > 15 OR n_dup_lines / n_lines > 0.5 OR n_lettered / n_words < 0.7
  OR upper_ > lower_ OR n_marks / n_words > 0.3 OR n_stutter / n_words > 0.3 OR n_bullets / n_lines > 0.9 OR n_ellipses / n_lines > 0.3) AS kept FROM judged
"""

LINES = f"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
real_ AS (SELECT doc_id, l, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM line WHERE regexp_matches(l, {WORD})),
win AS (SELECT doc_id, k, list(l) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g FROM real_),
again AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1 AS later FROM win WHERE len(g) = 3),
gone AS (SELECT r.doc_id, r.n, coalesce(max(later::INT) OVER (PARTITION BY r.doc_id ORDER BY r.k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS g FROM real_ r LEFT JOIN again USING (doc_id, k)),
kept AS (SELECT l.doc_id, string_agg(l.l, chr(10) ORDER BY l.n) AS t FROM line l LEFT JOIN gone g USING (doc_id, n) WHERE coalesce(g.g, 0) = 0 GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n_lines, sum(g) AS n_removed FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

SUBSTRINGS = f"""
WITH {_WORDS},
tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
win AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM tok),
later AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS r FROM win WHERE len(g) = 13),
cov AS (SELECT t.doc_id, t.i, t.x, coalesce(max(r::INT) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS c FROM tok t LEFT JOIN later USING (doc_id, i)),
left_ AS (SELECT doc_id, sum(c) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (c = 0) AS t FROM cov GROUP BY 1)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(l.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256 FROM words s LEFT JOIN left_ l USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lead <> page_id THEN lead END AS refers_to FROM q
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"


def _tree_sql(name: str, start: str) -> str:
    """Nodes (k, lvl, pos, n, h) of the trees over the rows ``start``, and each node's siblings (l, r)."""
    return f"""
{name} AS (SELECT k, 0 AS lvl, pos, n, h FROM {start} UNION ALL SELECT k, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY k, lvl, pos // 3),
{name}_sib AS (SELECT u.k, u.lvl, u.pos, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos < u.pos), '') AS l, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos > u.pos), '') AS r
  FROM {name} u JOIN {name} v ON u.k = v.k AND u.lvl = v.lvl AND u.pos // 3 = v.pos // 3 WHERE u.n > 1 GROUP BY 1, 2, 3)"""


MERKLE = f"""
WITH RECURSIVE crc AS (SELECT doc_id, crc_ % 2 = 0 AS even FROM (SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i, 1))::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS c0, xor(c0, 4294967295::UBIGINT) AS crc_ FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))),
own AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS k, {_LEAF.format("text")} AS leaf, {_LEAF.format("now")} AS hit
  FROM (SELECT d.*, CASE WHEN c.even THEN replace(text, chr(10), '') ELSE text END AS now FROM documents d LEFT JOIN crc c USING (doc_id))),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n, leaf AS h FROM own),
{_tree_sql("up", "leaves")},
subs AS (SELECT k AS source_key, h AS subroot, '' AS k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h FROM up WHERE n = 1),
{_tree_sql("top", "subs")},
walk AS (SELECT rid, k, 0 AS lvl, pos, n, hit AS t, '' AS proof FROM leaves UNION ALL SELECT w.rid, w.k, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(s.l || w.t || s.r), w.proof || s.l || s.r FROM walk w JOIN up_sib s ON s.k = w.k AND s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1),
walk2 AS (SELECT w.rid, b.k, 0 AS lvl, b.pos, b.n, w.t, w.proof FROM walk w JOIN subs b ON b.source_key = w.k WHERE w.n = 1
  UNION ALL SELECT w.rid, w.k, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(s.l || w.t || s.r), w.proof || s.l || s.r FROM walk2 w JOIN top_sib s ON s.k = w.k AND s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1)
SELECT o.doc_id, o.leaf, b.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.t AS folded_root, w.t = t.h AS verified
FROM own o JOIN walk2 w ON w.rid = o.rid AND w.n = 1 JOIN subs b ON b.source_key = o.k CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""


def _assigned_sql(book: str) -> str:
    return f"""SELECT rid, p.i, any_value(p.x) AS x, min({{'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda t: (p.x[t] - c.x[t]) * (p.x[t] - c.x[t])))::BIGINT, 'j': c.j}}) AS best FROM parts p JOIN {book} c ON c.i = p.i GROUP BY rid, p.i"""


def _learned_sql(old: str, assigned: str) -> str:
    means = ", ".join(f"floor(sum(x[{t}]) / count(*))::BIGINT" for t in range(1, 5))
    return f"SELECT c.i, c.j, coalesce(m.x, c.x) AS x FROM {old} c LEFT JOIN (SELECT i, best.j AS j, [{means}] AS x FROM {assigned} GROUP BY 1, 2) m USING (i, j)"


#: For vectors of 64 components.
CODES = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, i, e[4 * i + 1 : 4 * i + 4] AS x FROM v, range(16) r(i)),
c0 AS (SELECT i, rid - 1 AS j, x FROM parts WHERE rid <= 64),
a0 AS ({_assigned_sql("c0")}), c1 AS ({_learned_sql("c0", "a0")}), a1 AS ({_assigned_sql("c1")}), c2 AS ({_learned_sql("c1", "a1")}), a2 AS ({_assigned_sql("c2")}),
coded AS (SELECT rid, string_agg(format('{{:02x}}', best.j), '' ORDER BY i) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT v.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY i, j)) FROM c2) AS codebooks_sha256 FROM v JOIN coded c USING (rid)
"""

MIX = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '>') AS k, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS shuffle FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w FROM d GROUP BY k),
total AS (SELECT sum(source_size)::BIGINT AS t FROM s),
r AS (SELECT 3 * source_size / w::DOUBLE AS limit_ FROM s UNION SELECT -1),
units AS (SELECT limit_, ((SELECT t FROM total) - coalesce((SELECT sum(3 * source_size) FROM s WHERE 3 * source_size / w::DOUBLE <= limit_), 0))::DOUBLE / (SELECT sum(w) FROM s WHERE 3 * source_size / w::DOUBLE > limit_) AS unit FROM r),
unit AS (SELECT coalesce((SELECT arg_min(unit, limit_) FROM units WHERE unit IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE 3 * source_size / w::DOUBLE > limit_ AND 3 * source_size <= unit * w)), 0) AS unit),
q AS (SELECT d.*, s.source_size, least((3 * s.source_size)::DOUBLE, (SELECT unit FROM unit) * s.w) AS target, (sum(size) OVER (PARTITION BY k ORDER BY shuffle, doc_id, size, rid) - size)::BIGINT AS before FROM d JOIN s USING (k))
SELECT doc_id, size, source_size, target, (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - before - source_size)) + greatest(0, least(size, floor(target)::BIGINT - before - 2 * source_size)))::BIGINT AS taken FROM q
"""

ORACLE_SQL = {
    "op1_quality_rules": QUALITY,
    "op3_line_dedup": LINES,
    "op8_substring_dedup": SUBSTRINGS,
    "op9_warc_revisits": WARC,
    "op10_nearest_neighbours": NEIGHBOURS,
    "op11_merkle_manifest": MERKLE,
    "op12_vector_codes": CODES,
    "op13_source_mix": MIX,
}
