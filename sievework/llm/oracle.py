"""DuckDB SQL for the rows of those numbered operators that SQL can express."""

from __future__ import annotations

#: Of each document: words as the operators take them (null: none).
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


def _window(unit: str, length: int, joined: str) -> str:
    """CTEs that join `length` consecutive units of one document, by sums of powers of two: u(doc_id, i, x) to win(doc_id, i, w)."""
    steps, size, last = [], 1, unit
    while 2 * size <= length:
        steps.append(f"p{2 * size} AS (SELECT *, x{size} || {joined} || lead(x{size}, {size}) OVER (PARTITION BY doc_id ORDER BY i) AS x{2 * size} FROM {last})")
        last, size = f"p{2 * size}", 2 * size
    parts, at = [], 0
    while at < length:
        if at + size <= length:
            parts.append(f"x{size}" if at == 0 else f"lead(x{size}, {at}) OVER (PARTITION BY doc_id ORDER BY i)")
            at += size
        else:
            size //= 2
    return ", ".join([*steps, f"win AS (SELECT doc_id, i, x1, {f' || {joined} || '.join(parts)} AS w FROM {last})"])


def _covered(length: int) -> str:
    """From win: cov(doc_id, i, x1, gone), gone where a window covers i that also starts in a document with a smaller id."""
    return f"""late AS (SELECT doc_id, i, x1, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS late FROM win),
cov AS (SELECT doc_id, i, x1, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM late)"""


OP1 = f"""
WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS units FROM documents),
u AS (SELECT doc_id, unnest(units) AS x1, generate_subscripts(units, 1) AS i FROM b),
{_window("u", 50, "''")},
{_covered(50)},
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM cov),
done AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(x1, '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT b.doc_id, len(b.units) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN done USING (doc_id)
"""

OP4 = f"""
WITH b AS (SELECT doc_id, {_WORDS.format(text="text")} AS units FROM documents),
u AS (SELECT doc_id, unnest(units) AS x1, generate_subscripts(units, 1) AS i FROM b),
{_window("u", 50, "' '")},
{_covered(50)},
done AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x1, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT b.doc_id, len(b.units) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM b LEFT JOIN done USING (doc_id)
"""

_REACH = """reach AS (SELECT a AS id, b AS c FROM links WHERE b < a UNION SELECT links.a, reach.c FROM reach JOIN links ON links.b = reach.id WHERE reach.c < links.a),
least AS (SELECT id, min(c) AS c FROM (SELECT * FROM reach UNION ALL SELECT a, a FROM links) GROUP BY id)"""

OP3 = f"""
WITH RECURSIVE b AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS units FROM documents),
u AS (SELECT doc_id, unnest(units) AS x1, generate_subscripts(units, 1) AS i FROM b),
{_window("u", 5, "' '")},
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, w FROM win WHERE w IS NOT NULL UNION ALL SELECT doc_id, array_to_string(units, ' ') FROM b WHERE len(units) BETWEEN 1 AND 4),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.w = y.w AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS MATERIALIZED (SELECT a, b FROM overlap JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_REACH}
SELECT b.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(least.c, b.doc_id) AS component_id
FROM b LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.id = b.doc_id
"""

OP6 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
u AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda e: e / r) AS x FROM v WHERE r > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id WHERE list_inner_product(p.x, q.x) >= 0.9),
{_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least.c, e.vec_id) AS component_id, coalesce(least.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.id = e.vec_id
"""

#: CTE crc(t): the table of CRC-32 by its rule; _crc32 of a list of bytes.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc32(text: str) -> str:
    units = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {units}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _p(count: str, total: str) -> str:
    return f"(1 + 1000000000::HUGEINT * ({count} + 2) // ({total} + 2 * v))"


OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
lang_size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
had AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(s.total, 0) AS lang_total, coalesce((SELECT sum(n) FROM had WHERE had.lang = g.lang AND had.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN lang_size s USING (lang)),
each AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, {_p("coalesce(h.n, 0)", "g.total")} AS p, {_p("k.n", "g.lang_total")} AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM each x JOIN each y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
valued AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM each WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM valued)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12 = rf"""
WITH {_CRC_TABLE},
own AS MATERIALIZED (SELECT conv_id, list(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || '/' || strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT own.conv_id, own.turns, coalesce(base.turns, []) AS base, ({_crc32("own.conv_id::VARCHAR")} % 9)::INT AS h FROM crc, own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 5),
whole AS MATERIALIZED (SELECT conv_id, list_concat(base[1:h], turns[h + 1:]) AS turns FROM headed),
steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM whole),
spot AS MATERIALIZED (SELECT conv_id, depth, array_to_string(turns[1:depth], ',') AS node, CASE WHEN depth > 0 THEN array_to_string(turns[1:depth - 1], ',') END AS above, CASE WHEN depth > 0 THEN split_part(turns[depth], '/', 2)::BIGINT ELSE 0 END AS size, depth = len(turns) AS ends FROM steps),
node AS MATERIALIZED (SELECT node, any_value(above) AS above, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n, min(conv_id) AS conv_id, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM spot GROUP BY node),
child AS MATERIALIZED (SELECT above AS node, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above),
line AS (SELECT DISTINCT a.node AS top, b.node FROM spot a JOIN spot b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
under AS (SELECT top, count(*) FILTER (child.n IS NULL) AS n_leaves, sum((node.n - 1) * node.size) AS saved FROM line JOIN node USING (node) LEFT JOIN child USING (node) GROUP BY top)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children, under.n_leaves, under.saved::BIGINT AS saved_tokens, sha256(node.ids) AS ends_sha256
FROM node JOIN under ON under.top = node.node LEFT JOIN child ON child.node = node.node LEFT JOIN node up ON up.node = node.above
"""

_DRAW = "-ln((('0x' || substr(md5(key || '/' || path), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight"

OP13 = rf"""
WITH {_CRC_TABLE},
straw(old, parent, path, weight, shard) AS (VALUES
  (true, '', '0/r0', 4.0::DOUBLE, -1), (true, '', '0/r1', 4.0, -1), (false, '', '1/r1', 1.0, -1),
  (true, '0/r0', '0/r0/k0', 2.0, -1), (true, '0/r0', '0/r0/k1', 2.0, -1), (true, '0/r1', '0/r1/k0', 2.0, -1), (true, '0/r1', '0/r1/k1', 2.0, -1), (false, '1/r1', '1/r1/k2', 1.0, -1),
  (true, '0/r0/k0', '0/r0/k0/0', 1.0, 0), (true, '0/r0/k0', '0/r0/k0/1', 1.0, 1), (true, '0/r0/k1', '0/r0/k1/2', 1.0, 2), (true, '0/r0/k1', '0/r0/k1/3', 1.0, 3),
  (true, '0/r1/k0', '0/r1/k0/4', 1.0, 4), (true, '0/r1/k0', '0/r1/k0/5', 1.0, 5), (true, '0/r1/k1', '0/r1/k1/6', 1.0, 6), (true, '0/r1/k1', '0/r1/k1/7', 1.0, 7), (false, '1/r1/k2', '1/r1/k2/8', 1.0, 8)),
grown AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key, g AS more FROM documents, (VALUES (false), (true)) v(g)),
region AS (SELECT key, more, arg_min(path, {_DRAW}) AS won FROM grown JOIN straw ON parent = '' AND (old OR more) GROUP BY key, more),
rack AS (SELECT key, more, arg_min(path, {_DRAW}) AS won FROM region JOIN straw ON parent = region.won GROUP BY key, more),
leaf AS (SELECT key, more, arg_min(shard, {_DRAW}) AS shard FROM rack JOIN straw ON parent = rack.won GROUP BY key, more),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32, substr(md5('slot/' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS bucket FROM documents, crc)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY bucket, d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, b.shard AS grown_shard
FROM d JOIN leaf a ON a.key = coalesce(d.doc_id::VARCHAR, '') AND NOT a.more JOIN leaf b ON b.key = a.key AND b.more
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op3_ngram_jaccard": OP3,
    "op4_substring_dedup": OP4,
    "op6_embedding_near_dedup": OP6,
    "op11_source_divergence": OP11,
    "op12_conversation_trie": OP12,
    "op13_sharding": OP13,
}
