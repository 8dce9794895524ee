"""SQL that gives the same rows as the queries, for those that SQL can express at the size of the correctness check."""

from __future__ import annotations

from .mixing import BLOCK, SPAN, STEP
from .quality import BITS, PRIOR_DOCS, RULES, WINDOW

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: CRC-32 of a text's bytes, by the usual table, which is built from its rule
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"""
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"

OP6 = f"""WITH {CRC_TABLE}, d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {CRC} AS text_crc32 FROM documents, crc_table),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST((2 * start + size) * 40 // (2 * total) AS INT) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""

OP8 = f"""WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][sid % 3 + 1] AS weight, source_size * 2e0 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 15e-1 - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, struct_pack(r := cap / weight, s := sid)) AS level FROM l WHERE level * weight <= cap),
b AS MATERIALIZED (SELECT *, coalesce(sum(blocks) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(blocks) OVER () AS total FROM (SELECT *, CAST(ceil(quota / {BLOCK}) AS BIGINT) AS blocks
FROM (SELECT source, sid, source_size, target, CAST(floor(target + 5e-1) AS BIGINT) AS quota FROM (SELECT source, sid, source_size, least(cap, f.level * weight) AS target FROM l, f)))),
p AS MATERIALIZED (SELECT row_number() OVER () AS rid, d.*, sid, source_size, target, quota, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
n AS (SELECT unnest(range((SELECT CAST(coalesce(max(total), 0) AS BIGINT) FROM b))) AS slot),
i AS MATERIALIZED (SELECT slot, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM (SELECT slot, slot % {SPAN} * {STEP} % {SPAN} * (total / {SPAN}e0) AS point, sid, blocks, first FROM n, b) WHERE point >= first AND point < first + blocks),
m AS (SELECT sid, blocks, total, unnest(range(coalesce(given, 0), blocks)) AS block FROM b LEFT JOIN (SELECT sid, count(*) AS given FROM i GROUP BY sid) USING (sid)),
o AS (SELECT slot, sid, block FROM i WHERE block < blocks UNION ALL SELECT CAST(total AS BIGINT) + block * 1048576 + sid, sid, block FROM m),
q AS (SELECT rid, sid, a + k * source_size AS start, least(a + k * source_size + size, quota) AS stop FROM p, range(2) AS r(k) WHERE least(a + k * source_size + size, quota) > a + k * source_size),
c AS (SELECT rid, sid, start, stop, unnest(range(CAST(start // {BLOCK} AS BIGINT), CAST((stop - 1) // {BLOCK} AS BIGINT) + 1)) AS block FROM q),
e AS (SELECT rid, sum(least(stop, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})) AS taken, min(slot) AS first_slot, count(*) AS n_pieces FROM c JOIN o USING (sid, block) GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot, coalesce(n_pieces, 0) AS n_pieces FROM p LEFT JOIN e USING (rid)"""

_FEATURES = ", ".join(f"{a} * 1000 // greatest({b}, 1) AS {name}" for name, a, b, _ in RULES)
_NAMES = ", ".join(f"'{name}'" for name, *_ in RULES)
_VALUES = ", ".join(name for name, *_ in RULES)
_LIMITS = ", ".join(f"max(cutoff) FILTER (feature = '{name}') AS max_{name}" for name, *_ in RULES)
_GOOD = " AND ".join(f"{name} <= max_{name}" for name, *_ in RULES)
_PERCENT = "CASE feature " + " ".join(f"WHEN '{name}' THEN {percent}" for name, _, _, percent in RULES) + " END"


def _cutoffs(sketch: str, keys: str) -> str:
    by = f"{keys}, feature" if keys else "feature"
    grouped = f"SELECT {by}, value, sum(n) AS n FROM {sketch} GROUP BY {by}, value"
    running = f"SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {by}) AS docs FROM ({grouped})"
    return f"SELECT {by}, max(docs) AS docs, 3 * min(value) FILTER (upto * 100 >= docs * {_PERCENT}) - 2 * min(value) FILTER (upto * 100 >= docs * 50) AS cutoff FROM ({running}) GROUP BY {by}"


OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g), range({WINDOW}) AS k(j) WHERE c > 1 GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (rid)),
x AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, {_FEATURES} FROM c),
u AS (SELECT lang, source, unnest([{_NAMES}]) AS feature, CAST(unnest([{_VALUES}]) AS BIGINT) AS v FROM x WHERE NOT base_failed),
fine AS (SELECT lang, source, feature, v - v % CAST(pow(2, greatest(length(bin(v)) - {BITS}, 0)) AS BIGINT) AS value, count(*) AS n FROM u GROUP BY ALL),
s AS ({_cutoffs('fine', 'lang, source')}), l AS ({_cutoffs('fine', 'lang')}), o AS ({_cutoffs('fine', '')}),
t AS (SELECT lang, source, {_LIMITS} FROM (SELECT s.lang, s.source, feature, (s.docs * s.cutoff + {PRIOR_DOCS} * ((l.docs * l.cutoff + {PRIOR_DOCS} * o.cutoff) // (l.docs + {PRIOR_DOCS}))) // (s.docs + {PRIOR_DOCS}) AS cutoff
FROM s JOIN l USING (feature) JOIN o USING (feature) WHERE s.lang IS NOT DISTINCT FROM l.lang) GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce({_GOOD}, false) AS kept
FROM x LEFT JOIN t ON x.lang IS NOT DISTINCT FROM t.lang AND x.source IS NOT DISTINCT FROM t.source"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS grams FROM d),
k AS MATERIALIZED (SELECT doc_id, len(grams) AS n, md5(array_to_string(grams, chr(10))) AS node, grams FROM s),
e AS MATERIALIZED (SELECT node, any_value(n) AS n, any_value(grams) AS grams, min(doc_id) AS low FROM k WHERE n > 0 GROUP BY node),
g AS MATERIALIZED (SELECT node, n, unnest(grams) AS gram FROM e),
linked AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT node AS a, node AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
c AS (SELECT a AS node, min(e.low) AS component_id FROM reach JOIN e ON e.node = reach.b GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM k LEFT JOIN c ON c.node = k.node AND k.n > 0"""

_TURN = "coalesce(role, ''), coalesce(text, '')"
OP11 = f"""WITH {CRC_TABLE}, n AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {CRC.replace("coalesce(text, '')", "CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT conv_id, max(pos) AS n FROM n GROUP BY conv_id), crc_table),
b AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS head FROM c LEFT JOIN c o ON o.conv_id = c.base),
t AS (SELECT b.conv_id, pos AS depth, role, text FROM b JOIN n ON n.conv_id = b.base AND pos <= head UNION ALL SELECT b.conv_id, head + pos - h, role, text FROM b JOIN n ON n.conv_id = b.conv_id AND pos > h),
p AS MATERIALIZED (SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS bytes FROM c UNION ALL SELECT conv_id, depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)), strlen(text) FROM t),
m AS MATERIALIZED (SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, max(bytes) AS bytes FROM p GROUP BY depth, prefix),
path AS MATERIALIZED (SELECT conv_id, depth, node, n_convs, m.bytes, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p JOIN m USING (depth, prefix)),
x AS MATERIALIZED (SELECT m.depth, m.node, m.n_convs, m.bytes, o.node AS parent FROM m LEFT JOIN path o ON o.conv_id = m.node AND o.depth = m.depth - 1),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM x WHERE depth > 0 GROUP BY ALL),
y AS MATERIALIZED (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN k USING (depth, node)),
a AS (SELECT path.depth, path.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.bytes) AS saved FROM y JOIN path ON path.conv_id = y.node AND path.depth <= y.depth GROUP BY ALL),
e AS (SELECT depth, node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM path WHERE last GROUP BY ALL)
SELECT node AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM y JOIN a USING (depth, node) LEFT JOIN e USING (depth, node)"""

OP12 = """WITH RECURSIVE r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS MATERIALIZED (SELECT rid, x FROM r WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.rid <> b.rid AND len(a.x) = len(b.x) AND CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) END >= 0.95e0),
c AS (SELECT rid AS a, rid AS b FROM r UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT a AS rid, min(vec_id) AS component_id FROM c JOIN r ON r.rid = c.b GROUP BY 1), n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM r JOIN m USING (rid) LEFT JOIN n USING (rid)"""

_P = "1 + 1000000000 * (CAST({} AS HUGEINT) + 1) // greatest({} + n_terms, 1)"
OP13 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS n_terms, CAST(sum(total) AS HUGEINT) AS n_lang FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(n_terms, 0) AS n_terms, coalesce(n_lang, 0) AS n_lang, CAST(coalesce(s.n, 0) AS HUGEINT) AS n_group FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "n_group")} AS p, {_P.format("total", "n_lang")} AS q FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
o AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(o.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 200"""

ORACLES = {"op5_quality": OP5, "op6_sharding": OP6, "op8_mixing": OP8, "op9_ngram_join": OP9, "op11_prefix_trie": OP11, "op12_vector_dedup": OP12, "op13_divergence": OP13}
