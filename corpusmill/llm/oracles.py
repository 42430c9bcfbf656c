"""DuckDB SQL for the numbered queries that SQL can express on whole tables."""

from __future__ import annotations

from corpusmill.llm import quality_rules as rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_PLAIN}) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u,
    CASE WHEN length(text) > 0 THEN greatest(0.05, (1 - least(1.0, 5.0 * (length(text) - length(translate(text, '#*$%&|<>!{{}}', ''))) / length(text))) ** 2) ELSE 0.05 END AS w
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS sw, 2.0 * source_size AS most FROM s),
f AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(sw) OVER () - coalesce(sum(sw) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY most / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(level ORDER BY most / sw, source NULLS LAST) FILTER (level * sw <= most) AS found FROM f),
t AS (SELECT source, source_size, least(most, coalesce(found * sw, most)) AS target FROM f, l),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(target - passes * source_size) - coalesce(sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM p"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
lens AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
hit AS (SELECT rid, i, k, item FROM dw JOIN win USING (k, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
s AS (SELECT doc_id, list(g ORDER BY g) AS gs, count(*) AS n FROM g GROUP BY doc_id),
rep AS (SELECT gs, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM s GROUP BY gs),
rg AS (SELECT rep.rep, copies, n, g FROM rep JOIN g ON g.doc_id = rep.rep),
p AS (SELECT x.rep AS a, y.rep AS b, any_value(y.copies) AS copies FROM rg x JOIN rg y ON x.g = y.g AND x.rep <> y.rep GROUP BY x.rep, y.rep
  HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*))),
c(v, c) AS (SELECT rep, rep FROM rep UNION SELECT p.b, c.c FROM c JOIN p ON p.a = c.v),
k AS (SELECT v AS rep, min(c) AS class_id FROM c GROUP BY v),
z AS (SELECT class_id, sum(copies) AS class_size FROM k JOIN rep USING (rep) GROUP BY class_id),
l AS (SELECT a AS rep, sum(copies) AS linked, count(*) AS texts FROM p GROUP BY a),
done AS (SELECT s.doc_id, class_id, CAST(coalesce(linked, 0) + rep.copies - 1 AS BIGINT) AS n_links, coalesce(texts, 0) AS n_text_links, CAST(class_size AS BIGINT) AS class_size
  FROM s JOIN rep ON rep.gs = s.gs JOIN k ON k.rep = rep.rep JOIN z USING (class_id) LEFT JOIN l ON l.rep = rep.rep)
SELECT * FROM done UNION ALL SELECT doc_id, doc_id, 0, 0, 1 FROM d WHERE len(w) = 0"""



def _crc_table() -> str:
    """The table of CRC-32, 8 hexadecimal digits for each byte."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(f"{value:08x}")
    return "".join(out)


_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
_CRC = f"xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda c, b: xor(c >> 8, CAST('0x' || substr('{_crc_table()}', 1 + 8 * (xor(c, b) & 255), 8) AS BIGINT))), 4294967295)"

OP7 = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_CRC} AS text_crc32 FROM documents),
r AS (SELECT *, CAST(coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS before, row_number() OVER o AS rn, CAST(sum(size) OVER () AS HUGEINT) AS total
  FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
p AS (SELECT *, CAST(least((before * 2 + size) * 8 // (2 * total), 7) AS INT) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY rn) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""

_LADDER = ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, (a, b, c, d) in enumerate(rules.LADDER))
_RUNGS = len(rules.LADDER)

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {_PLAIN} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]')) > 0) AS ls FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
h AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
m AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY rid),
f AS (SELECT rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words
  FROM d LEFT JOIN m USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
ladder(rung, a, b, c, e) AS (VALUES {_LADDER}),
x AS (SELECT j.*, coalesce((SELECT min(rung) FROM ladder WHERE 100.0 * n_symbols / greatest(word_chars, 1) > a OR 100.0 * n_dup_lines / greatest(n_words, 1) > b
    OR 100.0 * n_repeat_words / greatest(n_words, 1) > c OR 1.0 * word_chars / greatest(n_words, 1) > e), {_RUNGS}) AS first_rung FROM j),
good AS (SELECT lang, first_rung FROM x JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) WHERE NOT base_failed AND quality = 1),
n AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
t AS (SELECT n.lang, rung, n, (SELECT count(*) FROM good WHERE good.lang = n.lang AND first_rung <= rung) AS k FROM n, ladder),
cdf AS (SELECT lang, rung, n, k, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.MAX_FALSE_REJECTION}) + (n - i) * ln(1 - {rules.MAX_FALSE_REJECTION})))
    FROM range(0, k + 1) r(i)) AS p FROM t),
safe AS (SELECT lang, coalesce(min(rung) FILTER (NOT (k <= n * {rules.MAX_FALSE_REJECTION} AND p <= {rules.ALPHA} / (SELECT count(*) FROM n))), {_RUNGS}) - 1 AS rung FROM cdf GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first_rung > coalesce(safe.rung, -1) AS kept
FROM x LEFT JOIN safe ON safe.lang IS NOT DISTINCT FROM x.lang"""

_DRAW = "CAST('0x' || substr(d, {}, 8) AS BIGINT)"

OP11 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_DRAW.format(1)} % (len(u) + 1) AS a, {_DRAW.format(9)} % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW.format(17)} % 100 >= 90 THEN 'plain'
      WHEN {_DRAW.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1 : least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 :], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_ID_CRC = _CRC.replace("coalesce(text, '')", "CAST(doc_id AS VARCHAR)")

OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_ID_CRC} % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")}) END AS found FROM documents),
l AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM d),
t(g, level, i, n, h) AS (SELECT g, 0, i, n, leaf FROM l UNION ALL SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 3, n),
s AS (SELECT g, h AS subroot, max(level) OVER (PARTITION BY g) AS top FROM t WHERE n = 1),
u(level, i, n, h) AS (SELECT 0, g, (SELECT count(*) FROM s), subroot FROM s UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3, n),
f(g, level, i, n, h) AS (SELECT g, level, i, n, h FROM t WHERE n > 1 UNION ALL SELECT -1, level, i, n, h FROM u WHERE n > 1),
ps AS (SELECT a.g, a.level, a.i, a.i % 3 AS place, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> a.i), '') AS siblings
  FROM f a JOIN f b ON a.g = b.g AND a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY a.g, a.level, a.i),
st AS (SELECT rid, y.level AS k, place, siblings FROM (SELECT rid, l.g, x.level, l.i // CAST(3 ** x.level AS BIGINT) AS at FROM l JOIN (SELECT DISTINCT g, level FROM f) x ON x.g = l.g) y
    JOIN ps ON ps.g = y.g AND ps.level = y.level AND ps.i = y.at
  UNION ALL SELECT rid, s.top + z.level, place, siblings FROM l JOIN s ON s.g = l.g JOIN (SELECT DISTINCT level FROM f WHERE g = -1) z ON true
    JOIN ps ON ps.g = -1 AND ps.level = z.level AND ps.i = l.g // CAST(3 ** z.level AS BIGINT)),
o(rid, k, h) AS (SELECT rid, CAST(0 AS BIGINT), coalesce(found, leaf) FROM l
  UNION ALL SELECT o.rid, o.k + 1, sha256(substr(siblings, 1, 64 * place) || o.h || substr(siblings, 64 * place + 1)) FROM o JOIN st ON st.rid = o.rid AND st.k = o.k),
e AS (SELECT rid, arg_max(h, k) AS folded_root FROM o GROUP BY rid),
q AS (SELECT rid, string_agg(siblings, '' ORDER BY k) AS proof FROM st GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM l JOIN s ON s.g = l.g JOIN e USING (rid) LEFT JOIN q USING (rid)"""

ORACLES = {"op1_mix_sources": OP1, "op3_decontaminate": OP3, "op7_shard": OP7, "op8_jaccard_join": OP8, "op9_quality_rules": OP9, "op11_fill_in_middle": OP11, "op12_merkle_manifest": OP12}
