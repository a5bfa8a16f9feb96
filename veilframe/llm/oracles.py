"""SQL for the operators that it can express, over whole tables and texts."""

from __future__ import annotations

from veilframe.llm.lines import UnitParams
from veilframe.llm.rules import COMMON, RuleParams

P = RuleParams()
SPACE = "[\\x20\\x09-\\x0D]+"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


COMMON_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in COMMON.items()) + " ELSE list_transform(range(16), lambda i: '') END"


def _jsd(p: str, q: str) -> str:
    share = lambda a: f"list_transform({a}, lambda x: x::DOUBLE / list_sum({a}))"
    half = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END))"
    return f"sqrt(greatest(0, ({half(share(p), share(q))} + {half(share(q), share(p))}) / 2))"


KNOWN_WORDS = _list(sorted({w for ws in COMMON.values() for v in ws for w in (v, v.capitalize())}))

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT row_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
f AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, i + unnest(range(5)) AS p FROM f) GROUP BY 1),
c AS (SELECT w.row_id, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(text, '[a-z]+', '', 'g')) AS n1, length(regexp_replace(text, '[a-z\\x20\\x09-\\x0D]+', '', 'g')) AS n2, length(regexp_replace(text, '[a-zA-Z\\x20\\x09-\\x0D]+', '', 'g')) AS n3,
  length(regexp_replace(text, '[a-zA-Z\\x20\\x09-\\x0D]+|[^\\x00-\\x7F]+', '', 'g')) AS n4, length(regexp_replace(text, '[a-zA-Z0-9\\x20\\x09-\\x0D]+|[^\\x00-\\x7F]+', '', 'g')) AS n5, length(text) AS n0,
  list_transform(list_filter(ws, lambda x: list_contains({KNOWN_WORDS}, x)), lambda x: lower(x)) AS cl, {COMMON_CASE} AS own
  FROM w LEFT JOIN r ON r.row_id = w.row_id),
h AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [n0 - n1, n1 - n2, n2 - n3, n3 - n4, n4 - n5, n_symbols, n5 - n_symbols] AS chars,
  list_transform(own, lambda v: len(list_filter(cl, lambda x: x = v))::BIGINT) AS cw FROM c),
k AS (SELECT *, list_append(cw, n_words - list_sum(cw)::BIGINT) AS common FROM h),
ref AS (SELECT lang AS ref_lang, [{", ".join(f"sum(chars[{i}])" for i in range(1, 8))}] AS ref_chars, [{", ".join(f"sum(common[{i}])" for i in range(1, 18))}] AS ref_common
  FROM k WHERE NOT base_failed AND n_words >= {P.min_words} AND lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {P.min_reference}),
pool AS (SELECT [{", ".join(f"sum(chars[{i}])" for i in range(1, 8))}] AS all_chars FROM k WHERE NOT base_failed AND n_words >= {P.min_words} HAVING count(*) >= {P.min_reference}),
j AS (SELECT k.*, CASE WHEN n_words >= {P.min_words} AND coalesce(ref_chars, all_chars) IS NOT NULL THEN {_jsd("chars", "coalesce(ref_chars, all_chars)")} END AS cd, CASE WHEN ref_lang IS NOT NULL AND n_words >= {P.min_words} THEN {_jsd("common", "ref_common")} END AS wd
  FROM k LEFT JOIN ref ON lang = ref_lang LEFT JOIN pool ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND coalesce(cd <= {P.max_char_distance}, true) AND coalesce(wd <= {P.max_word_distance}, true) AS kept FROM j
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 0 END))) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS root, b AS doc FROM e UNION SELECT reach.root, e.b FROM reach JOIN e ON e.a = reach.doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(root), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.doc = d.doc_id GROUP BY d.doc_id, n.n
"""

#: Words with their places and weights, windows at the first smallest weights, lines, and what the earliest of each leaves.
W = UnitParams().window_words
UNIT_DEDUP = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> '')),
ls AS (SELECT r, generate_subscripts(l, 1) AS ln, unnest(l) AS line FROM (SELECT r, string_split(translate(text, chr(9) || chr(11) || chr(12) || chr(13), '    '), chr(10)) AS l FROM d)),
lo AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l0 FROM ls),
ps AS (SELECT r, ln, l0, generate_subscripts(p, 1) AS pn, unnest(p) AS piece FROM (SELECT *, string_split(line, ' ') AS p FROM lo)),
po AS (SELECT *, l0 + coalesce(sum(length(piece) + 1) OVER (PARTITION BY r, ln ORDER BY pn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM ps),
w AS MATERIALIZED (SELECT r, ln, row_number() OVER (PARTITION BY r ORDER BY ln, pn) AS i, translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, a::BIGINT AS a, (a + length(piece))::BIGINT AS z FROM po WHERE piece <> ''),
v AS MATERIALIZED (SELECT w, list_sum(list_transform(range(1, length(h) // 2 + 1), lambda k: k * (16 * (instr('0123456789ABCDEF', h[2 * k - 1]) - 1) + instr('0123456789ABCDEF', h[2 * k]) - 1)))::BIGINT * 2654435769 % 4294967296 AS v
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w))),
m AS MATERIALIZED (SELECT r, i, min(v * 1000000 + i) OVER n % 1000000 AS least, count(*) OVER n AS n, string_agg(w, ' ') OVER n AS words, max(z) OVER n AS z, a FROM w JOIN v USING (w)
  WINDOW n AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
u AS MATERIALIZED (SELECT r, 0 AS kind, string_agg(w, ' ' ORDER BY i) AS words, min(a) AS a, max(z) AS z FROM w GROUP BY r, ln
  UNION ALL SELECT m.r, 1, m.words, m.a, m.z FROM m JOIN (SELECT DISTINCT r, least FROM m WHERE n = {W}) x ON x.r = m.r AND x.least = m.i WHERE m.n = {W}),
k AS (SELECT kind, words, min(struct_pack(r := r, a := a, z := z)) AS k FROM u GROUP BY 1, 2),
c AS (SELECT u.r, CASE WHEN u.r = k.k.r THEN greatest(u.a, k.k.z) ELSE u.a END AS a, u.z, k.k.r AS kr, k.k.a AS ka FROM u JOIN k ON k.kind = u.kind AND k.words = u.words WHERE u.r <> k.k.r OR u.a <> k.k.a),
o AS (SELECT c.r, a, z, doc_id AS kd, ka, row_number() OVER (PARTITION BY c.r ORDER BY a, z DESC, doc_id, ka) AS nr FROM c JOIN d ON d.r = kr WHERE a < z),
e AS (SELECT *, coalesce(max(z) OVER (PARTITION BY r ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
g AS (SELECT *, sum(CASE WHEN nr = 1 OR a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY nr) AS g FROM e),
s AS (SELECT r, g, min(a) AS a, max(z) AS z, arg_min(kd, nr) AS kd, arg_min(ka, nr) AS ka, min(before) FILTER (nr = 1 OR a >= before) AS before FROM g GROUP BY 1, 2),
f AS (SELECT s.r, string_agg(s.a || ':' || (s.z - s.a) || ':' || kd || ':' || ka, ' ' ORDER BY s.a) AS removed, string_agg(substr(text, before + 1, s.a - before), '' ORDER BY s.a) || substr(any_value(text), max(s.z) + 1) AS left_text
  FROM s JOIN d ON d.r = s.r GROUP BY 1)
SELECT x.doc_id, CASE WHEN removed IS NULL THEN x.text WHEN regexp_matches(left_text, '[^\\x20\\x09-\\x0D]') THEN left_text ELSE '' END AS text, coalesce(removed, '') AS removed
FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id AND d.text = x.text LEFT JOIN f ON f.r = d.r
"""

ORACLES = {"op2_quality_rules": QUALITY_RULES, "op9_ngram_jaccard_join": JACCARD, "op10_unit_dedup": UNIT_DEDUP}
