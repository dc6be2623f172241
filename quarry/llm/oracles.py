"""DuckDB SQL of the opN_ queries that SQL can express, over the whole tables."""

from __future__ import annotations

from quarry.llm import license, lines, mixing, repeats

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

REPEATS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY substr(h, 2 * p + 1, {2 * repeats.SPAN}) ORDER BY doc_id, p) > 1 AS again FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {repeats.SPAN - 1})) AS p FROM d)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {repeats.SPAN} THEN 0 ELSE 1 END AS head FROM w WHERE again),
r AS (SELECT doc_id, min(p) AS a, max(p) + {repeats.SPAN} AS b FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, b FROM r),
t AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * c >= 85 * (na + nb - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
x AS (SELECT a, b FROM u UNION SELECT x.a, u.b FROM x JOIN u ON x.b = u.a),
m AS (SELECT a, min(b) AS least FROM x GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = s.doc_id
"""


def _pick(values, rank: str) -> str:
    return f"CASE {rank} % {len(values)} " + " ".join(f"WHEN {k} THEN {float(v)!r}::DOUBLE" for k, v in enumerate(values)) + " END"


MIXING = f"""
WITH s AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')) AS o FROM documents),
g AS (SELECT source, sum(size)::DOUBLE AS total FROM s GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM g),
v AS (SELECT *, {_pick(mixing.WEIGHTS, 'rank')} AS weight, total * {mixing.MOST}::DOUBLE AS cap FROM k),
z AS (SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
y AS (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS final FROM z),
t AS (SELECT *, CASE WHEN cap <= weight * level OR final IS NULL THEN cap ELSE weight * final END AS target, {_pick([2 * e[0] / (e[0] + e[1]) for e in mixing.DRIFT], 'rank')} AS a, {_pick([2 * e[1] / (e[0] + e[1]) for e in mixing.DRIFT], 'rank')} AS b FROM y),
f AS (SELECT *, sum(target * a) OVER () / sum(target) OVER () AS all_a, sum(target * b) OVER () / sum(target) OVER () AS all_b FROM t),
d AS (SELECT s.*, f.*, sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source),
p AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total + 1e-12) ELSE 0 END AS passes FROM d),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + (start + 0.5::DOUBLE < target - passes * total)::INT END AS copies, CASE WHEN target > 0 THEN least(1.0::DOUBLE, start / target) ELSE 0.0 END AS share FROM p),
i AS (SELECT *, least(1.0::DOUBLE, 2 * share / (a + sqrt(greatest(a * a + 2 * (b - a) * share, 0.0::DOUBLE)))) AS time FROM c)
SELECT doc_id, size, total::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies, CASE WHEN copies > 0 THEN round(time * (all_a + (all_b - all_a) * time / 2), 9) END AS position FROM i
"""


def _templates() -> str:
    rows = []
    for n, (exact, phrase, label) in enumerate([(True, *x) for x in license.BASE.items()] + [(False, *x) for x in license.NOTICES.items()]):
        parts = phrase.split()
        rows += [f"({n}, '{label}', {exact}, {len(parts) - license.K + 1}, '{' '.join(parts[i : i + license.K])}', {i})" for i in range(len(parts) - license.K + 1)]
    return ", ".join(rows)


LICENSE = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
k(template, label, exact, grams, gram, at_) AS (VALUES {_templates()}),
r AS (SELECT doc_id, unnest(range(0, len(ws) - 2)) AS pos, ws FROM w),
h AS (SELECT doc_id, template, label, exact, grams, pos, at_, pos - at_ AS diagonal FROM (SELECT doc_id, pos, ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3] AS gram FROM r) r JOIN k ON k.gram = r.gram),
v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, template, diagonal) AS votes, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, at_) > {license.GAP} THEN 1 ELSE 0 END AS new_ FROM h),
b AS (SELECT *, sum(new_) OVER (PARTITION BY doc_id, template ORDER BY diagonal, at_ ROWS UNBOUNDED PRECEDING) AS band FROM v),
f AS (SELECT doc_id, template, band, at_, min(pos) AS pos FROM b GROUP BY ALL),
c AS (SELECT doc_id, template, band, count(*) FILTER (WHERE ahead IS NULL OR pos > ahead) AS chain FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id, template, band ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM f) GROUP BY ALL),
s AS (SELECT b.doc_id, label, exact, count(*) FILTER (WHERE exact AND at_ = 0 AND votes = grams) AS places, min(pos) FILTER (WHERE exact AND at_ = 0 AND votes = grams) AS first, max(pos) FILTER (WHERE exact AND at_ = 0 AND votes = grams) AS last, (CASE WHEN exact THEN max(votes) ELSE any_value(chain) END)::DOUBLE / any_value(grams) AS share FROM b JOIN c ON c.doc_id = b.doc_id AND c.template = b.template AND c.band = b.band GROUP BY b.doc_id, b.template, b.band, label, exact),
m AS (SELECT doc_id, sum(places)::BIGINT AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= CASE WHEN exact THEN 1 ELSE {license.COVER} END) AS labels, max(share) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM w LEFT JOIN m ON m.doc_id = w.doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE g AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
v AS MATERIALIZED (SELECT * FROM g WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
x AS (SELECT a, b FROM e UNION SELECT x.a, e.b FROM x JOIN e ON x.b = e.a),
m AS (SELECT a, min(b) AS least FROM x GROUP BY a),
n AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept FROM g LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE_SQL = {"op1_repeats": REPEATS, "op2_jaccard": JACCARD, "op6_mixing": MIXING, "op7_license": LICENSE, "op8_embeddings": EMBEDDINGS, "op10_lines": lines.SQL}
