"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from citesight.llm.url_filter import BINS, CALIBRATION, ORDER, RULES

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b2)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT d.rid, d.w, ks.k, unnest(range(1, len(d.w) - ks.k + 2)) AS i FROM d, ks WHERE len(d.w) >= ks.k)),
m AS (SELECT dg.rid, dg.k, dg.i, win.item_id FROM dg JOIN win USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

_SPACED = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '-') AS host,
                  coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest(range(i, i + 3)) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
c AS (SELECT d.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             len(w) < 50 AS f1, 100 * coalesce(r.n, 0) > 50 * len(w) AS f2
      FROM d LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
h AS (SELECT host, count(*) AS docs, sum(f1::INT) AS n1, sum(f2::INT) AS n2 FROM c GROUP BY host),
p AS (SELECT avg(n1 / docs) AS m1, var_pop(n1 / docs) AS v1, avg(n2 / docs) AS m2, var_pop(n2 / docs) AS v2 FROM h),
q AS (SELECT m1, CASE WHEN v1 > 0 THEN greatest(m1 * (1 - m1) / v1 - 1, 0) ELSE 1e6 END AS s1,
             m2, CASE WHEN v2 > 0 THEN greatest(m2 * (1 - m2) / v2 - 1, 0) ELSE 1e6 END AS s2 FROM p),
k AS (SELECT host, round((n1 + m1 * s1) / (docs + s1), 9) > round(least(m1 + 3 * sqrt(m1 * (1 - m1) / (s1 + 1)), 0.5), 9)
          OR round((n2 + m2 * s2) / (docs + s2), 9) > round(least(m2 + 3 * sqrt(m2 * (1 - m2) / (s2 + 1)), 0.5), 9) AS rejected
      FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT rejected AS kept
FROM c JOIN k USING (host)
"""


def _op2() -> str:
    fits = [(rh, rp, v, f"(host = '{rh}' OR suffix(host, '.{rh}')) AND starts_with(path, '{rp}')")
            for rh, rp, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    name = "CASE " + " ".join(f"WHEN {f} THEN '{rh + rp}'" for rh, rp, _, f in fits) + " END"
    label = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for _, _, v, f in fits) + " END"
    held = ", ".join(f"'{c}'" for c in CALIBRATION)
    sql = [f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, url,
    coalesce({_LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rows_ AS (SELECT rid, page_id, host, path, {name} AS rule, {label} AS label,
    md5(coalesce(url, ''))[1:1] IN ({held}) AS held,
    repeat(chr(2), {ORDER}) || host || path || CASE WHEN contains(url, '://') THEN '' ELSE coalesce(url, '') END || chr(3) AS s
    FROM u),
occ AS (SELECT rid, label, held, substring(s, i, {ORDER + 1}) AS gram
        FROM (SELECT *, unnest(range(1, length(s) - {ORDER} + 1)) AS i FROM rows_)),
g{ORDER} AS (SELECT gram, coalesce(sum((NOT held AND label = 'allow')::INT), 0) AS a,
        coalesce(sum((NOT held AND label = 'block')::INT), 0) AS r FROM occ GROUP BY gram)"""]
    for o in range(ORDER - 1, -1, -1):
        sql.append(f"g{o} AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(r) AS r FROM g{o + 1} GROUP BY 1)")
    for o in range(ORDER + 1):
        stats = (f"SELECT gram, a, r, sum(a) OVER c AS na, sum(r) OVER c AS nr, sum((a > 0)::INT) OVER c AS ta, "
                 f"sum((r > 0)::INT) OVER c AS tr FROM g{o} WINDOW c AS (PARTITION BY substring(gram, 1, {o}))")
        low = ("(SELECT 1.0::DOUBLE / count(*) AS pa, 1.0::DOUBLE / count(*) AS pr FROM g0) l" if o == 0
               else f"p{o - 1} l ON l.gram = substring(t.gram, 2)")
        sql.append(f"""p{o} AS (SELECT t.gram, CASE WHEN na > 0 THEN (a + ta * l.pa) / (na + ta) ELSE l.pa END AS pa,
    CASE WHEN nr > 0 THEN (r + tr * l.pr) / (nr + tr) ELSE l.pr END AS pr
    FROM ({stats}) t {'CROSS JOIN' if o == 0 else 'JOIN'} {low})""")
    sql.append(f"""sc AS (SELECT rid, sum(ln(pa) - ln(pr)) / count(*) AS score FROM occ JOIN p{ORDER} USING (gram) GROUP BY rid),
f AS (SELECT * FROM rows_ JOIN sc USING (rid)),
bins AS (SELECT greatest(least(floor(score * 100), {BINS}), -{BINS}) AS bin, sum((label = 'allow')::INT) AS a,
    sum((label = 'block')::INT) AS r FROM f WHERE held AND label IS NOT NULL GROUP BY 1),
cum AS (SELECT coalesce((bin + lead(bin) OVER w + 1) / 200.0, bin / 100.0) AS cut, sum(a) OVER w * sum(r) OVER () - sum(r) OVER w * sum(a) OVER () AS gain,
    sum(a) OVER () AS aa, sum(r) OVER () AS rr FROM bins WINDOW w AS (ORDER BY bin DESC)),
cut AS (SELECT coalesce((SELECT cut FROM cum WHERE aa > 0 AND rr > 0
    ORDER BY gain DESC, abs(cut), cut DESC LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict,
    round(score, 6) AS score FROM f, cut""")
    return ",\n".join(sql)


OP2 = _op2()

_CTRL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESC = "regexp_replace({}, '" + _CTRL + r"', '\1\\\2\3', 'g')"
OP10 = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, {_ESC.format('text')} AS body,
    {_ESC.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(12 + length(head) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_CRC32 = ("xor(list_reduce([4294967295] || flatten(list_transform(string_split({0}, ''), "
          "lambda s: list_transform(range(8), lambda j: (ascii(s) >> j) & 1))), "
          "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)")
OP11 = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
lens AS (SELECT c, max(p) AS n FROM t GROUP BY c),
convs AS (SELECT l.c, l.c - ((l.c % 5) + 5) % 5 AS base, {_CRC32.format("CAST(l.c AS VARCHAR)")} % 9 AS h FROM lens l),
given AS (SELECT convs.*, least(h, coalesce(n, 0)) AS taken FROM convs LEFT JOIN lens ON lens.c = base),
b AS (SELECT g.c, t.p, r, x FROM given g JOIN t ON t.c = g.base AND t.p <= h
    UNION ALL SELECT t.c, t.p - h + taken, r, x FROM given g JOIN t ON t.c = g.c AND t.p > h),
s AS (SELECT c, p, x, md5(CAST(list(sha256(strlen(r) || ':' || r || x)) OVER (PARTITION BY c ORDER BY p) AS VARCHAR)) AS k FROM b
    UNION ALL SELECT c, 0, '', '' FROM lens),
nodes AS (SELECT p, k, min(c) AS rep, count(*) AS n, any_value(strlen(x)) AS bytes FROM s GROUP BY p, k),
up AS (SELECT nodes.*, s.k AS up FROM nodes LEFT JOIN s ON s.c = rep AND s.p = nodes.p - 1),
kids AS (SELECT p - 1 AS p, up AS k, count(*) AS m FROM up WHERE p > 0 GROUP BY 1, 2),
v AS (SELECT up.*, coalesce(m, 0) AS m FROM up LEFT JOIN kids USING (p, k)),
sums AS (SELECT s.p, s.k, sum((m = 0)::INT) AS leaves, sum((n - 1) * bytes) AS saved
    FROM v JOIN s ON s.c = rep AND s.p <= v.p GROUP BY 1, 2),
ends AS (SELECT p, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e
    FROM s JOIN (SELECT c, max(p) AS p FROM s GROUP BY c) USING (c, p) GROUP BY p, k)
SELECT v.rep AS conv_id, CAST(v.p AS BIGINT) AS depth, pa.rep AS parent_conv_id, v.n AS n_convs, v.m AS n_children,
    CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM v JOIN sums USING (p, k) LEFT JOIN ends USING (p, k) LEFT JOIN nodes pa ON pa.p = v.p - 1 AND pa.k = v.up
"""


def _op13(rounds: int = 10, k: int = 8) -> str:
    near = ("SELECT vec_id, v, list(c ORDER BY d, c)[1] AS c, min(d) AS d FROM (SELECT rid, vec_id, v, c, "
            "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d "
            "FROM ints, c{0}) GROUP BY rid, vec_id, v")
    sql = [f"""
WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
ints AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM
    (SELECT sha256('3:' || vec_id) AS h, v FROM ints ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds):
        sql.append(f"""n{r} AS MATERIALIZED ({near.format(r)}),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(t.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, list(q ORDER BY i) AS m FROM (
    SELECT c, i, (s - ((s % n) + n) % n) // n AS q FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM
        (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM n{r}) GROUP BY c, i)) GROUP BY c) t USING (c))""")
    sql.append(f"""n AS MATERIALIZED ({near.format(rounds)})
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM n JOIN c{rounds} USING (c)""")
    return ",\n".join(sql)


OP13 = _op13()
