"""Queries over the citation graph: citation features (F), neighbourhoods (G), labels (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesight.functions.columns import list_len, r6
from citesight.operators import citations as FE
from citesight.plans.registry import register
from citesight.sources import fixtures as fx

W = fx.with_views("works")


@register("f1_yearly_deltas", W + """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, CAST(delta AS INTEGER) AS delta,
  CAST(delta_first AS INTEGER) AS delta_first FROM (
  SELECT id, unnest(d) AS delta, unnest(range(1, len(d) + 1)) AS pos, d[1] AS delta_first FROM (
    SELECT id, list_transform(counts_by_year_years, lambda y: y - year(publication_date)) AS d FROM works))""")
def f1(spark, sf):
    w = FE.yearly_deltas(fx.works(spark, sf))
    return w.select("id", F.posexplode("counts_by_year_delta").alias("pos", "delta"),
                    F.col("counts_by_year_delta_first").alias("delta_first"))


@register("f2_reverse_citations", W + """SELECT id, cited_by_date, count(*) AS n_citing FROM (
  SELECT unnest(referenced_works) AS id, publication_date AS cited_by_date FROM works) GROUP BY 1, 2""")
def f2(spark, sf):
    return FE.reverse_citations(fx.works(spark, sf))


_RC = W + """, rc AS (SELECT ref AS id, publication_date AS cited_by_date FROM (
  SELECT unnest(referenced_works) AS ref, publication_date FROM works)),
summ AS (SELECT id, count(*) AS n_cited_by, min(cited_by_date) AS first_cited_date,
                count(DISTINCT year(cited_by_date)) AS n_years FROM rc GROUP BY id)
"""


@register("f3_attach_citers", _RC + """SELECT w.id, w.cited_by_count, s.n_cited_by,
  w.cited_by_count - s.n_cited_by AS missing FROM works w JOIN summ s ON s.id = w.id""")
def f3(spark, sf):
    w = fx.works(spark, sf)
    s = FE.citation_summary(FE.reverse_citations(w))
    return FE.attach_citers(w, s).select("id", "cited_by_count", "n_cited_by", "missing")


@register("f4_citation_delays", _RC + """, yr AS (SELECT id, year(cited_by_date) AS y, count(*) AS n FROM rc GROUP BY 1, 2),
dl AS (SELECT yr.id, string_agg((y - year(w.publication_date)) || ':' || n, ',' ORDER BY y) AS deltas
       FROM yr JOIN works w ON w.id = yr.id GROUP BY yr.id)
SELECT w.id, dl.deltas,
  CAST(year(s.first_cited_date) - year(w.publication_date) AS INTEGER) AS cited_by_delta_years_first,
  CAST(s.first_cited_date - w.publication_date AS INTEGER) AS cited_by_delta_days_first,
  CAST(s.n_years AS INTEGER) AS n_years
FROM works w JOIN summ s ON s.id = w.id JOIN dl ON dl.id = w.id""")
def f4(spark, sf):
    out = FE.engineer(fx.works(spark, sf))
    deltas = F.transform("cited_by_delta_years", lambda s: F.concat_ws(":", s["delta"].cast("string"), s["n"].cast("string")))
    return out.select("id", F.array_join(deltas, ",").alias("deltas"), "cited_by_delta_years_first",
                      "cited_by_delta_days_first", list_len("cited_by_delta_years").alias("n_years"))


_F5 = W + """, pts AS (
  SELECT id, CAST(v AS BIGINT) AS v, CAST(w AS DOUBLE) AS w FROM (
    SELECT id, unnest(list_transform(counts_by_year_years, lambda y: y - year(publication_date))) AS v,
           unnest(counts_by_year_counts) AS w FROM works WHERE counts_by_year_years IS NOT NULL)),
near AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY v RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 2 AS core
         FROM pts),
c0 AS (SELECT id, v, CASE WHEN lag(v) OVER (PARTITION BY id ORDER BY v) IS NULL
                            OR v - lag(v) OVER (PARTITION BY id ORDER BY v) > 1 THEN 1 ELSE 0 END AS nc
       FROM near WHERE core),
cores AS (SELECT id, v, sum(nc) OVER (PARTITION BY id ORDER BY v ROWS UNBOUNDED PRECEDING) - 1 AS cid FROM c0),
lab AS (
  SELECT n.id, n.v, n.w, n.core, c.cid,
    last_value(CASE WHEN n.core THEN n.v END IGNORE NULLS) OVER (PARTITION BY n.id ORDER BY n.v
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
    last_value(CASE WHEN n.core THEN c.cid END IGNORE NULLS) OVER (PARTITION BY n.id ORDER BY n.v
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lc,
    first_value(CASE WHEN n.core THEN n.v END IGNORE NULLS) OVER (PARTITION BY n.id ORDER BY n.v
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv,
    first_value(CASE WHEN n.core THEN c.cid END IGNORE NULLS) OVER (PARTITION BY n.id ORDER BY n.v
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rc
  FROM near n LEFT JOIN cores c ON c.id = n.id AND c.v = n.v),
lab2 AS (SELECT id, v, w, CASE WHEN core THEN cid WHEN lv IS NOT NULL AND v - lv <= 1 THEN lc
                               WHEN rv IS NOT NULL AND rv - v <= 1 THEN rc END AS cluster FROM lab),
pw AS (SELECT id, CAST(coalesce(max(cluster) + 1, 0) AS BIGINT) AS n_clusters,
              CASE WHEN sum(w) > 0 THEN sum(CASE WHEN cluster IS NULL THEN w ELSE 0 END) / sum(w) ELSE 0 END
                AS noise_ratio FROM lab2 GROUP BY id),
pc AS (SELECT id, CAST(cluster AS BIGINT) AS cluster, sum(v * w) / sum(w) AS centroid, count(*) AS n_members
       FROM lab2 WHERE cluster IS NOT NULL GROUP BY id, cluster)
SELECT pw.id, pw.n_clusters, round(pw.noise_ratio, 6) AS noise_ratio, pc.cluster, round(pc.centroid, 6) AS centroid,
       pc.n_members FROM pw LEFT JOIN pc ON pc.id = pw.id"""


@register("f5_citation_bursts", _F5)
def f5(spark, sf):
    w = FE.yearly_deltas(fx.works(spark, sf))
    b = FE.citation_bursts(w, eps=1, min_weight=2)
    return b.select("id", "n_clusters", r6("noise_ratio").alias("noise_ratio"), "cluster",
                    r6("centroid").alias("centroid"), "n_members")


# ------------------------------------------------------------------ neighbourhoods (G)
from citesight.operators import labels as L  # noqa: E402
from citesight.sources import io as S  # noqa: E402
from citesight.operators import neighbours as G  # noqa: E402


def graph_corpus(spark, sf):
    """Works with their embedding vector as feature ``emb``; the derived works table is built once."""
    w = S.stage_table(fx.works(spark, sf))
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    return w.join(e, "vec_id")


def vectors_md5(entries):
    """Digest of all entries of a vector, to compare it whole."""
    return F.md5(F.array_join(F.transform(entries, lambda v: F.floor(v.cast("double") * 1e6).cast("string")), ","))


#: The same for a list of vectors.
GX_SQL = "md5(array_to_string(list_transform(flatten({}), lambda v: CAST(floor(CAST(v AS DOUBLE) * 1e6) AS BIGINT)), ','))"

# small fair shares: the hub work of the fixture takes the salted path
SPEC_EDGES = G.GraphSpec(t_end="2000-01-01", top_k=5, hot_partitions=64, hot_min_rows=20)
SPEC_TABLE = G.GraphSpec(t_start="1998-01-01", t_end="2000-01-01", top_k=3, hot_partitions=64, hot_min_rows=20,
                         predicate="cited_by_count >= 1 AND size(referenced_works) >= 5")

_GC = W + """, corpus AS (
  SELECT w.id, w.publication_date, w.referenced_works, w.topic_name, w.subfield_name, w.score, w.cited_by_count,
         e.embedding AS emb
  FROM works w JOIN embeddings e ON e.vec_id = w.vec_id
  WHERE w.referenced_works IS NOT NULL AND w.publication_date < DATE '2000-01-01'{pred}),
targets AS (SELECT * FROM corpus{tstart}),
edges AS (SELECT id, topic_name, subfield_name, unnest(referenced_works) AS ref FROM targets),
e2 AS (SELECT e.id, e.ref, e.topic_name, c.topic_name AS topic_name_referenced, c.score AS s, c.emb AS f,
              CASE WHEN e.topic_name = c.topic_name THEN 0 WHEN e.subfield_name = c.subfield_name THEN 1 END AS priority,
              e.topic_name = c.topic_name OR e.subfield_name = c.subfield_name AS cat_match
       FROM edges e JOIN corpus c ON c.id = e.ref)
"""
GC_EDGES = _GC.format(pred="", tstart="")
GC_TABLE = _GC.format(pred=" AND w.cited_by_count >= 1 AND len(w.referenced_works) >= 5",
                      tstart=" WHERE publication_date >= DATE '1998-01-01'")


@register("g1_citation_edges", GC_EDGES + """SELECT id, ref, topic_name, topic_name_referenced FROM e2""")
def g1(spark, sf):
    c = G.prepare_corpus(graph_corpus(spark, sf), SPEC_EDGES)
    return G.citation_edges(c, SPEC_EDGES).select("id", "ref", "topic_name", "topic_name_referenced")


@register("g2_category_match", GC_EDGES + """SELECT id, ref FROM e2 WHERE cat_match""")
def g2(spark, sf):
    c = G.prepare_corpus(graph_corpus(spark, sf), SPEC_EDGES)
    return G.category_match(G.citation_edges(c, SPEC_EDGES), SPEC_EDGES.category_cols).select("id", "ref")


@register("g3_topk_by_sort", GC_EDGES + f"""SELECT id, array_to_string(list(ref ORDER BY rank), ',') AS graph_ids,
  {GX_SQL.format("list(f ORDER BY rank)")} AS graph_md5 FROM (
  SELECT id, ref, f, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, ref) AS INTEGER) AS rank
  FROM e2 WHERE cat_match) WHERE rank <= 5 GROUP BY id""")
def g3(spark, sf):
    c = G.prepare_corpus(graph_corpus(spark, sf), SPEC_EDGES)
    e = G.category_match(G.citation_edges(c, SPEC_EDGES), SPEC_EDGES.category_cols)
    nb = G.topk_by_sort(e, SPEC_EDGES, corpus=c)
    return nb.select("id", F.array_join(F.col("graph_ids").cast("array<string>"), ",").alias("graph_ids"),
                     vectors_md5(F.flatten("graph_x")).alias("graph_md5"))


@register("g4_topk_by_category_priority", GC_EDGES + """SELECT id, rank, ref, priority FROM (
  SELECT id, ref, priority, CAST(row_number() OVER (PARTITION BY id ORDER BY priority, s, ref) AS INTEGER) AS rank
  FROM e2 WHERE cat_match) WHERE rank <= 5""")
def g4(spark, sf):
    c = G.prepare_corpus(graph_corpus(spark, sf), SPEC_EDGES)
    e = G.category_match(G.citation_edges(c, SPEC_EDGES), SPEC_EDGES.category_cols)
    e = e.withColumn("priority", G.category_priority(SPEC_EDGES.category_cols))
    nb = G.topk_by_category_priority(e, SPEC_EDGES)
    out = nb.select("id", F.posexplode("graph_ids").alias("rank", "ref")).withColumn("rank", F.col("rank") + 1)
    pri = e.select("id", "ref", "priority").distinct()
    return out.join(pri, ["id", "ref"])


_G5_NB = GC_TABLE + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, s, ref) AS rank FROM e2 WHERE cat_match),
nb AS (SELECT id, list(ref ORDER BY rank) AS graph_ids, list(f ORDER BY rank) AS graph_x
       FROM ranked WHERE rank <= 3 GROUP BY id),
tbl AS (SELECT t.id, t.publication_date, t.emb AS x, nb.graph_x, nb.graph_ids, [CAST(t.cited_by_count AS DOUBLE)] AS y
        FROM targets t JOIN nb ON nb.id = t.id)
"""


def g5_table(spark, sf):
    return G.neighbourhood_table(graph_corpus(spark, sf), SPEC_TABLE)


@register("g5_neighbourhood_table", _G5_NB + """SELECT id, CAST(y[1] > 2 AS INTEGER) AS label,
  CAST(len(graph_ids) AS INTEGER) AS n_neighbours, array_to_string(graph_ids, ',') AS graph_ids,
  CAST(len(x) AS INTEGER) AS x_len, """ + GX_SQL.format("[x]") + " AS x_md5, " + GX_SQL.format("graph_x")
          + " AS graph_md5 FROM tbl")
def g5(spark, sf):
    t = g5_table(spark, sf)
    return t.select("id", L.label_threshold(F.col("y")[0], 2).alias("label"),
                    F.size("graph_ids").alias("n_neighbours"),
                    F.array_join(F.col("graph_ids").cast("array<string>"), ",").alias("graph_ids"),
                    F.size("x").alias("x_len"), vectors_md5(F.col("x")).alias("x_md5"), vectors_md5(F.flatten("graph_x")).alias("graph_md5"))


SPEC_TOKENS = G.GraphSpec(t_start="1998-01-01", t_end="2000-01-01", top_k=3, feature_col="referenced_works",
                          x_cols=("referenced_works", "cited_by_count"), flatten_features=True, graph_max_len=28)


@register("g5_token_neighbourhood", GC_EDGES + """, ranked AS (
  SELECT e2.id, c.referenced_works AS f, ref, row_number() OVER (PARTITION BY e2.id ORDER BY priority, s, ref) AS rank
  FROM e2 JOIN corpus c ON c.id = e2.ref WHERE cat_match),
nb AS (SELECT id, flatten(list(f ORDER BY rank)) AS graph_x FROM ranked WHERE rank <= 3 GROUP BY id)
SELECT t.id, array_to_string(list_concat(t.referenced_works, [t.cited_by_count]), ',') AS x,
  array_to_string(nb.graph_x, ',') AS graph_x FROM corpus t JOIN nb USING (id)
WHERE t.publication_date >= DATE '1998-01-01' AND len(nb.graph_x) <= 28""")
def g5t(spark, sf):
    t = G.neighbourhood_table(graph_corpus(spark, sf), SPEC_TOKENS)

    def text(c):
        return F.array_join(F.transform(c, lambda v: v.cast("bigint").cast("string")), ",").alias(c)
    return t.select("id", text("x"), text("graph_x"))


def _rolling_sql(lo: int, hi: int, k: int, corpus: str = "works") -> str:
    """CTE ``cand``: the k best works of a category dated ``lo`` to ``hi`` days from each of its dates."""
    return f""", keys AS (SELECT DISTINCT topic_name, publication_date AS kd FROM {corpus}),
cand AS (SELECT * FROM (SELECT k.topic_name, k.kd, p.id AS ref,
                CAST(row_number() OVER (PARTITION BY k.topic_name, k.kd ORDER BY p.score DESC, p.id) AS INTEGER) AS rank
         FROM keys k JOIN {corpus} p ON p.topic_name = k.topic_name
          AND p.publication_date >= k.kd + {lo} AND p.publication_date <= k.kd + {hi}) WHERE rank <= {k})
"""


_G6_ROWS = """SELECT b.id, c.rank, c.ref FROM works b JOIN cand c ON c.topic_name = b.topic_name AND c.kd = b.publication_date"""


def _rolled(spark, sf, **window):
    # this operator reads no citations
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    r = G.rolling_category_topk(fx.works_alone(spark, sf).join(e, "vec_id"), "topic_name", "publication_date", "score", "emb",
                                top_k=3, **window)
    return r.select("id", F.posexplode("graph_ids").alias("rank", "ref")).withColumn("rank", F.col("rank") + 1)


@register("g6_rolling_category_topk", W + _rolling_sql(-29, 0, 3) + _G6_ROWS)
def g6(spark, sf):
    return _rolled(spark, sf, period_days=30)


@register("g6_rolling_ahead", W + _rolling_sql(6, 15, 3) + _G6_ROWS)
def g6a(spark, sf):
    return _rolled(spark, sf, period_days=10, offset_days=5)


SPEC_ROLLING = G.GraphSpec(t_start="1996-01-01", t_end="1999-01-01", category_cols=("topic_name",), top_k=4,
                           x_cols=("emb", "score"), predicate="cited_by_count >= 1")


@register("g6_rolling_table", W + """, corpus AS (
  SELECT w.id, w.publication_date, w.topic_name, w.score, w.cited_by_count, e.embedding AS emb
  FROM works w JOIN embeddings e ON e.vec_id = w.vec_id
  WHERE w.referenced_works IS NOT NULL AND w.publication_date < DATE '1999-01-01' AND w.cited_by_count >= 1)
""" + _rolling_sql(-59, -15, 4, "corpus") + """, nb AS (SELECT c.topic_name, c.kd, list(ref ORDER BY rank) AS ids,
  list(p.emb ORDER BY rank) AS fs FROM cand c JOIN corpus p ON p.id = c.ref GROUP BY c.topic_name, c.kd)
SELECT b.id, array_to_string(ids, ',') AS graph_ids, """ + GX_SQL.format("[emb, [CAST(score AS DOUBLE)]]") + " AS x_md5, "
          + GX_SQL.format("fs") + """ AS graph_md5, CAST(b.cited_by_count AS DOUBLE) AS y
FROM corpus b JOIN nb ON nb.topic_name = b.topic_name AND nb.kd = b.publication_date
WHERE b.publication_date >= DATE '1996-01-01'""")
def g6t(spark, sf):
    t = G.rolling_table(graph_corpus(spark, sf), SPEC_ROLLING, period_days=45, offset_days=-60)
    return t.select("id", F.array_join(F.col("graph_ids").cast("array<string>"), ",").alias("graph_ids"),
                    vectors_md5("x").alias("x_md5"), vectors_md5(F.flatten("graph_x")).alias("graph_md5"), F.col("y")[0].alias("y"))


@register("g7_observed_max_lengths", _G5_NB + """SELECT CAST(max(len(x)) AS INTEGER) AS max_len,
  CAST(max(len(graph_x)) AS INTEGER) AS graph_max_len FROM tbl""")
def g7(spark, sf):
    return G.observed_max_lengths(g5_table(spark, sf))


_G8_RANKED = W + """, win AS (SELECT make_date(y, 1, 1) AS window_start, make_date(y + 1, 1, 1) AS window_end
        FROM (SELECT unnest(range({first}, 2030)) AS y)),
corpus AS (
  SELECT w.id, w.publication_date, w.referenced_works, w.topic_name, w.subfield_name, w.score, w.cited_by_count,
         e.embedding AS emb
  FROM works w JOIN embeddings e ON e.vec_id = w.vec_id
  WHERE w.referenced_works IS NOT NULL AND w.cited_by_count >= 1 AND len(w.referenced_works) >= 5),
targets AS (SELECT c.*, win.window_start, win.window_end FROM corpus c JOIN win
            ON c.publication_date >= win.window_start AND c.publication_date < win.window_end),
edges AS (SELECT id, window_start, window_end, topic_name, subfield_name, unnest(referenced_works) AS ref FROM targets),
e2 AS (SELECT e.id, e.window_start, e.ref, c.score AS s, c.emb AS f,
              CASE WHEN e.topic_name = c.topic_name THEN 0 WHEN e.subfield_name = c.subfield_name THEN 1 END AS priority
       FROM edges e JOIN corpus c ON c.id = e.ref
       WHERE c.publication_date < e.window_end AND (e.topic_name = c.topic_name OR e.subfield_name = c.subfield_name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, window_start ORDER BY priority, s, ref) AS rank FROM e2)
"""
_G8 = _G8_RANKED.format(first=1990) + """SELECT window_start, id, CAST(count(*) AS INTEGER) AS n_neighbours, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY rank) AS graph_ids,
  """ + GX_SQL.format("list(f ORDER BY rank)") + """ AS graph_md5
FROM ranked WHERE rank <= 3 GROUP BY window_start, id"""


@register("g8_rewindow", _G8)
def g8(spark, sf):
    spec = G.GraphSpec(top_k=3, predicate="cited_by_count >= 1 AND size(referenced_works) >= 5")
    r = G.rewindow(graph_corpus(spark, sf), spec, "1990-01-01")  # up to the latest work
    return r.select("window_start", "id", F.size("graph_ids").alias("n_neighbours"),
                    F.array_join(F.col("graph_ids").cast("array<string>"), ",").alias("graph_ids"), vectors_md5(F.flatten("graph_x")).alias("graph_md5"))


# ------------------------------------------------------------------ labels (L)
BOUNDS = [1, 3, 6, 10]
WEIGHTS = [0.5, 1.0, 2.0, 4.0, 8.0]


@register("l1_label_nonzero", W + "SELECT id, CASE WHEN cited_by_count = 0 THEN 0 ELSE 1 END AS label FROM works")
def l1(spark, sf):
    return fx.works(spark, sf).select("id", L.label_nonzero("cited_by_count").alias("label"))


@register("l2_label_threshold", W + "SELECT id, CAST(cited_by_count > 2 AS INTEGER) AS label FROM works")
def l2(spark, sf):
    return fx.works(spark, sf).select("id", L.label_threshold("cited_by_count", 2).alias("label"))


@register("l3_label_log", W + "SELECT id, round(ln(cited_by_count + 1), 6) AS label FROM works")
def l3(spark, sf):
    return fx.works(spark, sf).select("id", r6(L.label_log("cited_by_count")).alias("label"))


_ORD = "CAST((cited_by_count >= 1)::INT + (cited_by_count >= 3)::INT + (cited_by_count >= 6)::INT + (cited_by_count >= 10)::INT AS INTEGER)"


@register("l4_label_ordinal", W + f"SELECT id, cited_by_count AS y_orig, {_ORD} AS label FROM works")
def l4(spark, sf):
    return fx.works(spark, sf).select("id", F.col("cited_by_count").alias("y_orig"),
                                      L.label_ordinal("cited_by_count", BOUNDS).alias("label"))


@register("l5_class_weight", W + f"SELECT id, CAST(([0.5, 1.0, 2.0, 4.0, 8.0])[{_ORD} + 1] AS DOUBLE) AS weight FROM works")
def l5(spark, sf):
    w = fx.works(spark, sf).withColumn("label", L.label_ordinal("cited_by_count", BOUNDS))
    return w.select("id", L.class_weight("label", WEIGHTS).alias("weight"))


_PADDED = W + """, padded AS (SELECT id, CASE WHEN len(referenced_works) >= 8 THEN referenced_works[1:8]
                                    ELSE list_resize(referenced_works, 8, 0) END AS x
                   FROM works WHERE referenced_works IS NOT NULL)
"""


@register("l6_pad_truncate", _PADDED + """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, value FROM (
  SELECT id, unnest(x) AS value, unnest(range(1, 9)) AS pos FROM padded)""")
def l6(spark, sf):
    w = fx.works(spark, sf).where(F.col("referenced_works").isNotNull())
    return w.select("id", F.posexplode(L.pad_truncate("referenced_works", 8, 0)).alias("pos", "value"))


@register("l7_pad_mask", _PADDED + """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, value <> 0 AS mask FROM (
  SELECT id, unnest(x) AS value, unnest(range(1, 9)) AS pos FROM padded)""")
def l7(spark, sf):
    w = fx.works(spark, sf).where(F.col("referenced_works").isNotNull())
    w = w.select("id", L.pad_mask(L.pad_truncate("referenced_works", 8, 0), 0).alias("m"))
    return w.select("id", F.posexplode("m").alias("pos", "mask"))


@register("l8_neighbour_pad_mask", _G5_NB + """, m AS (SELECT id, graph_x, len(graph_x) AS n FROM tbl)
SELECT id, CAST(p AS INTEGER) AS pos, CAST(p < least(n, 3) AS INTEGER) AS mask, CASE WHEN p < n THEN 1 ELSE 0 END AS real_vec,
  """ + GX_SQL.format("[CASE WHEN p < n THEN graph_x[p + 1] ELSE list_transform(range(0, 64), lambda i: CAST(0 AS FLOAT)) END]")
          + """ AS vec_md5 FROM m, (SELECT unnest(range(0, 3)) AS p)""")
def l8(spark, sf):
    t = g5_table(spark, sf)
    gx, mask = L.neighbour_pad_mask("graph_x", top_k=3, graph_max_len=3, dim=64)
    t = t.select("id", gx.alias("gx"), mask.alias("mask"))
    z = t.select("id", F.posexplode(F.arrays_zip("gx", "mask")).alias("pos", "s"))
    return z.select("id", "pos", F.col("s.mask").alias("mask"),
                    F.when(F.aggregate(F.col("s.gx"), F.lit(0.0), lambda a, v: a + F.abs(v)) > 0, 1)
                    .otherwise(0).alias("real_vec"), vectors_md5(F.col("s.gx")).alias("vec_md5"))


_SPAN = W + """, s AS (SELECT id, referenced_works AS l, len(referenced_works) AS n,
              (id * 7919 + 7) % (greatest(len(referenced_works) - 1 - 1, 0) + 1) AS off
            FROM works WHERE referenced_works IS NOT NULL),
s2 AS (SELECT *, greatest(off - 4, 0) AS st FROM s)
"""


def _pad_sql(e: str, n: int, left: bool = False) -> str:
    if left:
        return f"CASE WHEN len({e}) < {n} THEN list_concat(list_resize([0], {n} - len({e}), 0), {e}) ELSE {e} END"
    return f"CASE WHEN len({e}) < {n} THEN list_resize({e}, {n}, 0) ELSE {e} END"


_XS = "l[st + 1:off]"
_YS = "l[st + 2:least(off + 1, n)]"


@register("l9_span_split_forward", _SPAN + f"""SELECT id, array_to_string({_pad_sql(_XS, 4)}, ',') AS x,
  array_to_string({_pad_sql(_YS, 4)}, ',') AS y FROM s2""")
def l9(spark, sf):
    w = fx.works(spark, sf).where(F.col("referenced_works").isNotNull())
    x, y = L.span_split_forward("referenced_works", "id", max_len=4, n_forward=1, seed=7)
    return w.select("id", F.array_join(x.cast("array<string>"), ",").alias("x"),
                    F.array_join(y.cast("array<string>"), ",").alias("y"))


_YB = "l[greatest(off - 2, 0) + 1:least(off + 1, n)]"


@register("l10_span_split_both", _SPAN + f"""SELECT id, array_to_string({_pad_sql(_XS, 4, left=True)}, ',') AS x,
  array_to_string({_pad_sql(_YB, 3)}, ',') AS y FROM s2""")
def l10(spark, sf):
    w = fx.works(spark, sf).where(F.col("referenced_works").isNotNull())
    x, y = L.span_split_both("referenced_works", "id", max_len=4, n_forward=1, n_backward=2, seed=7)
    return w.select("id", F.array_join(x.cast("array<string>"), ",").alias("x"),
                    F.array_join(y.cast("array<string>"), ",").alias("y"))


# ------------------------------------------------------------------ models (M)
from citesight.operators import model as M  # noqa: E402
from citesight.plans.catalog import sqlgen as Q  # noqa: E402
from citesight.sources import io as S  # noqa: E402
from citesight.functions.columns import with_scalars

SPEC_TRAIN = G.GraphSpec(t_start="1996-01-01", t_end="1999-01-01", top_k=3,
                         predicate="cited_by_count >= 1 AND size(referenced_works) >= 5")
SPEC_VAL = G.GraphSpec(t_start="1999-01-01", t_end="2000-01-01", top_k=3,
                       predicate="cited_by_count >= 1 AND size(referenced_works) >= 5")

#: Features of a row of a neighbourhood table: own vector, then the mean of the neighbours'.
FEATURES_SQL = """list_concat(list_transform({x}, lambda v: CAST(v AS DOUBLE)), list_transform(range(1, len({x}) + 1),
    lambda i: list_sum(list_transform({g}, lambda n: CAST(n[i] AS DOUBLE))) / len({g})))"""


def labelled_sql(t_start: str, t_end: str) -> str:
    """A query of (id, y, w, f): the labelled, weighted rows of a window with their features."""
    table = _GC.format(pred=" AND w.cited_by_count >= 1 AND len(w.referenced_works) >= 5",
                       tstart=f" WHERE publication_date >= DATE '{t_start}'").replace("2000-01-01", t_end)
    return table + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, s, ref) AS rank FROM e2 WHERE cat_match),
nb AS (SELECT id, list(f ORDER BY rank) AS g FROM ranked WHERE rank <= 3 GROUP BY id),
lab AS (SELECT t.id, CAST(t.cited_by_count > 2 AS DOUBLE) AS y, {FEATURES_SQL.format(x='t.emb', g='nb.g')} AS f
        FROM targets t JOIN nb ON nb.id = t.id),
cls AS (SELECT y, count(*) AS c FROM lab GROUP BY y)
SELECT id, lab.y, f, CAST((SELECT sum(c) FROM cls) AS DOUBLE) / ((SELECT count(*) FROM cls) * c) AS w FROM lab JOIN cls USING (y)"""


def rewindow_sql(first: int) -> str:
    """A query of (window_start, id, y, f): the labelled rows of each year from ``first``."""
    return _G8_RANKED.format(first=first) + f""", nb AS (
  SELECT window_start, id, list(f ORDER BY rank) AS g FROM ranked WHERE rank <= 3 GROUP BY window_start, id)
SELECT window_start, id, CAST(t.cited_by_count > 2 AS DOUBLE) AS y, {FEATURES_SQL.format(x='t.emb', g='nb.g')} AS f
FROM targets t JOIN nb USING (window_start, id)"""


NEWTON_STEPS = 8
FIT_SQL = ("WITH RECURSIVE train AS MATERIALIZED (" + labelled_sql("1996-01-01", "1999-01-01") + "),\n"
           + Q.newton_sql("train", NEWTON_STEPS, 0.01))
PROB_SQL = "1 / (1 + exp(-list_dot_product(list_concat([CAST(1.0 AS DOUBLE)], f), b)))"


def _labelled(corpus, spec):
    """(id, label, weight, x, graph_x) of a window's rows, staged once in the shared folder: class counts and the
    optimizer's passes read it, not the join plan. The neighbours' mean stands for the neighbours, whose mean it is."""
    t = G.neighbourhood_table(corpus, spec)
    t = S.stage_table(t.select("id", L.label_threshold(F.col("y")[0], 2).cast("double").alias("label"), "x",
                               F.array(M.neighbour_mean()).alias("graph_x")))
    # class-balance weights: total / (classes * class count), one grouped count joined back
    cnt = t.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))
    tot = cnt.agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = with_scalars(cnt, tot).select("label", (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return t.join(F.broadcast(S.stage_table(w)), "label")  # a row per class


@register("m1_train_window", FIT_SQL + f"""
SELECT y AS label, count(*) AS examples, round(avg(prob), 6) AS mean_prob FROM (
  SELECT y, {PROB_SQL} AS prob FROM train, fitted) GROUP BY y""")
def m1(spark, sf):
    train = _labelled(graph_corpus(spark, sf), SPEC_TRAIN)
    scored = M.score_batch(M.train_newton(train, steps=NEWTON_STEPS, staged=True), train, keep=("id", "label"))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("examples"), r6(F.avg("prob")).alias("mean_prob"))


@register("m2_score_batch", FIT_SQL + f""",
val AS (""" + labelled_sql("1999-01-01", "2000-01-01") + f""")
SELECT id, label, round(prob, 6) AS prob, CAST(prob > 0.5 AS INTEGER) AS pred FROM (
  SELECT id, y AS label, {PROB_SQL} AS prob FROM val, fitted)""")
def m2(spark, sf):
    corpus = graph_corpus(spark, sf)
    model = M.train_newton(_labelled(corpus, SPEC_TRAIN), steps=NEWTON_STEPS, staged=True)
    scored = M.score_batch(model, _labelled(corpus, SPEC_VAL), keep=("id", "label"))
    return scored.withColumn("prob", r6("prob"))


_M3 = _GC.format(pred=" AND w.cited_by_count >= 1 AND len(w.referenced_works) >= 5",
                 tstart=" WHERE publication_date >= DATE '1999-01-01'")


@register("m3_save_load_model", _M3 + """SELECT count(DISTINCT id) AS rows, count(DISTINCT id) AS equal_scores
FROM e2 WHERE cat_match""")
def m3(spark, sf):
    # a loaded model gives every row of the next window exactly the score of the fitted one
    corpus = graph_corpus(spark, sf)
    model = M.train_window(_labelled(corpus, SPEC_TRAIN))
    root = S.scratch_path(spark, "models")
    M.save_model(model, root, "run0", 1)
    val = _labelled(corpus, SPEC_VAL)
    a = M.score_batch(model, val, keep=("id",))
    b = M.score_batch(M.load_model(root, "run0", 1), val, keep=("id",)).select("id", F.col("prob").alias("again"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prob") == F.col("again")).alias("equal_scores"))
