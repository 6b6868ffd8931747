"""Queries of the composed jobs: preprocess, training rows, reports per kind of predictions, windowed evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesight.functions.columns import r6
from citesight.operators import clean as C
from citesight.operators import model as M
from citesight.operators import neighbours as G
from citesight.plans import jobs as J
from citesight.plans.catalog import graph, scoring, text
from citesight.plans.catalog import sqlgen as Q
from citesight.plans.registry import register
from citesight.sources import fixtures as fx


def _joined(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


# ---------------------------------------------------------------- preprocess
def papers(spark, sf):
    """Documents with a licence flag and a date, as the preprocess job expects them."""
    return fx.documents(spark, sf).withColumns({
        "is_license_safe": F.col("doc_id") % 4 != 0,
        "publication_date": F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))})


PREPROCESS = J.PreprocessSpec(
    id_col="doc_id", time_col="publication_date", text_col="text", clean=[C.CleanSpec("text", level=4, min_len=100)],
    start="1995-02-01", end="2000-01-01", members=(("language", ("en", "de", "fr")),), null_unlicensed=["text"],
    phrases=tuple(text.PHRASES), chunks=5)

_PRE = f"""WITH papers AS (SELECT doc_id, lang AS language, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS text,
    DATE '1995-01-01' + CAST(doc_id % 2000 AS INTEGER) AS publication_date FROM documents),
kept AS (SELECT * FROM papers WHERE publication_date >= DATE '1995-02-01' AND publication_date < DATE '2000-01-01'
    AND language IN ('en', 'de', 'fr')),
l1 AS (SELECT doc_id, publication_date, {text._L1} AS text,
    CASE WHEN {text._contains_sql(text._L1, C.FOREIGN_MARKERS)} THEN 'unknown' ELSE language END AS language FROM kept),
st AS (SELECT greatest(avg(length(text)) - 3 * stddev_samp(length(text)), 100.0) AS lo,
    avg(length(text)) + 3 * stddev_samp(length(text)) AS hi FROM l1),
clean AS (SELECT l1.* FROM l1, st WHERE NOT (length(text) < lo OR length(text) > hi)),
toks AS (SELECT doc_id, unnest({text._SPLIT}) AS token, unnest(range(1, len({text._SPLIT}) + 1)) AS pos FROM clean),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS token_id FROM toks GROUP BY token),
ids AS (SELECT doc_id, list(token_id ORDER BY pos) AS l FROM toks JOIN vocab USING (token) GROUP BY doc_id),
ix AS (SELECT *, row_number() OVER (ORDER BY publication_date, doc_id) - 1 AS i, count(*) OVER () AS n FROM clean)
SELECT doc_id, language, md5(text) AS text_md5, md5(array_to_string(list_concat([1], coalesce(l, []), [2]), ',')) AS tokens_md5,
    CAST(least(floor(i / greatest(ceil(n / 5), 1)), 4) AS INTEGER) AS part FROM ix LEFT JOIN ids USING (doc_id)"""


@register("job_preprocess", _PRE)
def preprocess(spark, sf):
    d = J.preprocess(papers(spark, sf), PREPROCESS)
    return d.select("doc_id", "language", F.md5("text").alias("text_md5"), F.md5(_joined("text_tokens")).alias("tokens_md5"),
                    "part")


# ---------------------------------------------------------------- training rows
@register("job_text_token_table", graph.W + """SELECT id,
  array_to_string(list_resize(list_concat(referenced_works, counts_by_year_counts), 14, 0), ',') AS x,
  array_to_string(list_transform(range(0, 14), lambda i: CAST(i < len(referenced_works) + len(counts_by_year_counts) AS INTEGER)), ',') AS mask,
  CAST(cited_by_count > 2 AS INTEGER) AS label, CASE WHEN cited_by_count > 2 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
FROM works WHERE referenced_works IS NOT NULL AND counts_by_year_counts IS NOT NULL AND type = 'chapter'
  AND publication_date >= DATE '1996-01-01' AND publication_date < DATE '2000-01-01'
  AND len(referenced_works) + len(counts_by_year_counts) <= 14""")
def text_token_table(spark, sf):
    t = J.text_token_table(fx.works(spark, sf), "id", ["referenced_works", "counts_by_year_counts"], "cited_by_count", 14, 2,
                           [0.5, 2.0], "publication_date", "1996-01-01", "2000-01-01", "type = 'chapter'")
    return t.select("id", _joined("x").alias("x"), _joined("mask").alias("mask"), "label", "weight")


_GXF = graph.GX_SQL.format("list_resize(list(f ORDER BY rank), 3, list_resize([0.0::FLOAT], 64, 0.0::FLOAT))")


@register("job_formatted_vectors", graph.GC_TABLE + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, s, ref) AS rank FROM e2 WHERE cat_match),
nb AS (SELECT id, {_GXF} AS graph_md5, count(*) AS n FROM ranked WHERE rank <= 3 GROUP BY id)
SELECT t.id, {graph.GX_SQL.format("[t.emb]")} AS x_md5, graph_md5,
  array_to_string(list_transform(range(0, 3), lambda i: CAST(i < n AS INTEGER)), ',') AS graph_x_mask,
  CAST(t.cited_by_count > 2 AS INTEGER) AS y, CASE WHEN t.cited_by_count > 2 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
FROM targets t JOIN nb USING (id)""")
def formatted_vectors(spark, sf):
    t = J.formatted_vectors(graph.g5_table(spark, sf), 3, 64, 2, [0.5, 2.0])
    return t.select("id", graph.vectors_md5(F.col("x")).alias("x_md5"),
                    graph.vectors_md5(F.flatten("graph_x")).alias("graph_md5"),
                    _joined("graph_x_mask").alias("graph_x_mask"), "y", "weight")


@register("job_formatted_tokens", graph.GC_EDGES + """, ranked AS (
  SELECT e2.id, c.referenced_works AS f, ref, row_number() OVER (PARTITION BY e2.id ORDER BY priority, s, ref) AS rank
  FROM e2 JOIN corpus c ON c.id = e2.ref WHERE cat_match),
nb AS (SELECT id, flatten(list(f ORDER BY rank)) AS g FROM ranked WHERE rank <= 3 GROUP BY id),
j AS (SELECT t.id, list_concat(t.referenced_works, [t.cited_by_count]) AS x, g, t.cited_by_count AS c
      FROM corpus t JOIN nb USING (id) WHERE t.publication_date >= DATE '1998-01-01' AND len(g) <= 28)
SELECT id, array_to_string(list_resize(x, 16, 0), ',') AS x, array_to_string(list_resize(g, 28, 0), ',') AS graph_x,
  array_to_string(list_transform(range(0, 16), lambda i: CAST(i < len(x) AS INTEGER)), ',') AS mask,
  array_to_string(list_transform(range(0, 28), lambda i: CAST(i < len(g) AS INTEGER)), ',') AS graph_x_mask,
  CAST(c > 2 AS INTEGER) AS y, CASE WHEN c > 2 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM j""")
def formatted_tokens(spark, sf):
    t = J.formatted_tokens(G.neighbourhood_table(graph.graph_corpus(spark, sf), graph.SPEC_TOKENS), 16, 28, 2, [0.5, 2.0])
    return t.select("id", *[_joined(c).alias(c) for c in ("x", "graph_x", "mask", "graph_x_mask")], "y", "weight")


# ---------------------------------------------------------------- reports
def _rounded(df, *names):
    return df.select("w", "examples", *[r6(n).alias(n) for n in names])


_REG = fx.with_views("regressed") + """SELECT id % 5 AS w, count(*) AS examples, round(avg(abs(y - pred)), 6) AS mae,
  round(100 * sum(abs(y - pred)) / sum(y), 6) AS wape{more} FROM regressed GROUP BY id % 5"""


@register("job_regression_report", _REG.format(more=""))
def regression_report(spark, sf):
    d = fx.regressed(spark, sf).withColumn("w", F.col("id") % 5)
    return _rounded(J.regression_report(d, ["w"]), "mae", "wape")


@register("job_heteroscedastic_report", _REG.format(more=""", round(avg(sigma), 6) AS sigma_mean,
  round(avg(CAST(y <= pred + 3 * sigma AND y >= pred - 3 * sigma AS INTEGER)), 6) AS capture_3sd,
  round(avg(CASE WHEN sigma > 0 THEN abs(y - pred) / sigma + ln(sigma) END), 6) AS hetero_mae"""))
def heteroscedastic_report(spark, sf):
    d = fx.regressed(spark, sf).withColumn("w", F.col("id") % 5)
    return _rounded(J.heteroscedastic_report(d, ["w"]), "mae", "wape", "sigma_mean", "capture_3sd", "hetero_mae")


_CLASS = fx.with_views("scored_multi") + f""", pred AS (SELECT id, id % 3 AS w, y, probs,
    CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM scored_multi),
t AS (SELECT w, y AS cls, count(*) AS support, count_if(y = pred) AS tp FROM pred GROUP BY w, y),
p AS (SELECT w, pred AS cls, count(*) AS predicted FROM pred GROUP BY w, pred),
pc AS (SELECT coalesce(t.w, p.w) AS w, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
       FROM t FULL JOIN p ON p.w = t.w AND p.cls = t.cls),
s AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
             CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM pc),
per_row AS (SELECT w, list_sum(list_transform(range(0, 10), lambda i: abs(probs[i + 1] - CASE WHEN i = y THEN 1.0 ELSE 0.0 END))) / 10 AS m,
    {scoring._NORM.format(a='probs')} AS a, {scoring._NORM.format(a=scoring._OH)} AS b FROM pred),
cdf AS (SELECT w, m, a, {scoring._CDF.format(a='a')} AS ca, {scoring._CDF.format(a='b')} AS cb FROM per_row),
dist AS (SELECT w, avg(m) AS mae, avg(list_sum(list_transform(range(1, 11), lambda i: abs(ca[i] - cb[i])))) AS wasserstein,
    avg(sqrt(list_sum(list_transform(range(1, 11), lambda i: (ca[i] - cb[i]) * (ca[i] - cb[i]))))) * sqrt(2) AS energy,
    avg(list_sum(list_transform(a, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0.0 END)) / ln(10)) AS norm_entropy
    FROM cdf GROUP BY w)
SELECT s.w, CAST(sum(support) AS BIGINT) AS examples, round(any_value(mae), 6) AS mae, round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(avg(f1), 6) AS f1_macro{{more}}
FROM s JOIN dist USING (w) GROUP BY s.w"""
_CLASS_COLS = ("mae", "accuracy", "balanced_accuracy", "f1_weighted", "precision_weighted", "f1_macro")


@register("job_classification_report", _CLASS.format(more=""))
def classification_report(spark, sf):
    d = fx.scored_multi(spark, sf).withColumn("w", F.col("id") % 3)
    return _rounded(J.classification_report(d, ["w"]), *_CLASS_COLS)


@register("job_ordinal_report", _CLASS.format(more=""", round(any_value(wasserstein), 6) AS wasserstein,
  round(any_value(energy), 6) AS energy, round(any_value(norm_entropy), 6) AS norm_entropy"""))
def ordinal_report(spark, sf):
    d = fx.scored_multi(spark, sf).withColumn("w", F.col("id") % 3)
    return _rounded(J.ordinal_report(d, ["w"], fx.CLASSES), *_CLASS_COLS, "wasserstein", "energy", "norm_entropy")


def _dated_lines(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    return fx.regressed(spark, sf).withColumn("k", F.floor(F.col("id") / 8)).join(o, "k")


@register("job_sliding_regression", fx.with_views("regressed") + """, win AS (
  SELECT CAST(DATE '1995-01-01' + to_months(CAST(24 * k AS INTEGER)) AS DATE) AS s FROM range(0, 100) t(k)),
r AS (SELECT g.*, s FROM regressed g JOIN orders o ON o.o_orderkey = g.id // 8
      JOIN win ON CAST(o.o_orderdate AS DATE) >= s AND CAST(o.o_orderdate AS DATE) < s + to_months(24))
SELECT s AS window_start, count(*) AS examples, CAST(0 AS BIGINT) AS nan_rows, round(avg(abs(y - pred)), 6) AS mae,
  round(100 * sum(abs(y - pred)) / sum(y), 6) AS wape, round(avg(sigma), 6) AS sigma_mean,
  round(avg(CAST(y <= pred + 3 * sigma AND y >= pred - 3 * sigma AS INTEGER)), 6) AS capture_3sd,
  round(avg(CASE WHEN sigma > 0 THEN abs(y - pred) / sigma + ln(sigma) END), 6) AS hetero_mae FROM r GROUP BY s""")
def sliding_regression(spark, sf):
    r = J.sliding_report(_dated_lines(spark, sf), J.heteroscedastic_report, "1995-01-01", every=2)
    return r.select("window_start", "examples", "nan_rows", *[r6(c).alias(c) for c in (
        "mae", "wape", "sigma_mean", "capture_3sd", "hetero_mae")])


@register("job_sliding_ordinal", _CLASS.format(more=""", round(any_value(wasserstein), 6) AS wasserstein,
  round(any_value(energy), 6) AS energy, round(any_value(norm_entropy), 6) AS norm_entropy""").replace(
    "id % 3 AS w", "CAST(DATE '2000-01-01' + to_months(CAST(6 * ((id % 700) // 183) AS INTEGER)) AS DATE) AS w")
    .replace("SELECT s.w,", "SELECT s.w AS window_start,"))
def sliding_ordinal(spark, sf):
    # a date for each vector: half years in steps of days
    m = fx.scored_multi(spark, sf).withColumn("d", F.expr(
        "add_months(DATE '2000-01-01', cast(6 * floor((id % 700) / 183) as int)) + cast(id % 28 as int)"))
    r = J.sliding_report(m, J.ordinal_report, "2000-01-01", every=6, unit="month", n_classes=fx.CLASSES)
    return r.select("window_start", "examples", *[r6(c).alias(c) for c in (*_CLASS_COLS, "wasserstein", "energy", "norm_entropy")])


# ---------------------------------------------------------------- windowed evaluation
_EVAL = graph.FIT_SQL + """,
tbl AS (""" + graph.rewindow_sql(1999) + f"""),
sw AS (SELECT window_start, y, {graph.PROB_SQL} AS prob FROM tbl, fitted),
""" + Q.binary_wide_sql("sw", ["window_start"]) + ",\n" + Q.metric_rows_sql(["window_start"])


@register("job_windowed_evaluation", _EVAL + f"""
SELECT window_start, {scoring.PIVOT}, max(examples) AS examples, CAST(0 AS DOUBLE) AS nan_scores FROM (
  SELECT m.window_start, m.metric, m.score, m.weight AS examples FROM mrows m) GROUP BY window_start""")
def windowed_evaluation(spark, sf):
    corpus = graph.graph_corpus(spark, sf)
    model = M.train_newton(graph._labelled(corpus, graph.SPEC_TRAIN), steps=graph.NEWTON_STEPS, staged=True)
    spec = G.GraphSpec(top_k=3, predicate="cited_by_count >= 1 AND size(referenced_works) >= 5")
    return J.windowed_evaluation(corpus, spec, model, "1999-01-01")
