"""Queries over prediction tables: metrics (E) and losses (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesight.functions.columns import r6
from citesight.operators import losses as O
from citesight.operators import metrics as E
from citesight.plans.catalog import sqlgen as Q
from citesight.plans.registry import register
from citesight.sources import fixtures as fx
from citesight.functions.columns import with_scalars

SW = fx.with_views("scored_windows")
S = fx.with_views("scored")
SM = fx.with_views("scored_multi")
RG = fx.with_views("regressed")


def _round_all(df, keep=()):
    from pyspark.sql import types as T
    return df.select(*[r6(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       and f.name not in keep else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- E1-E5
_NAN = SW + """, sn AS (SELECT id, w, y, CASE WHEN y = 0 AND prob > 0.7 THEN CAST('nan' AS DOUBLE) ELSE prob END AS prob
  FROM scored_windows)
"""


def _with_nan(spark, sf):
    # an unscored row is marked NaN: negatives above 0.7 have no score in this fixture
    s = fx.scored_windows(spark, sf)
    return s.withColumn("prob", F.when((F.col("y") == 0) & (F.col("prob") > 0.7), F.lit(float("nan")))
                        .otherwise(F.col("prob")))


@register("e1_nan_guard", _NAN + """, k AS (SELECT w, count(*) AS kept FROM sn WHERE NOT isnan(prob) GROUP BY w)
SELECT r.w, r.rows, r.prob_nan, coalesce(k.kept, 0) AS kept FROM (
  SELECT w, count(*) AS rows, CAST(count_if(isnan(prob)) AS BIGINT) AS prob_nan FROM sn GROUP BY w) r LEFT JOIN k ON k.w = r.w""")
def e1(spark, sf):
    s = _with_nan(spark, sf)
    rep = E.nan_report(s, ["prob"], ["w"])
    kept = E.nan_guard(s, ["prob"]).groupBy("w").agg(F.count(F.lit(1)).alias("kept"))
    return rep.join(kept, "w", "left").select("w", "rows", "prob_nan", F.coalesce("kept", F.lit(0)).alias("kept"))


@register("e2_mae", fx.with_views("regressed", "scored") + """SELECT
  (SELECT round(avg(abs(y - pred)), 6) FROM regressed) AS mae_regression,
  (SELECT round(avg(abs(y - prob)), 6) FROM scored) AS mae_probability""")
def e2(spark, sf):
    a = E.mae(fx.regressed(spark, sf)).select(r6("mae").alias("mae_regression"))
    b = E.mae(fx.scored(spark, sf), "y", "prob").select(r6("mae").alias("mae_probability"))
    return with_scalars(a, b)


@register("e3_wape", RG + "SELECT round(100 * sum(abs(y - pred)) / sum(y), 6) AS wape FROM regressed")
def e3(spark, sf):
    return _round_all(E.wape(fx.regressed(spark, sf)))


@register("e4_sigma_capture", RG + """SELECT round(avg(sigma), 6) AS sigma_mean,
  round(avg(CAST(y <= pred + sigma * 3 AND y >= pred - sigma * 3 AS DOUBLE)), 6) AS capture_3sd FROM regressed""")
def e4(spark, sf):
    return _round_all(E.sigma_capture(fx.regressed(spark, sf)))


@register("e5_softmax_probs", SM + """, sx AS (SELECT id, list_transform(probs, lambda v: exp(v - list_max(probs))) AS e FROM scored_multi),
sp AS (SELECT id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sx)
SELECT id, CAST(cls - 1 AS INTEGER) AS cls, round(v, 6) AS p,
       CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred FROM (
  SELECT id, p, unnest(p) AS v, unnest(range(1, len(p) + 1)) AS cls FROM sp)""")
def e5(spark, sf):
    m = fx.scored_multi(spark, sf).select("id", E.softmax("probs").alias("p"))
    m = m.select("id", "p", E.argmax_class("p").alias("pred"))
    return m.select("id", F.posexplode("p").alias("cls", "p"), "pred").select("id", "cls", r6("p").alias("p"), "pred")


# ---------------------------------------------------------------- E6-E9 rank metrics
@register("e6_roc_auc", SW + "," + Q.points_sql("pt", "scored_windows", ["w"]) + "\n" +
          f"SELECT w, round(roc_auc, 6) AS roc_auc FROM ({Q.auc_select('pt', ['w'])})")
def e6(spark, sf):
    return _round_all(E.roc_auc(fx.scored_windows(spark, sf), group_cols=["w"]))


@register("e6_roc_auc_ties", S + "," + Q.points_sql("pt", "scored", []) + "\n" +
          f"SELECT round(roc_auc, 6) AS roc_auc FROM ({Q.auc_select('pt', [])})")
def e6t(spark, sf):
    return _round_all(E.roc_auc(fx.scored(spark, sf)))


@register("e7_average_precision", SW + "," + Q.points_sql("pt", "scored_windows", ["w"]) + "\n" +
          f"SELECT w, round(average_precision, 6) AS average_precision FROM ({Q.ap_select('pt', ['w'])})")
def e7(spark, sf):
    return _round_all(E.average_precision(fx.scored_windows(spark, sf), group_cols=["w"]))


@register("e7_average_precision_ties", S + "," + Q.points_sql("pt", "scored", []) + "\n" +
          f"SELECT round(average_precision, 6) AS average_precision FROM ({Q.ap_select('pt', [])})")
def e7t(spark, sf):
    return _round_all(E.average_precision(fx.scored(spark, sf)))


@register("e8_roc_curve", S + "," + Q.points_sql("pt", "scored", []) + """
SELECT round(score, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM pt
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def e8(spark, sf):
    return _round_all(E.roc_curve(fx.scored(spark, sf)))


@register("e9_pr_curve", S + "," + Q.points_sql("pt", "scored", []) + """
SELECT round(score, 6) AS threshold, round(tp / P, 6) AS recall, round(tp / (tp + fp), 6) AS precision,
       round(P / (P + N), 6) AS chance_level FROM pt""")
def e9(spark, sf):
    return _round_all(E.pr_curve(fx.scored(spark, sf)))


_NEXT = """, nx AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS r FROM pt
  WINDOW w AS (PARTITION BY w ORDER BY score DESC))
"""


@register("e8_roc_curve_corners", SW + "," + Q.points_sql("pt", "scored_windows", ["w"]) + _NEXT + """
SELECT w, round(score, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM nx
WHERE r = 1 OR np IS NULL OR pos * nn <> neg * np
UNION ALL SELECT DISTINCT w, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM pt""")
def e8c(spark, sf):
    return _round_all(E.roc_curve(fx.scored_windows(spark, sf), group_cols=["w"], drop_collinear=True))


@register("e9_pr_curve_ends", SW + "," + Q.points_sql("pt", "scored_windows", ["w"]) + _NEXT + """
SELECT w, round(score, 6) AS threshold, round(tp / P, 6) AS recall, round(tp / (tp + fp), 6) AS precision,
       round(P / (P + N), 6) AS chance_level FROM nx WHERE r = 1 OR np IS NULL OR pos > 0 OR np > 0""")
def e9c(spark, sf):
    return _round_all(E.pr_curve(fx.scored_windows(spark, sf), group_cols=["w"], drop_intermediate=True))


# ---------------------------------------------------------------- E10-E11 thresholds
_GUARDED = _NAN + ", sg AS (SELECT * FROM sn WHERE NOT isnan(prob))"


@register("e10_confusion_at_half", _GUARDED + f"""SELECT w, tp, fp, tn, fn, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM (SELECT w, tp, fp, tn, fn, {Q.scores_cols()} FROM ({Q.counts_sql('sg', ['w'])}))""")
def e10(spark, sf):
    return _round_all(E.confusion_at(_with_nan(spark, sf), 0.5, group_cols=["w"]))


@register("e11_best_threshold", _GUARDED + "," + Q.best_sql("bt", "sg", ["w"]) + """
SELECT w, round(best_accuracy, 6) AS best_accuracy, round(best_accuracy_theta, 6) AS best_accuracy_theta,
       round(precision, 6) AS precision, round(recall, 6) AS recall FROM bt""")
def e11(spark, sf):
    return _round_all(E.best_threshold(_with_nan(spark, sf), group_cols=["w"]))


# ---------------------------------------------------------------- E12-E19 multi-class
_REC = SM + """, rec AS (SELECT id, y, CAST(cls - 1 AS INTEGER) AS cls, score, CAST(y = cls - 1 AS INTEGER) AS label FROM (
  SELECT id, y, unnest(probs) AS score, unnest(range(1, len(probs) + 1)) AS cls FROM scored_multi)),
pred AS (SELECT id, y, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM scored_multi)
"""


@register("e12_argmax_class", _REC + "SELECT id, pred FROM pred")
def e12(spark, sf):
    return fx.scored_multi(spark, sf).select("id", E.argmax_class("probs").alias("pred"))


def _multi_nan(spark, sf):
    # every seventh row has no score for its third class
    m = fx.scored_multi(spark, sf)
    return m.withColumn("probs", F.transform("probs", lambda v, i: F.when(
        (i == 2) & (F.col("id") % 7 == 0), F.lit(float("nan"))).otherwise(v)))


@register("e12_argmax_nan", SM + """, m AS (SELECT id, list_transform(range(0, len(probs)),
  lambda i: CASE WHEN i = 2 AND id % 7 = 0 THEN -1.0 ELSE probs[i + 1] END) AS p FROM scored_multi)
SELECT id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred FROM m""")
def e12n(spark, sf):
    return _multi_nan(spark, sf).select("id", E.argmax_class("probs").alias("pred"))


@register("e13_one_hot_mae_nan", _REC + "SELECT round(avg(abs(label - score)), 6) AS mae FROM rec WHERE id % 7 <> 0")
def e13n(spark, sf):
    return _round_all(E.one_hot_mae(_multi_nan(spark, sf)))


@register("e13_one_hot_mae", _REC + "SELECT round(avg(abs(label - score)), 6) AS mae FROM rec")
def e13(spark, sf):
    return _round_all(E.one_hot_mae(fx.scored_multi(spark, sf)))


@register("e14_roc_auc_ovo", _REC + """, cls AS (SELECT DISTINCT y AS b FROM scored_multi),
pr AS (SELECT s.y AS a, c.b, s.probs FROM scored_multi s JOIN cls c ON c.b <> s.y),
r2 AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, a AS d, probs[a + 1] AS prob, 1 AS y FROM pr
       UNION ALL SELECT least(a, b), greatest(a, b), b, probs[b + 1], 0 FROM pr),
""" + Q.points_sql("pt", "r2", ["lo", "hi", "d"]) + f""",
auc AS ({Q.auc_select('pt', ['lo', 'hi', 'd'])}),
pair AS (SELECT lo, hi, avg(roc_auc) AS pa FROM auc GROUP BY lo, hi),
n AS (SELECT y AS c, count(*) AS n FROM scored_multi GROUP BY y),
tot AS (SELECT sum(n) AS t FROM n)
SELECT round(sum(pa * (n1.n + n2.n) / t) / sum((n1.n + n2.n) / t), 6) AS roc_auc_ovo
FROM pair JOIN n n1 ON n1.c = pair.lo JOIN n n2 ON n2.c = pair.hi CROSS JOIN tot""")
def e14(spark, sf):
    return _round_all(E.roc_auc_ovo(fx.scored_multi(spark, sf)))


@register("e15_roc_auc_ovr", _REC + ", r2 AS (SELECT cls, score AS prob, label AS y FROM rec),\n" +
          Q.points_sql("pt", "r2", ["cls"]) + f"\nSELECT cls, round(roc_auc, 6) AS roc_auc FROM ({Q.auc_select('pt', ['cls'])})")
def e15(spark, sf):
    return _round_all(E.roc_auc_ovr(fx.scored_multi(spark, sf)))


_AP = _REC + ", r2 AS (SELECT cls, score AS prob, label AS y FROM rec),\n" + Q.points_sql("pt", "r2", ["cls"]) + f""",
ap AS ({Q.ap_select('pt', ['cls'])}),
sup AS (SELECT cls, CAST(sum(label) AS BIGINT) AS support FROM rec GROUP BY cls),
per AS (SELECT ap.cls, ap.average_precision, sup.support FROM ap JOIN sup ON sup.cls = ap.cls)
"""


@register("e16_ap_multiclass", _AP + "SELECT cls, round(average_precision, 6) AS average_precision, support FROM per")
def e16(spark, sf):
    per, _ = E.ap_multiclass(fx.scored_multi(spark, sf))
    return _round_all(per)


@register("e16_ap_multiclass_summary", _AP + """SELECT round(sum(average_precision * support) / sum(support), 6) AS ap_weighted,
  round(avg(average_precision), 6) AS ap_macro FROM per""")
def e16s(spark, sf):
    _, s = E.ap_multiclass(fx.scored_multi(spark, sf))
    return _round_all(s)


_PC = _REC + """, ct AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY y, pred),
t AS (SELECT y AS cls, sum(n) AS support, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS tp FROM ct GROUP BY y),
p AS (SELECT pred AS cls, sum(n) AS predicted FROM ct GROUP BY pred),
pc AS (SELECT coalesce(t.cls, p.cls) AS cls, CAST(coalesce(support, 0) AS BIGINT) AS support,
              CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted
       FROM t FULL JOIN p ON p.cls = t.cls),
pcs AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM pc)
"""


def _pcs(spark, sf):
    m = fx.scored_multi(spark, sf).select("id", "y", E.argmax_class("probs").alias("pred"))
    return E.per_class_scores(m)


@register("e17_f1_multiclass", _PC + "SELECT cls, support, round(f1, 6) AS f1 FROM pcs")
def e17(spark, sf):
    return _round_all(_pcs(spark, sf).select("cls", "support", "f1"))


@register("e18_precision_recall_multiclass", _PC + """SELECT cls, predicted, round(precision, 6) AS precision,
  round(recall, 6) AS recall FROM pcs""")
def e18(spark, sf):
    return _round_all(_pcs(spark, sf).select("cls", "predicted", "precision", "recall"))


@register("e19_accuracy", _PC + """SELECT
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(sum(precision * support) / sum(support), 6) AS precision_weighted,
  round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(avg(f1), 6) AS f1_macro,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy FROM pcs""")
def e19(spark, sf):
    m = fx.scored_multi(spark, sf).select("id", "y", E.argmax_class("probs").alias("pred"))
    return _round_all(E.multiclass_summary(m))


# ---------------------------------------------------------------- E20-E22 distributions
_NORM = "list_transform({a}, lambda v: v / (list_sum({a}) + 1e-14))"
_CDF = "list_transform(range(1, len({a}) + 1), lambda i: list_sum(({a})[1:i]))"
_OH = "list_transform(range(0, len(probs)), lambda i: CASE WHEN i = y THEN 1.0 ELSE 0.0 END)"

_DIST = SM + f""", nd AS (SELECT id, {_NORM.format(a='probs')} AS a, {_NORM.format(a=_OH)} AS b FROM scored_multi),
cd AS (SELECT id, {_CDF.format(a='a')} AS ca, {_CDF.format(a='b')} AS cb FROM nd),
df AS (SELECT id, list_transform(range(1, len(ca) + 1), lambda i: ca[i] - cb[i]) AS d FROM cd)
"""


@register("e20_norm_entropy", SM + f""", nd AS (SELECT id, {_NORM.format(a='probs')} AS p, len(probs) AS n FROM scored_multi)
SELECT round(avg(list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0.0 END)) / ln(n)), 6)
  AS norm_entropy FROM nd""")
def e20(spark, sf):
    return _round_all(E.norm_entropy(fx.scored_multi(spark, sf)))


@register("e21_wasserstein", _DIST + """SELECT round(avg(list_sum(list_transform(d, lambda x: abs(x)))), 6) AS wasserstein FROM df""")
def e21(spark, sf):
    m = fx.scored_multi(spark, sf).withColumn("target", E.one_hot("y", 10))
    return _round_all(E.wasserstein(m))


@register("e22_energy_distance", _DIST + """SELECT round(avg(sqrt(list_sum(list_transform(d, lambda x: x * x)))) * sqrt(2), 6)
  AS energy FROM df""")
def e22(spark, sf):
    m = fx.scored_multi(spark, sf).withColumn("target", E.one_hot("y", 10))
    return _round_all(E.energy_distance(m))


# ---------------------------------------------------------------- E23-E26 tables
@register("e23_value_histogram", RG + """, st AS (
  SELECT min(y) AS mn, max(y) AS mx, count(*) AS n, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM regressed),
nb AS (SELECT *, CASE WHEN mx - mn > 0 THEN greatest(ceil((mx - mn) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)), 1) ELSE 1 END AS k
       FROM (SELECT *, (mx - mn) / (log2(n) + 1.0) AS sturges, 2.0 * iqr * pow(n, -1.0 / 3.0) AS fd FROM st)),
b AS (SELECT CAST(CASE WHEN mx - mn > 0 THEN least(floor((y - mn) / (mx - mn) * k), k - 1) ELSE 0 END AS INTEGER) AS bin
      FROM regressed, nb),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
allb AS (SELECT CAST(unnest(range(0, CAST(k AS BIGINT))) AS INTEGER) AS bin, mn, mx, k FROM nb)
SELECT a.bin, round(mn + (mx - mn) / k * a.bin, 6) AS lo, round(mn + (mx - mn) / k * (a.bin + 1), 6) AS hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count FROM allb a LEFT JOIN c ON c.bin = a.bin""")
def e23(spark, sf):
    return _round_all(E.value_histogram(fx.regressed(spark, sf), "y", "auto"))


@register("e23_value_histogram_grouped", RG + """, v AS (SELECT id % 5 AS g, ln(y + 1) AS y FROM regressed),
st AS (SELECT g, min(y) AS mn, max(y) AS mx, count(*) AS n, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM v GROUP BY g),
nb AS (SELECT *, greatest(ceil((mx - mn) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)), 1) AS k
       FROM (SELECT *, (mx - mn) / (log2(n) + 1.0) AS sturges, 2.0 * iqr * pow(n, -1.0 / 3.0) AS fd FROM st)),
c AS (SELECT g, CAST(least(floor((y - mn) / (mx - mn) * k), k - 1) AS INTEGER) AS bin, count(*) AS cnt FROM v JOIN nb USING (g) GROUP BY ALL),
allb AS (SELECT g, CAST(unnest(range(0, CAST(k AS BIGINT))) AS INTEGER) AS bin, mn, mx, k FROM nb)
SELECT g, bin, round(mn + (mx - mn) / k * bin, 6) AS lo, round(mn + (mx - mn) / k * (bin + 1), 6) AS hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count FROM allb LEFT JOIN c USING (g, bin)""")
def e23g(spark, sf):
    d = fx.regressed(spark, sf).select((F.col("id") % 5).alias("g"), "y")
    return _round_all(E.value_histogram(d, "y", "auto", ["g"], log_scale=True))


_KDE = """, st AS (SELECT g, min(v) AS mn, max(v) AS mx, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM v GROUP BY g),
cl AS (SELECT g, mn + (least(floor((v - mn) / ((mx - mn) / 1024)), 1023) + 0.5) * ((mx - mn) / 1024) AS m, count(*) AS c
       FROM v JOIN st USING (g) GROUP BY 1, 2),
gr AS (SELECT st.*, CAST(i AS INTEGER) AS point, mn + i * (mx - mn) / 199 AS x FROM st, range(0, 200) t(i))
SELECT gr.g, point, round(any_value(x), 4) AS x,
  round(sum(c * exp(-0.5 * (x - m) * (x - m) / (bw * bw))) / any_value(n * bw * sqrt(2 * pi())), 6) AS density
FROM gr JOIN cl ON cl.g = gr.g GROUP BY gr.g, point"""


@register("e23_density_curve", fx.with_views("scored_windows") + ", v AS (SELECT y AS g, prob AS v FROM scored_windows)" + _KDE)
def e23d(spark, sf):
    d = E.density_curve(fx.scored_windows(spark, sf).select(F.col("y").alias("g"), "prob"), "prob", ["g"])
    return d.select("g", "point", F.round("x", 4).alias("x"), r6("density").alias("density"))


@register("e23_density_curve_log", RG + ", v AS (SELECT id % 3 AS g, ln(y + 1) AS v FROM regressed)" + _KDE)
def e23l(spark, sf):
    d = E.density_curve(fx.regressed(spark, sf).select((F.col("id") % 3).alias("g"), "y"), "y", ["g"], log_scale=True)
    return d.select("g", "point", F.round("x", 4).alias("x"), r6("density").alias("density"))


@register("e24_prob_histogram_nan", _NAN + """, sg AS (SELECT * FROM sn WHERE NOT isnan(prob)),
st AS (SELECT min(prob) AS mn, max(prob) AS mx, count(*) AS n FROM sg),
b AS (SELECT y AS cls, CAST(least(floor((prob - mn) / (mx - mn) * 40), 39) AS INTEGER) AS bin, n FROM sg, st)
SELECT cls, bin, count(*) AS count, round(sum(count(*)) OVER (PARTITION BY cls) * 100.0 / any_value(n), 6) AS class_pct
FROM b GROUP BY cls, bin""")
def e24n(spark, sf):
    return _round_all(E.prob_histogram_by_class(_with_nan(spark, sf)))


@register("e24_prob_histogram_by_class", SW + """, st AS (SELECT min(prob) AS mn, max(prob) AS mx, count(*) AS n FROM scored_windows),
b AS (SELECT y AS cls, CAST(CASE WHEN mx - mn > 0 THEN least(floor((prob - mn) / (mx - mn) * 40), 39) ELSE 0 END AS INTEGER) AS bin, n
      FROM scored_windows, st)
SELECT c.cls, c.bin, c.count, round(s.class_pct, 6) AS class_pct FROM
  (SELECT cls, bin, count(*) AS count FROM b GROUP BY cls, bin) c
  JOIN (SELECT cls, count(*) * 100.0 / any_value(n) AS class_pct FROM b GROUP BY cls) s ON s.cls = c.cls""")
def e24(spark, sf):
    return _round_all(E.prob_histogram_by_class(fx.scored_windows(spark, sf)))


@register("e25_residuals", RG + """SELECT id, y - pred AS residual, (y - pred) / nullif(sigma, 0) AS std_residual,
  abs(y - pred) AS abs_error, abs(y - pred) / nullif(sigma, 0) AS abs_norm_error,
  pred - sigma * 3 AS band_lo, pred + sigma * 3 AS band_hi FROM regressed""")
def e25(spark, sf):
    # row-wise arithmetic: identical IEEE operations in both engines, compared unrounded
    return E.residuals(fx.regressed(spark, sf)).drop("y", "pred", "sigma")


@register("e26_ordinal_expectation", SM + """, ev AS (
  SELECT id, probs, list_sum(list_transform(range(0, len(probs)), lambda i: probs[i + 1] * i)) AS e FROM scored_multi)
SELECT id, round(e, 6) AS expected,
  round(sqrt(list_sum(list_transform(range(0, len(probs)), lambda i: probs[i + 1] * (i - e) * (i - e)))), 6) AS spread
FROM ev""")
def e26(spark, sf):
    ev, sd = E.ordinal_expectation("probs")
    return _round_all(fx.scored_multi(spark, sf).select("id", ev.alias("expected"), sd.alias("spread")))


# ---------------------------------------------------------------- E27-E29 store, report, windows
_WIDE_W = _GUARDED + "," + Q.binary_wide_sql("sg", ["w"]) + ",\n" + Q.metric_rows_sql(["w"]) + "\n"


@register("e27_aggregate_metrics", _WIDE_W + """SELECT metric, round(sum(score * weight) / sum(weight), 6) AS score
FROM mrows GROUP BY metric HAVING sum(score * weight) / sum(weight) IS NOT NULL""")
def e27(spark, sf):
    rows = E.binary_metric_rows(_with_nan(spark, sf), ["w"], prefix="")
    return E.aggregate_metrics(rows.where(~F.col("metric").isin("examples", "nan_scores")))


#: The metric rows of a group as columns.
PIVOT = ", ".join(f'round(max(CASE WHEN metric = \'{m}\' THEN score END), 6) AS "{m}"' for m in Q.BINARY_METRICS)


@register("e28_metric_report", _WIDE_W + f"""SELECT w, {PIVOT}, max(examples) AS examples,
  (SELECT CAST(count_if(isnan(prob)) AS DOUBLE) FROM sn WHERE sn.w = q.w) AS nan_scores FROM (
  SELECT m.w, m.metric, sum(m.score * m.weight) / sum(m.weight) AS score, any_value(wd.examples) AS examples
  FROM mrows m JOIN wide wd ON wd.w = m.w GROUP BY m.w, m.metric) q GROUP BY w""")
def e28(spark, sf):
    rows = E.binary_metric_rows(_with_nan(spark, sf), ["w"], prefix="")
    agg = E.aggregate_metrics(rows, ["w"])
    return E.metric_report(agg, E.BINARY_METRICS + ["examples", "nan_scores"], ["w"])


_WIN = SW + """, lim AS (SELECT max(d) + 1 AS e FROM scored_windows),
win AS (SELECT ws AS window_start, least(ws + to_months(24), e) AS window_end FROM (
  SELECT CAST(DATE '1995-01-01' + to_months(CAST(24 * k AS INTEGER)) AS DATE) AS ws, e
  FROM lim, range(0, 1000) t(k)) WHERE ws < e),
sw AS (SELECT s.*, win.window_start FROM scored_windows s JOIN win ON s.d >= win.window_start AND s.d < win.window_end),
""" + Q.binary_wide_sql("sw", ["window_start"]) + ",\n" + Q.metric_rows_sql(["window_start"]) + "\n"


@register("e29_sliding_eval", _WIN + f"""SELECT window_start, {PIVOT}, max(examples) AS examples,
  CAST(0 AS DOUBLE) AS nan_scores FROM (
  SELECT m.window_start, m.metric, sum(m.score * m.weight) / sum(m.weight) AS score, any_value(wd.examples) AS examples
  FROM mrows m JOIN wide wd ON wd.window_start = m.window_start GROUP BY m.window_start, m.metric) GROUP BY window_start""")
def e29(spark, sf):
    return E.sliding_eval(fx.scored_windows(spark, sf), "1995-01-01", None, every=2, unit="year")


# ---------------------------------------------------------------- O1-O9 losses
@register("o1_bce", S + """SELECT round(avg(-(y * greatest(CASE WHEN prob > 0 THEN ln(prob) ELSE -100 END, -100)
  + (1 - y) * greatest(CASE WHEN 1 - prob > 0 THEN ln(1 - prob) ELSE -100 END, -100))), 6) AS bce FROM scored""")
def o1(spark, sf):
    return _round_all(O.bce(fx.scored(spark, sf)))


_LSE = "(list_max(probs) + ln(list_sum(list_transform(probs, lambda v: exp(v - list_max(probs))))))"


@register("o2_cross_entropy", SM + f"SELECT round(avg({_LSE} - probs[y + 1]), 6) AS cross_entropy FROM scored_multi WHERE y <> 9")
def o2(spark, sf):
    return _round_all(O.cross_entropy(fx.scored_multi(spark, sf), logits="probs", ignore_index=9))


@register("o3_l1", RG + "SELECT round(avg(abs(y - pred)), 6) AS l1 FROM regressed")
def o3(spark, sf):
    return _round_all(O.l1(fx.regressed(spark, sf)))


@register("o4_hetero_mae", RG + "SELECT round(avg(abs(y - pred) / sigma + ln(sigma)), 6) AS hetero_mae FROM regressed WHERE sigma > 0")
def o4(spark, sf):
    return _round_all(O.hetero_mae(fx.regressed(spark, sf)))


_SMOOTH = ("list_transform(range(0, 10), lambda i: exp(-((i - y) * (i - y)) / (2 * {s} * {s})) / "
           "list_sum(list_transform(range(0, 10), lambda j: exp(-((j - y) * (j - y)) / (2 * {s} * {s})))))")


@register("o5_smooth_one_hot", SM + f"""SELECT id, CAST(i - 1 AS INTEGER) AS cls, round(v, 6) AS p FROM (
  SELECT id, unnest(sm) AS v, unnest(range(1, 11)) AS i FROM (
    SELECT id, {_SMOOTH.format(s='1.5')} AS sm FROM scored_multi))""")
def o5(spark, sf):
    m = fx.scored_multi(spark, sf).select("id", O.smooth_one_hot("y", 10, 1.5).alias("sm"))
    return m.select("id", F.posexplode("sm").alias("cls", "p")).select("id", "cls", r6("p").alias("p"))


@register("o6_wasserstein_one_hot", _DIST + "SELECT round(avg(list_sum(list_transform(d, lambda x: abs(x)))), 6) AS wasserstein FROM df")
def o6(spark, sf):
    return _round_all(O.wasserstein_one_hot(fx.scored_multi(spark, sf)))


_WS = SM + f""", t AS (SELECT id, y, probs, 1.0 AS sigma, {_SMOOTH.format(s='(1.0 * 2.0)')} AS tg FROM scored_multi),
nd AS (SELECT id, y, probs, sigma, {_NORM.format(a='probs')} AS a, {_NORM.format(a='tg')} AS b FROM t),
cd AS (SELECT *, {_CDF.format(a='a')} AS ca, {_CDF.format(a='b')} AS cb FROM nd),
wd AS (SELECT *, list_sum(list_transform(range(1, len(ca) + 1), lambda i: abs(ca[i] - cb[i]))) AS w FROM cd)
"""


@register("o7_wasserstein_ce", _WS + f"SELECT round(0.7 * avg({_LSE} - probs[y + 1]) + 0.3 * avg(w), 6) AS wasserstein_ce FROM wd")
def o7(spark, sf):
    m = fx.scored_multi(spark, sf).withColumn("sigma", F.lit(1.0))
    return _round_all(O.wasserstein_ce(m, 10, logits="probs", beta=0.3, gamma=2.0))


@register("o8_wasserstein_entropy", _WS + """SELECT round(0.7 * avg(list_sum(list_transform(a, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0.0 END)) / ln(10))
  + 0.3 * avg(w), 6) AS wasserstein_entropy FROM wd""")
def o8(spark, sf):
    m = fx.scored_multi(spark, sf).withColumn("sigma", F.lit(1.0))
    return _round_all(O.wasserstein_entropy(m, 10, beta=0.3, gamma=2.0))


@register("o9_wasserstein_sigma", _WS + "SELECT round(0.7 * avg(sigma) + 0.3 * avg(w), 6) AS wasserstein_sigma FROM wd")
def o9(spark, sf):
    m = fx.scored_multi(spark, sf).withColumn("sigma", F.lit(1.0))
    return _round_all(O.wasserstein_sigma(m, 10, beta=0.3, gamma=2.0))
