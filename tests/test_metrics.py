"""Metric edge cases: ties, one-class groups, thresholds, multi-class labels."""

import time
import tempfile
import math

import pytest
from pyspark.sql import functions as F

from citesight.operators import describe as D
from citesight.operators import losses as O
from citesight.operators import metrics as E


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    if not pos or not neg:
        return None
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_ap(ys, ps):
    P = sum(ys)
    out, prev_r = 0.0, 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        r = tp / P
        out += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return out


DATA = [(0, 1, 0.9), (0, 0, 0.9), (0, 1, 0.4), (0, 0, 0.1), (0, 0, 0.4), (0, 1, 0.7),
        (1, 1, 0.5), (1, 1, 0.6),                      # one-class group
        (2, 0, 0.3), (2, 1, 0.3), (2, 0, 0.3)]          # all tied


def frame(spark):
    return spark.createDataFrame(DATA, "g int, y int, prob double")


@pytest.mark.parametrize("parts", [1, 7])
def test_auc_and_ap_match_brute_force(spark, parts):
    df = frame(spark).repartition(parts)
    auc = {r.g: r.roc_auc for r in E.roc_auc(df, group_cols=["g"]).collect()}
    ap = {r.g: r.average_precision for r in E.average_precision(df, group_cols=["g"]).collect()}
    for g in (0, 1, 2):
        ys = [y for gg, y, _ in DATA if gg == g]
        ps = [p for gg, _, p in DATA if gg == g]
        want = brute_auc(ys, ps)
        assert (auc[g] is None and want is None) or math.isclose(auc[g], want)
        assert math.isclose(ap[g], brute_ap(ys, ps))
    assert auc[1] is None and auc[2] == 0.5


def test_best_threshold_strict_and_first_on_tie(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.25), (1, 0.26)], "y int, prob double")
    r = E.best_threshold(df).collect()[0]
    # theta 0.25: 0.25 is not > 0.25 -> perfect; first theta wins
    assert r.best_accuracy == 1.0 and r.best_accuracy_theta == 0.25


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, prob double")
    r = E.confusion_at(df).collect()[0]
    assert (r.precision, r.recall, r.f1, r.balanced_accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_multiclass_absent_class_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, pred int")
    pc = {r.cls: r for r in E.per_class_scores(df).collect()}
    assert pc[2].support == 0 and pc[2].precision == 0.0 and pc[2].f1 == 0.0
    s = E.multiclass_summary(df).collect()[0]
    assert math.isclose(s.balanced_accuracy, (0.5 + 1.0) / 2)


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>")
    r = df.select(E.softmax("l").alias("p")).select("p", E.argmax_class("p").alias("a")).collect()[0]
    assert math.isclose(sum(r.p), 1.0) and r.a == 1


def test_sliding_windows_leap_day(spark):
    w = E.sliding_windows(spark, "2024-02-29", "2026-06-01", every=1, unit="year").collect()
    assert [str(x.window_start) for x in w] == ["2024-02-29", "2025-02-28", "2026-02-28"]
    assert str(w[-1].window_end) == "2026-06-01"


@pytest.mark.parametrize("start, every, unit", [("2024-02-29", 1, "year"), ("2023-10-31", 1, "month"),
                                                ("2023-12-30", 2, "month"), ("2024-01-03", 13, "day")])
def test_window_by_arithmetic_equals_the_window_table(spark, start, every, unit):
    days = spark.range(900).select(F.date_add(F.lit("2023-12-01").cast("date"), F.col("id").cast("int")).alias("d"))
    wins = E.sliding_windows(spark, start, "2026-03-05", every, unit)
    want = days.join(wins, (F.col("d") >= F.col("window_start")) & (F.col("d") < F.col("window_end")))
    got = E.assign_windows(days, start, "2026-03-05", every, unit)
    cols = ["d", "window_start", "window_end"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_odd_values_have_defined_results(spark):
    one = spark.createDataFrame([([1.0],)], "probs array<double>")
    assert E.norm_entropy(one).first().norm_entropy == 0.0
    zero = spark.createDataFrame([(1.0, 3.0, 0.0), (1.0, 3.0, 2.0)], "y double, pred double, sigma double")
    got = sorted(E.residuals(zero).select("sigma", "std_residual", "abs_norm_error").collect())
    assert [tuple(r) for r in got] == [(0.0, None, None), (2.0, -1.0, 1.0)]
    assert O.hetero_mae(zero).first().hetero_mae == pytest.approx(1.0 + math.log(2.0))
    rows = spark.createDataFrame([("a", 0.5, 2.0), ("a", float("nan"), 1.0), ("a", None, 1.0), ("b", float("nan"), 1.0)],
                                 "metric string, score double, weight double")
    assert [tuple(r) for r in E.aggregate_metrics(rows).collect()] == [("a", 0.25)]
    nan = spark.createDataFrame([(1, 0.9), (0, float("nan")), (0, 0.1)], "y int, prob double")
    assert (E.confusion_at(nan).first().fp, E.best_threshold(nan).first().precision) == (0, 1.0)


def test_quantiles_and_ties_of_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "v double")
    r = D.describe_column(df, "v").first()
    assert (r["count"], r.null_count, r.nan_count, r.p25, r.p50, r.max) == (3, 1, 1, 1.5, 2.0, 4.0)
    assert D.describe_column(df, "v", interpolation="nearest").first().p25 in (1.0, 2.0)
    counts = spark.createDataFrame([(49,), (351,)], "count long")
    assert sorted(r.proportion for r in D.bucket_proportions(counts).collect()) == [12.2, 87.8]


def test_wasserstein_identical_is_zero(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.2, 0.8])], "probs array<double>, target array<double>")
    assert E.wasserstein(df).collect()[0][0] == pytest.approx(0.0, abs=1e-12)


def test_nan_scores_are_guarded_and_skipped(spark):
    df = spark.createDataFrame([(1, 0.9), (0, float("nan")), (0, 0.2), (1, float("nan"))], "y int, prob double")
    rep = E.nan_report(df, ["prob"]).collect()[0]
    assert rep.rows == 4 and rep.prob_nan == 2
    assert E.nan_guard(df, ["prob"]).count() == 2
    assert E.roc_auc(df).collect()[0].roc_auc == 1.0          # NaN rows do not enter the curve


def test_describe_all_null_column(spark):
    from citesight.operators import describe as D
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    r = D.describe_column(df, "v").collect()[0]
    assert r["count"] == 0 and r.null_count == 2
    assert r.mean is None and r.p50 is None and r["min"] is None


def test_roc_and_pr_curves_match_brute_force(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)]
    df = spark.createDataFrame(rows, "y int, prob double").repartition(3)
    P = sum(y for y, _ in rows)
    N = len(rows) - P
    roc = {r.threshold: (r.fpr, r.tpr) for r in E.roc_curve(df).collect()}
    pr = {r.threshold: (r.recall, r.precision, r.chance_level) for r in E.pr_curve(df).collect()}
    assert roc[float("inf")] == (0.0, 0.0)
    for t in sorted({p for _, p in rows}):
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        assert roc[t] == (fp / N, tp / P)
        assert pr[t] == (tp / P, tp / (tp + fp), P / len(rows))


def _area(rows):
    pts = sorted((r.fpr, r.tpr) for r in rows)
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))


@pytest.mark.parametrize("split", [5, 10_000])
def test_thinned_curves_keep_area_and_corners(spark, monkeypatch, split):
    import random

    from citesight.plans import rowindex
    rng = random.Random(8)
    # runs of equal labels make straight lines; a low bound cuts the large group into buckets
    rows = [(g, int((i // 7) % 3 == 0), round(rng.random(), 3) if g else i / 300) for g in (0, 1, None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, y int, prob double")
    for f in ("cumulative_sums", "with_next"):
        own = getattr(rowindex, f)
        monkeypatch.setattr(E, f, lambda *a, own=own, **k: own(*a, split_rows=split, **k))
    full, thin = E.roc_curve(df, group_cols=["g"]).collect(), E.roc_curve(df, group_cols=["g"], drop_collinear=True).collect()
    pr, ends = E.pr_curve(df, group_cols=["g"]).collect(), E.pr_curve(df, group_cols=["g"], drop_intermediate=True).collect()
    auc = {r.g: r.roc_auc for r in E.roc_auc(df, group_cols=["g"]).collect()}
    for g in (0, 1, None):
        a, b = [r for r in full if r.g == g], [r for r in thin if r.g == g]
        assert set(b) < set(a) and math.isclose(_area(a), _area(b)) and math.isclose(_area(b), auc[g])
        assert max(r.tpr for r in b) == 1.0 and min(r.fpr for r in b) == 0.0
        c, d = [r for r in pr if r.g == g], [r for r in ends if r.g == g]
        assert set(d) < set(c) and {r.recall for r in c} == {r.recall for r in d}
    assert len([r for r in thin if r.g == 0]) < 0.5 * len([r for r in full if r.g == 0])


def test_metrics_of_a_null_group_and_of_rows_without_scores(spark):
    nan = float("nan")
    rows = [(None, 1, 0.9), (None, 0, 0.2), (None, 0, None), (1, 1, nan), (1, 0, None), (2, 1, 0.8), (2, 1, nan)]
    df = spark.createDataFrame(rows, "g int, y int, prob double")
    assert {r.g: r.roc_auc for r in E.roc_auc(df, group_cols=["g"]).collect()} == {None: 1.0, 2: None}
    rep = E.metric_report(E.aggregate_metrics(E.binary_metric_rows(df, ["g"], prefix=""), ["g"]),
                          E.BINARY_METRICS + ["examples", "nan_scores"], ["g"])
    got = {r.g: r.asDict() for r in rep.collect()}
    assert (got[None]["roc_auc"], got[None]["PR_AUC"], got[None]["examples"], got[None]["nan_scores"]) == (1.0, 1.0, 2.0, 1.0)
    assert (got[1]["MAE"], got[1]["examples"], got[1]["nan_scores"]) == (None, None, 2.0)
    assert got[2]["best_accuracy"] == 1.0 and got[2]["nan_scores"] == 1.0


def test_all_binary_metrics_take_one_aggregate_over_the_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr(
        "o_orderdate as g", "cast(o_orderstatus = 'F' as int) as y", "o_totalprice / 1e6 as prob")
    text = E.binary_wide(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 2  # the rows once, the staged score curve once


def test_softmax_works_each_level_out_once(spark):
    # a level that is worked out again per element made a row of ten classes cost 0.1 s
    from citesight.sources import fixtures as fx
    path = tempfile.mkdtemp(prefix="citesight-test-")
    spark.range(2_000).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> cast((id * 31 + i * 7) % 97 + 1 as float)) AS embedding",
                                  "cast(id % 10 as int) AS label").write.parquet(f"{path}/embeddings.parquet")
    began = time.time()
    got = {r.id: (r.p, r.a) for r in fx.scored_multi(spark, path).select("id", E.softmax("probs").alias("p")).select(
        "id", "p", E.argmax_class("p").alias("a")).collect()}
    assert time.time() - began < 20
    for i in (0, 5, 1_999):
        m = [float((i * 31 + k * 7) % 97 + 1) for k in range(64)]
        e = [sum(m[c::10]) for c in range(10)]
        x = [math.exp(v / sum(e)) for v in e]
        assert got[i][0] == pytest.approx([v / sum(x) for v in x], abs=1e-12) and got[i][1] == e.index(max(e))
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [])], "id int, l array<double>")
    assert {r.id: r.p for r in odd.select("id", E.softmax("l").alias("p")).collect()} == {1: None, 2: [None, None], 3: []}
