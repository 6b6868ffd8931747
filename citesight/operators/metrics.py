"""Evaluation over prediction tables.

Every metric takes a prediction DataFrame plus ``group_cols`` (evaluation
window, epoch, ...) and returns one row per group: all windows are scored by
one grouped plan. Rank metrics (ROC / PR) first collapse rows to distinct
scores per group (pre-aggregated map-side), then take running sums with the
range-partitioned recipe of ``plans.rowindex`` (no one-partition window).
Multi-class metrics explode each row into a bounded number of class (or class
pair) records and reuse the binary machinery grouped by class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from citesight.functions.columns import once, col, with_scalars
from citesight.plans.joins import null_safe_join
from citesight.plans.rowindex import cumulative_sums, pin, with_next
from citesight.plans.selection import quantiles


def _g(group_cols) -> list[str]:
    return list(group_cols or [])


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b = 0 (zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


# ----------------------------------------------------------------- E1-E5
def nan_guard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any listed value is NaN (or null)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & _present(df, c)
    return df.where(cond)


def _present(df: DataFrame, c: str) -> Column:
    """Neither null nor NaN; for a list: neither is, nor any of its entries."""
    if isinstance(df.schema[c].dataType, ArrayType):
        return F.col(c).isNotNull() & F.forall(F.col(c).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def nan_report(df: DataFrame, cols: Sequence[str], group_cols=None) -> DataFrame:
    """Rows and NaN count per column (a list counts when an entry is NaN)."""
    def nan(c):
        if isinstance(df.schema[c].dataType, ArrayType):
            return F.exists(F.col(c).cast("array<double>"), F.isnan)
        return F.isnan(F.col(c).cast("double"))
    return df.groupBy(*_g(group_cols)).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(nan(c)).alias(f"{c}_nan") for c in cols])


def mae(df: DataFrame, y="y", p="pred", group_cols=None) -> DataFrame:
    """Mean absolute error."""
    return df.groupBy(*_g(group_cols)).agg(F.avg(F.abs(col(y) - col(p))).alias("mae"))


def wape(df: DataFrame, y="y", p="pred", group_cols=None) -> DataFrame:
    """100 * sum |y - p| / sum y."""
    return df.groupBy(*_g(group_cols)).agg(
        (F.try_divide(F.sum(F.abs(col(y) - col(p))), F.sum(col(y))) * 100).alias("wape"))


def sigma_capture(df: DataFrame, y="y", p="pred", sigma="sigma", group_cols=None) -> DataFrame:
    """Mean sigma and share of rows with ``p - 3s <= y <= p + 3s``."""
    inside = (col(y) <= col(p) + col(sigma) * 3) & (col(y) >= col(p) - col(sigma) * 3)
    return df.groupBy(*_g(group_cols)).agg(F.avg(sigma).alias("sigma_mean"),
                                           F.avg(inside.cast("double")).alias("capture_3sd"))


def softmax(logits) -> Column:
    """E5: softmax of a logit array."""
    def shares(e):
        return once(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s))

    def powers(x):
        return once(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return once(col(logits), lambda x: once(powers(x), shares))


def argmax_class(probs) -> Column:
    """Index of the first maximum (0-based) among the scores that are numbers; null without one."""
    p = F.transform(col(probs), lambda v: F.when(~F.isnan(v.cast("double")), v))
    at = once(p, lambda q: F.array_position(q, F.array_max(q)) - 1)
    return once(at, lambda i: F.when(i != -1, i)).cast("int")


# ----------------------------------------------------------------- binary rank metrics
def _counted(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score.cast("double"))


def _raw_points(df: DataFrame, y, score, g: list[str]) -> DataFrame:
    """Distinct scores of each group with their positives and negatives, staged once."""
    return pin(df.where(_counted(col(score))).groupBy(*g, col(score).alias("score")).agg(
        F.count_if(col(y) == 1).alias("pos"), F.count_if(~(col(y) == 1) | col(y).isNull()).alias("neg")))


def _ranked(raw: DataFrame, g: list[str]) -> DataFrame:
    """The points with TP and FP of ``score >= t``: running sums from the highest score down."""
    t = cumulative_sums(raw.withColumn("_down", -F.col("score").cast("double")), ["_down"], ["pos", "neg"], g)
    return t.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp"}).drop("_down")


def _points(df: DataFrame, y, score, g: list[str]) -> DataFrame:
    return _ranked(_raw_points(df, y, score, g), g)


def _with_totals(pts: DataFrame, raw: DataFrame, g: list[str]) -> DataFrame:
    """P and N of the group beside each point."""
    totals = raw.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return null_safe_join(pts, totals, g) if g else with_scalars(pts, totals)


def rank_metrics(df: DataFrame, y="y", score="prob", group_cols=None) -> DataFrame:
    """E6 + E7 from one score curve (one running-sum pass): ``roc_auc``, ``average_precision``.

    The area counts, per positive, the negatives below it and half of those that tie."""
    g = _g(group_cols)
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    a = _points(df, y, score, g).groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2.0)).alias("_above"),
        F.sum(F.col("pos") * prec).alias("_s"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pairs = F.col("P").cast("double") * F.col("N")
    return a.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0), (pairs - F.col("_above")) / pairs).alias("roc_auc"),
                    F.when(F.col("P") > 0, F.col("_s") / F.col("P")).alias("average_precision"))


def roc_auc(df: DataFrame, y="y", score="prob", group_cols=None) -> DataFrame:
    """Area under the ROC curve, ties count one half; null with one class."""
    return rank_metrics(df, y, score, group_cols).drop("average_precision")


def average_precision(df: DataFrame, y="y", score="prob", group_cols=None) -> DataFrame:
    """Sum over distinct scores (descending) of (R_n - R_n-1) * P_n; null without positives."""
    return rank_metrics(df, y, score, group_cols).drop("roc_auc")


def _thinned(pts: DataFrame, g: list[str], keep: Column) -> DataFrame:
    """Points that ``keep`` holds for, and the first and the last of each group.

    ``keep`` sees a point's ``pos`` and ``neg`` and those of the next lower score as ``next_pos`` and
    ``next_neg``, also where the next point lies in another bucket of a large group."""
    n = with_next(pts.withColumn("_down", -F.col("score").cast("double")), ["_down"], ["pos", "neg"], g)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return n.where(first | F.col("next_pos").isNull() | keep).drop("_down", "next_pos", "next_neg")


def roc_curve(df: DataFrame, y="y", score="prob", group_cols=None, drop_collinear: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (inf, 0, 0) start.

    ``drop_collinear`` leaves out the points on a straight line between their neighbours; the curve
    and its area stay the same, and its rows follow its corners, not the number of scores."""
    g = _g(group_cols)
    raw = _raw_points(df, y, score, g)
    c = _ranked(raw, g)
    if drop_collinear:
        c = _thinned(pin(c), g, F.col("pos") * F.col("next_neg") != F.col("neg") * F.col("next_pos"))
    pts = _with_totals(c, raw, g).select(
        *g, F.col("score").cast("double").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"))
    start = raw.select(*g).distinct().select(*g, F.lit(float("inf")).alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start if g else start.limit(1))


def pr_curve(df: DataFrame, y="y", score="prob", group_cols=None, drop_intermediate: bool = False) -> DataFrame:
    """(threshold, recall, precision) at every distinct score, and the chance level (prevalence).

    ``drop_intermediate`` leaves out the points inside a run of equal recall, of which only the ends
    show (the run is a vertical line)."""
    g = _g(group_cols)
    raw = _raw_points(df, y, score, g)
    c = _ranked(raw, g)
    if drop_intermediate:
        c = _thinned(pin(c), g, (F.col("pos") > 0) | (F.col("next_pos") > 0))
    return _with_totals(c, raw, g).select(
        *g, F.col("score").cast("double").alias("threshold"), F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("recall"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        (F.col("P") / (F.col("P") + F.col("N"))).alias("chance_level"))


# ----------------------------------------------------------------- thresholded binary
#: 20 thresholds from 0.25 (inclusive) to 0.75 (exclusive).
THETAS = [i * 0.025 + 0.25 for i in range(20)]


def _binary_scores(tp, fp, tn, fn) -> dict[str, Column]:
    pos, neg = tp + fn, tn + fp
    rec_pos = F.when(pos > 0, tp / pos.cast("double"))
    rec_neg = F.when(neg > 0, tn / neg.cast("double"))
    n_cls = F.when(pos > 0, 1).otherwise(0) + F.when(neg > 0, 1).otherwise(0)
    bacc = F.try_divide(F.coalesce(rec_pos, F.lit(0.0)) + F.coalesce(rec_neg, F.lit(0.0)), n_cls)
    return {
        "balanced_accuracy": bacc,
        "precision": _div0(tp, tp + fp),
        "recall": _div0(tp, tp + fn),
        "f1": _div0(2 * tp, 2 * tp + fp + fn),
    }


def _labelled(y) -> Column:
    return F.coalesce(col(y) == 1, F.lit(False))


def _cell(score, thetas: Sequence[float]) -> Column:
    """How many of the ascending ``thetas`` the score exceeds."""
    out = F.when(~_counted(col(score)), None)
    for i in range(len(thetas), 0, -1):
        out = out.when(col(score) > F.lit(thetas[i - 1]), i)
    return out.otherwise(0)


def _cells(df: DataFrame, g: list[str], y, score, thetas: Sequence[float], more: Sequence[Column] = (),
           sums: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``cells`` (a score above exactly ``at`` thetas, its positives and negatives), P, N.

    Rows are counted by (group, cell) with map-side combine, so a row costs one addition however many
    thresholds there are; the confusion at a threshold adds up the cells above it. ``more`` are further
    aggregates of the first step, whose ``sums`` are added up in the second."""
    t = _labelled(y)
    ok = _counted(col(score))
    a = df.withColumn("_at", _cell(score, thetas)).groupBy(*g, "_at").agg(
        F.count_if(ok & t).alias("pos"), F.count_if(ok & ~t).alias("neg"), *more)
    return a.groupBy(*g).agg(F.collect_list(F.struct(F.col("_at").alias("at"), "pos", "neg")).alias("cells"),
                             F.sum("pos").alias("P"), F.sum("neg").alias("N"), *[F.sum(c).alias(c) for c in sums])


def _best(thetas: Sequence[float], order: Sequence[int]) -> Column:
    """Struct of the best of the ascending ``thetas`` from ``cells``, P and N: the first by ``order`` on ties."""
    def above(i, c):
        return F.aggregate(F.filter("cells", lambda x: x["at"] > i), F.lit(0).cast("long"), lambda acc, x: acc + x[c])

    def score(th):
        tp, fp = above(th["i"], "pos"), above(th["i"], "neg")
        s = _binary_scores(tp, fp, F.col("N") - fp, F.col("P") - tp)
        return F.struct(s["balanced_accuracy"].alias("acc"), (-th["nr"]).alias("nr"), th["theta"].alias("theta"),
                        s["precision"].alias("precision"), s["recall"].alias("recall"))
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("nr"), F.lit(v).alias("theta"))
                     for i, (v, n) in enumerate(zip(thetas, order))])
    return F.array_max(F.transform(rows, score))


def confusion_at(df: DataFrame, theta: float = 0.5, y="y", score="prob", group_cols=None) -> DataFrame:
    """Predicted positive when ``score > theta``; balanced accuracy, F1, precision, recall.

    Rows without a score (NaN or null) are left out: Spark orders NaN above all numbers."""
    g = _g(group_cols)
    p, t = col(score) > F.lit(theta), _labelled(y)
    a = df.where(_counted(col(score))).groupBy(*g).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
                                                       F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))
    s = _binary_scores(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return a.select(*g, "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in s.items()])


def best_threshold(df: DataFrame, y="y", score="prob", group_cols=None,
                   thetas: Sequence[float] | None = None) -> DataFrame:
    """Best balanced accuracy over ``thetas`` (first on ties), its theta, precision and recall.

    Rows without a score (NaN or null) are left out.
    """
    g, th = _g(group_cols), list(THETAS if thetas is None else thetas)
    order = sorted(range(len(th)), key=lambda i: th[i])
    th = [th[i] for i in order]
    a = _cells(df.where(_counted(col(score))), g, y, score, th)
    return a.select(*g, _best(th, order).alias("b")).select(
        *g, F.col("b.acc").alias("best_accuracy"), F.col("b.theta").alias("best_accuracy_theta"), "b.precision", "b.recall")


# ----------------------------------------------------------------- multi-class
def class_records(df: DataFrame, probs="probs", y="y", group_cols=None) -> DataFrame:
    """One record per (row, class): (class, score = p_class, label = y == class); rows without a label
    or with a score that is no number are guarded out (E1)."""
    g = _g(group_cols)
    return nan_guard(df, [y, probs]).select(*g, F.col(y).alias("_y"), F.posexplode(probs).alias("cls", "score")).select(
        *g, "cls", "score", (F.col("_y") == F.col("cls")).cast("int").alias("label"))


def one_hot_mae(df: DataFrame, probs="probs", y="y", group_cols=None) -> DataFrame:
    """Mean |one_hot(y) - p| over rows and classes."""
    g = _g(group_cols)
    r = class_records(df, probs, y, g)
    return r.groupBy(*g).agg(F.avg(F.abs(F.col("label") - F.col("score"))).alias("mae"))


def roc_auc_ovr(df: DataFrame, probs="probs", y="y", group_cols=None) -> DataFrame:
    """One-vs-rest AUC per class."""
    g = _g(group_cols)
    return roc_auc(class_records(df, probs, y, g), "label", "score", [*g, "cls"])


def roc_auc_ovo(df: DataFrame, probs="probs", y="y", group_cols=None, weighted: bool = True) -> DataFrame:
    """One-vs-one AUC over class pairs present in y; both directions averaged,
    pairs weighted by their share of rows (or plain mean)."""
    g = _g(group_cols)
    df = nan_guard(df, [y, probs])
    own = F.col(y).cast("int")
    # the classes that occur in a group: bounded by the class count, carried as one array
    seen = df.groupBy(*g).agg(F.collect_set(own).alias("_classes"))
    rows = null_safe_join(df.select(*g, own.alias("a"), F.col(probs).alias("_p")), seen, g) if g else \
        with_scalars(df.select(own.alias("a"), F.col(probs).alias("_p")), seen)
    # each row of class a meets every other class b that occurs, with the two scores of the pair only;
    # direction d scores the pair with p[d]; the row is positive when its class is d
    others = F.transform(F.filter("_classes", lambda b: (b != F.col("a")) & (b < F.size("_p"))), lambda b: F.array(
        F.struct(b.alias("b"), F.col("a").alias("d"), F.get("_p", F.col("a")).alias("score"), F.lit(1).alias("label")),
        F.struct(b.alias("b"), b.alias("d"), F.get("_p", b).alias("score"), F.lit(0).alias("label"))))
    rec = rows.select(*g, "a", F.explode(F.flatten(others)).alias("r")).select(
        *g, F.least("a", "r.b").alias("lo"), F.greatest("a", "r.b").alias("hi"), "r.d", "r.score", "r.label")
    auc = roc_auc(rec, "label", "score", [*g, "lo", "hi", "d"])
    pair = auc.groupBy(*g, "lo", "hi").agg(F.avg("roc_auc").alias("pair_auc"))
    n_cls = df.groupBy(*g, F.col(y).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    tot = n_cls.groupBy(*g).agg(F.sum("n").alias("total"))
    pr = null_safe_join(pair, n_cls.withColumnsRenamed({"c": "lo", "n": "n_lo"}), [*g, "lo"])
    pr = null_safe_join(pr, n_cls.withColumnsRenamed({"c": "hi", "n": "n_hi"}), [*g, "hi"])
    pr = null_safe_join(pr, tot, g) if g else with_scalars(pr, tot)
    prev = (F.col("n_lo") + F.col("n_hi")) / F.col("total")
    if weighted:
        return pr.groupBy(*g).agg((F.sum(F.col("pair_auc") * prev) / F.sum(prev)).alias("roc_auc_ovo"))
    return pr.groupBy(*g).agg(F.avg("pair_auc").alias("roc_auc_ovo"))


def ap_multiclass(df: DataFrame, probs="probs", y="y", group_cols=None) -> tuple[DataFrame, DataFrame]:
    """Per-class average precision, and its support-weighted and macro means."""
    g = _g(group_cols)
    rec = class_records(df, probs, y, g)
    per = average_precision(rec, "label", "score", [*g, "cls"])
    sup = rec.groupBy(*g, "cls").agg(F.sum("label").alias("support"))
    per = null_safe_join(per, sup, [*g, "cls"])
    summary = per.groupBy(*g).agg(
        (F.sum(F.col("average_precision") * F.col("support")) / F.sum("support")).alias("ap_weighted"),
        F.avg("average_precision").alias("ap_macro"))
    return per, summary


def confusion_table(df: DataFrame, y="y", pred="pred", group_cols=None) -> DataFrame:
    """Counts per (true class, predicted class)."""
    g = _g(group_cols)
    return nan_guard(df, [y, pred]).groupBy(*g, F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_scores(df: DataFrame, y="y", pred="pred", group_cols=None) -> DataFrame:
    """Per class (labels seen in y or pred): support, precision, recall, F1."""
    g = _g(group_cols)
    ct = confusion_table(df, y, pred, g)
    t = ct.groupBy(*g, F.col("y").alias("cls")).agg(F.sum("n").alias("support"),
                                                     F.sum(F.when(F.col("y") == F.col("pred"), F.col("n"))
                                                           .otherwise(0)).alias("tp"))
    p = ct.groupBy(*g, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    # a class may be missing on either side: add up instead of joining
    none = F.lit(0).cast("long")
    both = t.select(*g, "cls", "support", "tp", none.alias("predicted")).unionByName(
        p.select(*g, "cls", none.alias("support"), none.alias("tp"), "predicted"))
    j = both.groupBy(*g, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    return j.select(*g, "cls", "support", "tp", "predicted",
                    _div0(F.col("tp"), F.col("predicted")).alias("precision"),
                    _div0(F.col("tp"), F.col("support")).alias("recall"),
                    _div0(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def multiclass_summary(df: DataFrame, y="y", pred="pred", group_cols=None) -> DataFrame:
    """Weighted and macro F1 / precision / recall, accuracy, balanced accuracy."""
    g = _g(group_cols)
    pc = per_class_scores(df, y, pred, g)
    sw = F.sum("support")
    out = pc.groupBy(*g).agg(
        *[(F.sum(F.col(m) * F.col("support")) / sw).alias(f"{m}_weighted") for m in ("f1", "precision", "recall")],
        *[F.avg(m).alias(f"{m}_macro") for m in ("f1", "precision", "recall")],
        (F.sum("tp") / sw).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    return out


# ----------------------------------------------------------------- distribution distances
def _normalised(a: Column) -> Column:
    s = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(a, lambda v: v / (s + F.lit(1e-14)))


def one_hot(y, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == col(y), 1.0).otherwise(0.0))


def cdf_distance(a, b, p: int = 1) -> Column:
    """Per row: p-norm of the difference of the two normalised CDFs, in one pass over the entries:
    the running sum of the differences is the difference of the CDFs. Null where an entry is NaN."""
    gaps = F.zip_with(_normalised(col(a)), _normalised(col(b)), lambda u, v: u - v)
    def power(x):
        return F.abs(x) if p == 1 else x * x if p == 2 else F.pow(F.abs(x), p)
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sum"))
    total = F.aggregate(gaps, start, lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), (acc["sum"] + power(acc["at"] + x)).alias("sum")), lambda acc: acc["sum"])
    total = F.when(~F.isnan(total), total)
    return total if p == 1 else F.sqrt(total) if p == 2 else F.pow(total, 1.0 / p)


def wasserstein(df: DataFrame, probs="probs", target="target", group_cols=None) -> DataFrame:
    """Mean first Wasserstein distance between two distributions per row."""
    return df.groupBy(*_g(group_cols)).agg(F.avg(cdf_distance(probs, target, 1)).alias("wasserstein"))


def energy_distance(df: DataFrame, probs="probs", target="target", group_cols=None) -> DataFrame:
    """Mean sqrt(2) * L2 distance of the CDFs."""
    return df.groupBy(*_g(group_cols)).agg((F.avg(cdf_distance(probs, target, 2)) * (2 ** 0.5)).alias("energy"))


def row_entropy(probs) -> Column:
    """Entropy of the normalised distribution, 0 ln 0 = 0; null where an entry is NaN."""
    p = _normalised(col(probs))
    h = F.aggregate(p, F.lit(0.0), lambda acc, v: acc - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    return F.when(~F.isnan(h), h)


def norm_entropy(df: DataFrame, probs="probs", group_cols=None) -> DataFrame:
    """Mean entropy / ln(number of classes); 0 for a single class, which leaves nothing open."""
    n = F.size(col(probs))
    return df.groupBy(*_g(group_cols)).agg(
        F.avg(F.when(n == 1, F.lit(0.0)).when(n > 1, F.try_divide(row_entropy(probs), F.log(n.cast("double")))))
        .alias("norm_entropy"))


# ----------------------------------------------------------------- tables behind plots
def _numbers(df: DataFrame, value: str, log_scale: bool) -> DataFrame:
    """``value`` as double (``ln(v + 1)`` of it), without null and NaN."""
    v = F.col(value).cast("double")
    df = df.withColumn(value, F.log1p(v) if log_scale else v)
    return df.where(F.col(value).isNotNull() & ~F.isnan(value))


def auto_bins(rng: Column, n: Column, iqr: Column) -> Column:
    """Number of bins of numpy's ``auto`` rule."""
    count = n.cast("double")
    sturges = rng / (F.log2(count) + 1.0)
    fd = 2.0 * iqr * F.pow(count, -1.0 / 3.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return F.when(rng > 0, F.greatest(F.ceil(F.try_divide(rng, width)), F.lit(1))).otherwise(F.lit(1)).cast("int")


def density_curve(df: DataFrame, value: str, group_cols=None, log_scale: bool = False, points: int = 200,
                  cells: int = 1024) -> DataFrame:
    """Gaussian kernel density as a table (x, density), ``points`` places between min and max.

    Scott's bandwidth, ``std * n ** -0.2``. The values are counted in ``cells`` equal cells per group
    (one aggregate after the moments); the curve adds the kernel of each cell's middle, weighted by its
    count, so its cost does not follow the rows. A group of fewer than two different values has no
    curve. ``log_scale``: of ``ln(v + 1)``."""
    g = _g(group_cols)
    clean = _numbers(df, value, log_scale)
    v = F.col(value)
    st = clean.groupBy(*g).agg(F.min(v).alias("_min"), F.max(v).alias("_max"), F.count(F.lit(1)).alias("_n"),
                               F.stddev_samp(v).alias("_sd")).where("_max > _min")
    st = pin(st.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2)))
    j = null_safe_join(clean, st, g) if g else with_scalars(clean, st).where("_max IS NOT NULL")
    width = (F.col("_max") - F.col("_min")) / cells
    cell = F.least(F.floor((v - F.col("_min")) / width), F.lit(cells - 1))
    counts = j.groupBy(*g, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(*g).agg(F.collect_list(F.struct("cell", "n")).alias("_cells"))  # at most `cells` entries
    held = null_safe_join(held, st, g) if g else with_scalars(held, st).where("_max IS NOT NULL")
    middle = F.transform(F.array_sort("_cells"), lambda c: F.struct(
        (F.col("_min") + (c["cell"] + 0.5) * width).alias("m"), c["n"].alias("n")))
    held = held.withColumn("_cells", middle)
    x = F.col("_min") + F.col("_i") * (F.col("_max") - F.col("_min")) / (points - 1)
    grid = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")).withColumn("x", x)
    bell = F.aggregate("_cells", F.lit(0.0), lambda acc, c: acc + c["n"] * F.exp(
        -0.5 * (F.col("x") - c["m"]) * (F.col("x") - c["m"]) / (F.col("_bw") * F.col("_bw"))))
    return grid.select(*g, F.col("_i").alias("point"), "x",
                       (bell / (F.col("_n") * F.col("_bw") * (2 * math.pi) ** 0.5)).alias("density"))


def value_histogram(df: DataFrame, value: str, bins: int | str = "auto", group_cols=None,
                    log_scale: bool = False) -> DataFrame:
    """Histogram table (bin, lo, hi, count) with equal-width bins between min and max.

    ``bins="auto"``: the smaller width of Sturges and Freedman-Diaconis (exact quartiles of each
    group), as numpy does.
    ``log_scale``: the histogram of ``ln(v + 1)``.
    """
    g = _g(group_cols)
    clean = _numbers(df, value, log_scale)
    v = F.col(value)
    st = clean.groupBy(*g).agg(F.min(v).alias("_min"), F.max(v).alias("_max"), F.count(F.lit(1)).alias("_n"))
    if bins == "auto":
        q = quantiles(clean, value, [0.25, 0.75], g).select(*g, (F.col("q1") - F.col("q0")).alias("_iqr"))
        st = null_safe_join(st, q, g) if g else with_scalars(st, q)
        st = st.withColumn("_nb", auto_bins(F.col("_max") - F.col("_min"), F.col("_n"), F.col("_iqr"))).drop("_iqr")
    else:
        st = st.withColumn("_nb", F.lit(int(bins)))
    st = pin(st)
    j = null_safe_join(clean, st, g) if g else with_scalars(clean, st)
    rng = F.col("_max") - F.col("_min")
    b = F.when(rng > 0, F.least(F.floor((v - F.col("_min")) / rng * F.col("_nb")), F.col("_nb") - 1)).otherwise(0)
    counts = j.groupBy(*g, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    allb = st.select(*g, "_min", "_max", "_nb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("bin"))
    out = null_safe_join(allb, counts, [*g, "bin"], "left")
    w = (F.col("_max") - F.col("_min")) / F.col("_nb")
    return out.select(*g, "bin", (F.col("_min") + w * F.col("bin")).alias("lo"),
                      (F.col("_min") + w * (F.col("bin") + 1)).alias("hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def prob_histogram_by_class(df: DataFrame, y="y", score="prob", n_bins: int = 40, group_cols=None) -> DataFrame:
    """``n_bins`` equal bins of the score between its min and max, counts per class,
    with each class's share of rows in percent. Rows without a score (NaN, null) are left out (E1)."""
    g = _g(group_cols)
    df = nan_guard(df, [score])
    s = F.col(score).cast("double")
    st = pin(df.groupBy(*g).agg(F.min(s).alias("_min"), F.max(s).alias("_max"), F.count(F.lit(1)).alias("_n")))
    j = null_safe_join(df, st, g) if g else with_scalars(df, st)
    rng = F.col("_max") - F.col("_min")
    b = F.when(rng > 0, F.least(F.floor((s - F.col("_min")) / rng * n_bins), F.lit(n_bins - 1))).otherwise(0)
    c = j.groupBy(*g, F.col(y).alias("cls"), b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_n").alias("_n"))
    # shares from the counts, one row per bin
    per = Window.partitionBy(*g, "cls")
    return c.withColumn("class_pct", F.sum("count").over(per) * 100.0 / F.col("_n")).drop("_n")


def residuals(df: DataFrame, y="y", p="pred", sigma="sigma") -> DataFrame:
    """Residual, standardised residual, absolute and absolute normalised error, 3-sigma band.

    A sigma of zero has no standardised errors: they are null."""
    r = col(y) - col(p)
    return df.withColumns({
        "residual": r, "std_residual": F.try_divide(r, col(sigma)), "abs_error": F.abs(r),
        "abs_norm_error": F.try_divide(F.abs(r), col(sigma)),
        "band_lo": col(p) - col(sigma) * 3, "band_hi": col(p) + col(sigma) * 3})


def ordinal_expectation(probs, medians: Sequence[float] | None = None) -> tuple[Column, Column]:
    """Expected value ``sum p_i m_i`` and spread ``sqrt(sum p_i (i - E)^2)``
    (class indices around the expectation; medians default to the indices)."""
    p = col(probs)
    if medians is None:
        ev = F.aggregate(F.transform(p, lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)
    else:
        m = F.array(*[F.lit(float(x)) for x in medians])
        ev = F.aggregate(F.zip_with(p, m, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    var = F.aggregate(F.transform(p, lambda v, i: v * (i - ev) * (i - ev)), F.lit(0.0), lambda a, x: a + x)
    return ev, F.sqrt(var)


# ----------------------------------------------------------------- metric store and report
def metric_rows(df: DataFrame, group_cols: Sequence[str], metric_cols: Sequence[str], weight: Column | str,
                prefix: str = "") -> DataFrame:
    """Long form ``(group..., metric, score, weight)`` from a wide metrics frame."""
    g = _g(group_cols)
    w = col(weight)
    st = F.explode(F.array(*[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("score"))
                             for m in metric_cols]))
    return df.select(*g, w.cast("double").alias("weight"), st.alias("s")).select(*g, "s.metric", "s.score", "weight")


def aggregate_metrics(rows: DataFrame, group_cols=None) -> DataFrame:
    """Weight-averaged score per metric, rounded to 6.

    A NaN or null score adds nothing to the sum but keeps its weight in the denominator; a metric
    that has no score at all is dropped."""
    g = _g(group_cols)
    score = F.when(~F.isnan("score"), F.col("score"))
    a = rows.groupBy(*g, "metric").agg(F.try_divide(F.sum(score * F.col("weight")), F.sum("weight")).alias("score"))
    return a.where(F.col("score").isNotNull()).select(*g, "metric", F.round("score", 6).alias("score"))


def metric_report(agg: DataFrame, metrics: Sequence[str], group_cols: Sequence[str]) -> DataFrame:
    """One wide row per group (window/epoch); metric names given explicitly."""
    return agg.groupBy(*group_cols).pivot("metric", list(metrics)).agg(F.first("score"))


def binary_wide(df: DataFrame, group_cols: Sequence[str], y="y", score="prob") -> DataFrame:
    """All binary-classifier metrics of one prediction table, one row per group.

    Counts, MAE, the confusion at one half, the 20 thresholds and the rows without a score are one
    aggregate over the rows; only the rank metrics need their own (the score curve, staged once)."""
    g = list(group_cols)
    ok, t, p = _counted(col(score)), _labelled(y), col(score) > 0.5
    a = _cells(df, g, y, score, THETAS, [
        F.count_if(~ok).alias("gone"), F.sum(F.when(ok, F.abs(col(y) - col(score)))).alias("err"),
        F.count_if(ok & p & t).alias("tp"), F.count_if(ok & p & ~t).alias("fp")], ["gone", "err", "tp", "fp"])
    half = _binary_scores(F.col("tp"), F.col("fp"), F.col("N") - F.col("fp"), F.col("P") - F.col("tp"))
    n = F.col("P") + F.col("N")
    one = a.select(*g, n.alias("examples"), F.col("gone").cast("double").alias("nan_scores"),
                   F.try_divide(F.col("err"), n).alias("MAE"), half["balanced_accuracy"].alias("balanced_accuracy:50"),
                   half["f1"].alias("F1:50"), half["recall"].alias("recall:50"), half["precision"].alias("precision:50"),
                   _best(THETAS, range(len(THETAS))).alias("b"))
    one = one.select(*[f"`{c}`" for c in one.columns if c != "b"], F.col("b.acc").alias("best_accuracy"),
                     F.col("b.theta").alias("best_accuracy_theta"), F.col("b.precision").alias("precision:best_acc"),
                     F.col("b.recall").alias("recall:best_acc"))
    rank = rank_metrics(df, y, score, g).withColumnRenamed("average_precision", "PR_AUC")
    return null_safe_join(one, rank, g, "left") if g else with_scalars(one, rank)


def binary_metric_rows(df: DataFrame, group_cols: Sequence[str], y="y", score="prob", prefix="val_") -> DataFrame:
    """The metrics of ``binary_wide`` as metric rows.

    Rows without a score are guarded out (E1); ``nan_scores`` reports how many there were, also for a
    group that has no others."""
    g = list(group_cols)
    wide = binary_wide(df, g, y, score)
    some = F.col("examples") > 0
    cells = [F.struct(F.lit(prefix + m).alias("metric"), F.when(some, F.col(f"`{m}`").cast("double")).alias("score"),
                      F.col("examples").cast("double").alias("weight")) for m in BINARY_METRICS]
    cells += [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score"), F.lit(1.0).alias("weight"))
              for m in ("examples", "nan_scores")]
    rows = wide.select(*g, "examples", F.explode(F.array(*cells)).alias("s"))
    return rows.where(some | (F.col("s.metric") == "nan_scores")).select(*g, "s.metric", "s.score", "s.weight")


BINARY_METRICS = ["MAE", "roc_auc", "PR_AUC", "balanced_accuracy:50", "F1:50", "recall:50", "precision:50",
                  "best_accuracy", "best_accuracy_theta", "precision:best_acc", "recall:best_acc"]


def sliding_windows(spark, start: str, end: str | None, every: int = 1, unit: str = "year",
                    date_source: DataFrame | None = None, date_col: str = "d") -> DataFrame:
    """E29 window table: ``[s, s + every unit)`` from ``start``, the last clipped to ``end``.

    Without ``end`` the end is the latest date in ``date_source`` plus one day.
    Months use ``add_months`` (29 February start clips to month end).
    """
    months = {"year": 12 * every, "month": every}.get(unit)
    if end is None:
        ends = date_source.agg(F.date_add(F.max(date_col), 1).alias("_end"))
    else:
        ends = spark.range(1).select(F.lit(end).cast("date").alias("_end"))
    base = ends.select(F.lit(start).cast("date").alias("_s"), "_end")
    if months is not None:
        n = F.ceil(F.months_between("_end", "_s") / months).cast("int")
        w = base.select("_s", "_end", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("k"))
        ws = F.add_months("_s", F.col("k") * months)
        we = F.least(F.add_months("_s", (F.col("k") + 1) * months), F.col("_end"))
    else:  # days
        n = F.ceil(F.datediff("_end", "_s") / every).cast("int")
        w = base.select("_s", "_end", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("k"))
        ws = F.date_add("_s", F.col("k") * every)
        we = F.least(F.date_add("_s", (F.col("k") + 1) * every), F.col("_end"))
    return w.select(ws.alias("window_start"), we.alias("window_end")).where(F.col("window_start") < F.col("window_end"))


def assign_windows(df: DataFrame, start: str, end: str | None = None, every: int = 1, unit: str = "year",
                   date_col: str = "d", dates: DataFrame | None = None) -> DataFrame:
    """Each row with the ``window_start`` and ``window_end`` of its window in ``sliding_windows``.

    Windows do not overlap, so a row's window number follows from its date by arithmetic: no join.
    Rows before ``start`` or from the end on are dropped. ``dates``: a cheaper frame with the same dates,
    to find the end in.
    """
    d, s = F.col(date_col), F.lit(start).cast("date")
    months = {"year": 12 * every, "month": every}.get(unit)
    if end is None:
        df = with_scalars(df, (df if dates is None else dates).agg(F.date_add(F.max(date_col), 1).alias("_end")))
    else:
        df = df.withColumn("_end", F.lit(end).cast("date"))
    if months is None:
        k = F.floor(F.datediff(d, s) / every).cast("int")
        first, last = F.date_add(s, k * every), F.date_add(s, (k + 1) * every)
    else:
        # whole months since the start; the start's day may fall on an earlier day in a short month
        whole = (F.year(d) - F.year(s)) * 12 + F.month(d) - F.month(s)
        whole = whole - F.when(F.add_months(s, whole) > d, 1).otherwise(0)
        k = F.floor(whole / months).cast("int")
        first, last = F.add_months(s, k * months), F.add_months(s, (k + 1) * months)
    return (df.where((d >= s) & (d < F.col("_end")))
            .withColumns({"window_start": first, "window_end": F.least(last, F.col("_end"))}).drop("_end"))


def sliding_eval(df: DataFrame, start: str, end: str | None = None, every: int = 1, unit: str = "year",
                 date_col: str = "d", y="y", score="prob") -> DataFrame:
    """Binary metrics and ``examples`` per sliding window, one plan for all windows.

    Each metric has one value per window, so the report (E27, E28) is the rounded row itself."""
    wide = binary_wide(assign_windows(df, start, end, every, unit, date_col), ["window_start"], y, score)
    some = F.col("examples") > 0
    return wide.select("window_start", *[
        F.round(F.when(some & ~F.isnan(f"`{m}`"), F.col(f"`{m}`").cast("double")), 6).alias(m) for m in BINARY_METRICS],
        F.when(some, F.col("examples").cast("double")).alias("examples"), F.col("nan_scores"))
