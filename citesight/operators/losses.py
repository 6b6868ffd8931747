"""Loss expressions scored as metrics over prediction tables.

Row terms are array folds (JVM-side higher-order functions); the mean is
one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesight.functions.columns import col
from citesight.operators.metrics import cdf_distance, one_hot, row_entropy


def _g(group_cols):
    return list(group_cols or [])


def _clamped_log(x: Column) -> Column:
    # log clamped at -100, as the binary cross-entropy of the studied stack does
    return F.greatest(F.coalesce(F.when(x > 0, F.log(x)), F.lit(-100.0)), F.lit(-100.0))


def bce(df: DataFrame, y="y", p="prob", weight=None, group_cols=None) -> DataFrame:
    """O1: mean binary cross-entropy, optional row weights (ignored when any weight is NaN)."""
    g = _g(group_cols)
    term = -(col(y) * _clamped_log(col(p)) + (1 - col(y)) * _clamped_log(1 - col(p)))
    if weight is None:
        return df.groupBy(*g).agg(F.avg(term).alias("bce"))
    w = col(weight).cast("double")
    return df.groupBy(*g).agg(F.when(F.count_if(F.isnan(w)) > 0, F.avg(term))
                              .otherwise(F.avg(term * w)).alias("bce"))


def log_softmax_ce(logits, y) -> Column:
    """Per row: logsumexp(logits) - logits[y]."""
    x = col(logits)
    m = F.array_max(x)
    lse = m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m)))
    return lse - F.get(x, col(y).cast("int"))


def cross_entropy(df: DataFrame, logits="logits", y="y", ignore_index: int = -100, group_cols=None) -> DataFrame:
    """O2: mean log-softmax cross-entropy over rows whose target is not ``ignore_index``."""
    return df.where(col(y) != ignore_index).groupBy(*_g(group_cols)).agg(
        F.avg(log_softmax_ce(logits, y)).alias("cross_entropy"))


def l1(df: DataFrame, y="y", p="pred", group_cols=None) -> DataFrame:
    """O3: mean absolute error."""
    return df.groupBy(*_g(group_cols)).agg(F.avg(F.abs(col(y) - col(p))).alias("l1"))


def hetero_mae(df: DataFrame, y="y", p="pred", sigma="sigma", group_cols=None) -> DataFrame:
    """mean(|y - p| / sigma + ln sigma) over the rows with a positive sigma."""
    s = F.when(col(sigma) > 0, col(sigma))
    return df.groupBy(*_g(group_cols)).agg(
        F.avg(F.abs(col(y) - col(p)) / s + F.log(s)).alias("hetero_mae"))


def smooth_one_hot(y, n: int, scale) -> Column:
    """Gaussian density at class indices around the target with ``scale``, normalised."""
    t, s = col(y).cast("double"), col(scale).cast("double") if not isinstance(scale, (int, float)) else F.lit(float(scale))
    dens = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.exp(-((i - t) * (i - t)) / (2 * s * s)))
    tot = F.aggregate(dens, F.lit(0.0), lambda a, v: a + v)
    return F.transform(dens, lambda v: v / tot)


def wasserstein_one_hot(df: DataFrame, probs="probs", y="y", group_cols=None) -> DataFrame:
    """Mean Wasserstein distance to the one-hot target."""
    n = F.size(col(probs))
    oh = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == col(y), 1.0).otherwise(0.0))
    return df.groupBy(*_g(group_cols)).agg(F.avg(cdf_distance(col(probs), oh, 1)).alias("wasserstein"))


def _w_smooth(probs, y, sigma, gamma: float, n: int) -> Column:
    return cdf_distance(col(probs), smooth_one_hot(y, n, col(sigma) * gamma), 1)


def wasserstein_ce(df: DataFrame, n: int, logits="logits", probs="probs", y="y", sigma="sigma",
                   beta: float = 0.5, gamma: float = 1.0, group_cols=None) -> DataFrame:
    """(1 - beta) * CE + beta * W(probs, smooth target)."""
    return df.groupBy(*_g(group_cols)).agg(
        ((1 - beta) * F.avg(log_softmax_ce(logits, y)) + beta * F.avg(_w_smooth(probs, y, sigma, gamma, n)))
        .alias("wasserstein_ce"))


def wasserstein_entropy(df: DataFrame, n: int, probs="probs", y="y", sigma="sigma",
                        beta: float = 0.5, gamma: float = 1.0, group_cols=None) -> DataFrame:
    """(1 - beta) * normalised entropy + beta * W(probs, smooth target)."""
    ent = row_entropy(probs) / F.log(F.lit(float(n)))
    return df.groupBy(*_g(group_cols)).agg(
        ((1 - beta) * F.avg(ent) + beta * F.avg(_w_smooth(probs, y, sigma, gamma, n))).alias("wasserstein_entropy"))


def wasserstein_sigma(df: DataFrame, n: int, probs="probs", y="y", sigma="sigma",
                      beta: float = 0.5, gamma: float = 1.0, group_cols=None) -> DataFrame:
    """(1 - beta) * mean sigma + beta * W(probs, smooth target)."""
    return df.groupBy(*_g(group_cols)).agg(
        ((1 - beta) * F.avg(col(sigma)) + beta * F.avg(_w_smooth(probs, y, sigma, gamma, n)))
        .alias("wasserstein_sigma"))


__all__ = ["bce", "cross_entropy", "l1", "hetero_mae", "smooth_one_hot", "wasserstein_one_hot",
           "wasserstein_ce", "wasserstein_entropy", "wasserstein_sigma", "one_hot"]
