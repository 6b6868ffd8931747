"""Sampling (B1-B5): reproducible, hash-seeded, fully distributed.

Random draws come from the MD5 of draw and seed, which any engine can repeat: the
same seed gives the same sample whatever the partitioning, and a re-executed task
draws the same rows. Heads and samples of any size take the row-index path, so no
task holds more than its share of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesight.plans.joins import null_safe_join, split_hot_join
from citesight.plans.rowindex import pin, with_row_index
from citesight.plans.selection import cells_with, first_rows
from citesight.functions.columns import with_scalars

_U52 = float(2 ** 52)
#: Drawn keys up to this number are broadcast to find their rows.
BROADCAST_DRAWS = 1_000_000


def _digest(*cols, seed: int = 0):
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols],
                             F.lit(str(seed))))


def _uniform(*cols, seed: int = 0):
    """Uniform [0, 1) from the first 13 hex digits of the digest."""
    return F.conv(F.substring(_digest(*cols, seed=seed), 1, 13), 16, 10).cast("double") / _U52


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """B1: exactly ``min(n, rows)`` rows without replacement: the first ``n`` in hash order, selected by
    counting (``plans.selection``): nothing but those rows is exchanged."""
    return first_rows(df, [_digest(key, seed=seed), key], n)


def head_n(df: DataFrame, n: int, order_cols: Sequence = ("id",)) -> DataFrame:
    """B2: first ``n`` rows by ``order_cols``, selected by counting."""
    return first_rows(df, order_cols, n)


def _drawn(df: DataFrame, keys: Sequence[str], draws: DataFrame) -> DataFrame:
    """The rows at the drawn positions ``_pos`` of the order ``keys`` (which name a row).

    Only keys are ordered and numbered, of few draws only those near a draw (``plans.selection``); the rows
    themselves meet the drawn keys, which are broadcast up to a counted bound. A row drawn very often is salted."""
    near, draws = cells_with(df.select(*keys), keys, draws, "_pos")
    ix = with_row_index(near, keys, "_pos")
    picked = pin(split_hot_join(draws, ix, "_pos").drop("_pos"))
    rows = null_safe_join(df, F.broadcast(picked.select(*keys).distinct()), keys, "left_semi") \
        if picked.count() <= BROADCAST_DRAWS else df
    met = null_safe_join(picked, rows, keys)
    return met.select("draw", *df.columns)


def sample_uniform_replace(df: DataFrame, n: int, seed: int = 0, order_cols: Sequence = ("id",)) -> DataFrame:
    """``n`` uniform draws with replacement: draw i picks position
    ``floor(u_i * rows)`` of the ordered table. ``order_cols`` must name a row."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    draws = with_scalars(df.sparkSession.range(n).withColumnRenamed("id", "draw"), total).where("_rows > 0")
    draws = draws.select("draw", F.floor(_uniform(F.col("draw"), seed=seed) * F.col("_rows")).cast("long").alias("_pos"))
    return _drawn(df, list(order_cols), draws)


def inverse_freq_weights(df: DataFrame, col: str, n_bins: int = 100, out_bin: str = "bin",
                         out_weight: str = "weight") -> DataFrame:
    """Uniform-width bins between min and max (max clipped into the last bin, one bin
    when min = max); row weight ``1 / (bin count + 1e-6)``. Rows without a value have no bin and
    are dropped."""
    v = F.col(col).cast("double")
    df = df.where(F.col(col).isNotNull() & ~F.isnan(v))
    st = df.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    j = with_scalars(df, st)
    rng = F.col("_mx") - F.col("_mn")
    b = F.when(rng == 0, F.lit(0)).otherwise(
        F.least(F.greatest(((v - F.col("_mn")) / rng * n_bins).cast("long"), F.lit(0)), F.lit(n_bins - 1)))
    j = j.withColumn(out_bin, b.cast("int")).drop("_mn", "_mx")
    counts = j.groupBy(out_bin).agg(F.count(F.lit(1)).alias("_c"))  # at most n_bins rows
    return (j.join(F.broadcast(counts), out_bin)
            .withColumn(out_weight, 1.0 / (F.col("_c") + 1e-6)).drop("_c"))


def sample_weighted_replace(binned: DataFrame, n: int | None = None, seed: int = 0, key: str = "id",
                            bin_col: str = "bin", weight_col: str = "weight") -> DataFrame:
    """``n`` draws with replacement, row probability proportional to its weight
    (weights constant within a bin, as B4 makes them). Default ``n`` = rows.

    A draw picks a bin from the cumulative bin masses (table bounded by the
    bin count), then a uniform position inside the bin; bins are contiguous in
    (bin, key) order, of which only these two columns are numbered.
    """
    spark = binned.sparkSession
    bins = binned.groupBy(bin_col).agg(F.count(F.lit(1)).alias("_cnt"), F.first(weight_col).alias("_w"))
    w_all = Window.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)  # over <= n_bins rows
    bins = bins.select(bin_col, "_cnt", (F.col("_cnt") * F.col("_w")).alias("_mass"))
    bins = bins.withColumns({"_mhi": F.sum("_mass").over(w_all), "_chi": F.sum("_cnt").over(w_all)})
    # a bin begins exactly where the one before it ends; the last one is open above
    w_bins = Window.orderBy(bin_col)
    bins = bins.withColumns({"_mlo": F.coalesce(F.lag("_mhi").over(w_bins), F.lit(0.0)),
                             "_mtop": F.when(F.lead("_mhi").over(w_bins).isNull(), F.lit(float("inf"))).otherwise(F.col("_mhi")),
                             "_start": F.col("_chi") - F.col("_cnt")})
    tot = bins.agg(F.max("_mhi").alias("_M"), F.sum("_cnt").alias("_N"))
    if n is None:
        n = binned.count()  # a scalar; the draws themselves are generated in parallel
    draws = spark.range(n)
    draws = with_scalars(draws.withColumnRenamed("id", "draw"), tot)
    draws = draws.withColumns({"_u1": _uniform(F.col("draw"), F.lit(1), seed=seed) * F.col("_M"),
                               "_u2": _uniform(F.col("draw"), F.lit(2), seed=seed)})
    b = F.broadcast(bins.select(bin_col, "_cnt", "_mlo", "_mtop", "_start"))
    d = draws.join(b, (F.col("_u1") >= F.col("_mlo")) & (F.col("_u1") < F.col("_mtop")))
    d = d.select("draw", (F.col("_start") + F.floor(F.col("_u2") * F.col("_cnt"))).cast("long").alias("_pos"))
    return _drawn(binned, [bin_col, key], d)
