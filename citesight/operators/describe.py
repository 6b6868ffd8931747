"""Column description (D1-D4): one grouped aggregate per question, no per-bucket scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesight.functions.columns import with_scalars
from citesight.plans.joins import null_safe_join
from citesight.plans.selection import quantiles


def _label(a, b) -> str:
    return f"{a}-{b}"


def bucket_counts(df: DataFrame, col: str, boundaries: Sequence[float]) -> DataFrame:
    """Rows per ``[b_i, b_i+1)`` labelled ``"b_i-b_i+1"``, empty buckets kept with 0."""
    spark = df.sparkSession
    b = list(boundaries)
    v = F.col(col)
    idx = F.size(F.filter(F.array(*[F.lit(x) for x in b]), lambda x: x <= v)) - 1
    inside = (v >= F.lit(b[0])) & (v < F.lit(b[-1]))
    counts = df.where(inside).groupBy(idx.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    all_b = spark.createDataFrame([(i, _label(b[i], b[i + 1]), float(b[i]), float(b[i + 1]))
                                   for i in range(len(b) - 1)], "bucket int, label string, lo double, hi double")
    return all_b.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", "label", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def bucket_proportions(counts: DataFrame) -> DataFrame:
    """Share of rows in percent (``pct``) and rounded half to even to one place (null when no rows)."""
    tot = counts.agg(F.sum("count").alias("_total"))
    j = with_scalars(counts, tot)
    pct = F.try_divide(F.col("count") * 100.0, F.col("_total"))
    return j.withColumns({"pct": pct, "proportion": F.bround(pct, 1)}).drop("_total")


def balance_weights(counts: DataFrame) -> DataFrame:
    """D3: ``total / (n_buckets * count)``, NaN for an empty bucket."""
    tot = counts.agg(F.sum("count").alias("_total"), F.count(F.lit(1)).alias("_nb"))
    j = with_scalars(counts, tot)
    w = F.when(F.col("count") == 0, F.lit(float("nan"))).otherwise(
        F.col("_total") / (F.col("_nb") * F.col("count")).cast("double"))
    return j.withColumn("weight", w).drop("_total", "_nb")


def _as_number(df: DataFrame, col: str) -> tuple[str, Column]:
    """Kind of a column and its values as doubles: numbers as they are, booleans as 0 and 1, dates and
    timestamps as days since 1970; other kinds have none."""
    t = df.schema[col].dataType
    if isinstance(t, T.NumericType):
        return "number", F.col(col).cast("double")
    if isinstance(t, T.BooleanType):
        return "boolean", F.col(col).cast("double")
    if isinstance(t, T.DateType):
        return "date", F.unix_date(F.col(col)).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "date", F.unix_micros(F.col(col).cast("timestamp")) / 86_400_000_000.0
    return ("text" if isinstance(t, T.StringType) else "other"), F.lit(None).cast("double")


def describe_column(df: DataFrame, col: str, approx: bool = False, accuracy: int = 10000,
                    interpolation: str = "linear", group_cols: Sequence[str] = ()) -> DataFrame:
    """Count, null and NaN count, mean, std, min, 25/50/75 % (exact by position), max, per group.

    NaN is counted apart and enters no other figure. ``interpolation`` is ``linear`` or ``nearest``.
    Columns that are no numbers are described by ``_as_number``; text has counts alone and, as every
    kind, ``min_text`` and ``max_text``. ``approx=True`` takes the percentiles from one
    ``percentile_approx`` sketch instead (one pass, bounded memory, rank error about 1/accuracy)."""
    g = list(group_cols)
    kind, raw = _as_number(df, col)
    df = df.select(*g, F.col(col).alias("_c"), raw.alias("_raw"))
    if isinstance(df.schema["_c"].dataType, (T.MapType, T.VariantType)):
        df = df.withColumn("_c", F.lit(None).cast("string"))  # maps have no order
    v = F.when(~F.isnan("_raw"), F.col("_raw"))
    real = ~F.coalesce(F.isnan("_raw"), F.lit(False))
    held = F.col("_c").isNotNull() & real
    base = df.groupBy(*g).agg(
        F.count_if(held).alias("count"), F.count_if(F.col("_c").isNull()).alias("null_count"),
        F.count_if(F.isnan("_raw")).alias("nan_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.min(F.when(real, F.col("_c"))).cast("string").alias("min_text"),
        F.max(F.when(real, F.col("_c"))).cast("string").alias("max_text"),
        *([F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_pq")] if approx else []))
    out = [*g, F.lit(kind).alias("kind"), "count", "null_count", "nan_count", "mean", "std", "min", "p25", "p50", "p75", "max",
           "min_text", "max_text"]
    if approx:
        return base.select("*", *[F.get("_pq", F.lit(i)).alias(p) for i, p in enumerate(("p25", "p50", "p75"))]).select(out)
    if kind in ("text", "other"):
        return base.select("*", *[F.lit(None).cast("double").alias(p) for p in ("p25", "p50", "p75")]).select(out)
    q = quantiles(df, "_raw", [0.25, 0.5, 0.75], g, interpolation).withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    return (null_safe_join(base, q, g, "left") if g else with_scalars(base, q)).select(out)


def describe_columns(df: DataFrame, cols: Sequence[str], time_col: str | None = None, start=None, end=None,
                     interpolation: str = "linear", group_cols: Sequence[str] = ()) -> DataFrame:
    """Describe job: one row per column of ``cols`` (and group) over the rows dated in ``[start, end)``.

    The described columns are staged in one pass over the corpus; each description reads its own.
    """
    df = _staged(df, [*group_cols, *cols], time_col, start, end)
    parts = [describe_column(df, c, interpolation=interpolation, group_cols=group_cols).select(F.lit(c).alias("column"), "*")
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _staged(df: DataFrame, cols: Sequence[str], time_col: str | None, start, end) -> DataFrame:
    from citesight.operators.filters import time_window
    from citesight.sources.io import stage_table
    if time_col is not None:
        df = time_window(df, time_col, start, end)
    return stage_table(df.select(*dict.fromkeys(cols)))


def describe_report(df: DataFrame, cols: Sequence[str], boundaries: Sequence[float], time_col: str | None = None,
                    start=None, end=None) -> DataFrame:
    """The whole describe output in one table: (column, item, label, value, text).

    Items ``count``, ``proportion`` and ``weight`` per bucket for columns of numbers (D1-D3), and
    ``statistic`` for every column (D4), with ``text`` for the smallest and largest value.
    """
    df = _staged(df, cols, time_col, start, end)
    parts = []
    for c in cols:
        d = describe_column(df, c)
        stats = [F.struct(F.lit("statistic").alias("item"), F.lit(n).alias("label"), F.col(n).cast("double").alias("value"),
                          (F.col(f"{n}_text") if n in ("min", "max") else F.lit(None).cast("string")).alias("text"))
                 for n in ("count", "null_count", "nan_count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        parts.append(d.select(F.lit(c).alias("column"), F.explode(F.array(*stats)).alias("s")).select("column", "s.*"))
        if _as_number(df, c)[0] == "number":
            b = balance_weights(bucket_proportions(bucket_counts(df, c, boundaries)))
            items = [F.struct(F.lit(n).alias("item"), F.col("label").alias("label"), F.col(n).cast("double").alias("value"),
                              F.lit(None).cast("string").alias("text")) for n in ("count", "proportion", "weight")]
            parts.append(b.select(F.lit(c).alias("column"), F.explode(F.array(*items)).alias("s")).select("column", "s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
