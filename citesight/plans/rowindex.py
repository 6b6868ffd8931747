"""Global order without a one-partition window.

* ``with_row_index``: 0-based position of every row in a total order.
* ``cumulative_sums``, ``with_next``: running sums and the following row in an order, optionally per group.
* ``exact_quantiles``: quantiles by position.

The index range-partitions the data (sampling-based bounds, so a hot key is
split by the tie-breaking columns); running sums and quantiles cut groups above
a fair share at approximate quantiles. Both work inside each part and add
offsets from a broadcast table with a row per part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesight.session import ensure_checkpoint_dir, shuffle_partitions
from citesight.functions.columns import with_scalars
from citesight.plans.joins import null_safe_join


#: Most buckets that one group's running sums are cut into.
MAX_BUCKETS = 4096
#: A group of so many rows or fewer is never cut.
SPLIT_ROWS = 100_000


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet into the shared checkpoint folder and read it back.

    Survives a lost executor, cuts lineage, and later reads take only the columns they use. Used where two branches of a plan must see the same partition ids: a
    range exchange samples its bounds from rows whose order after a shuffle
    is not fixed, so recomputing it may move rows between partitions.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pinned-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cols(cs) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in cs]


def with_row_index(df: DataFrame, order_cols: Sequence, name: str = "idx",
                   num_partitions: int | None = None, total_name: str | None = None) -> DataFrame:
    """Add ``name`` = global 0-based position by ``order_cols``.

    ``order_cols`` must be a total order (end it with a unique key). The
    tagged frame is pinned (written and read back) so both branches of the plan see
    the same partition ids; the explicit partition count keeps AQE from
    coalescing the range exchange. ``total_name`` adds the row count, read off the
    per-partition table (no extra pass over the data).
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    oc = _cols(order_cols)
    s = df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
    pid = F.spark_partition_id()
    t = pin(s.select("*", pid.alias("_pid"),
                     (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_lid")))
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # at most `n` rows: one per range partition
    offs = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    extra = [F.col("_total").alias(total_name)] if total_name else []
    return (t.join(F.broadcast(offs), "_pid")
            .select(*[F.col(c) for c in df.columns], (F.col("_off") + F.col("_lid")).alias(name), *extra))


def _bucketed(df: DataFrame, order_cols: Sequence, gc: list[str], n: int, split_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with ``_bucket``: ascending parts of each large group by its first order column (a number).

    Only groups of more than a fair share of the rows (and ``split_rows``) are cut, at approximate
    quantiles: at most ``n`` groups, so cuts and sketches are few however many groups there are. The
    second value tells whether any group was cut. ``df`` is read up to three times: stage a costly one.
    """
    b = max(2, min(n, MAX_BUCKETS))
    counts = df.groupBy(*gc).agg(F.count(F.lit(1)).alias("_n"))
    counts = with_scalars(counts, df.agg(F.count(F.lit(1)).alias("_total")))
    hot = pin(counts.where((F.col("_n") * b > F.col("_total")) & (F.col("_n") > split_rows)))  # fewer than b rows
    if hot.isEmpty():
        return df.withColumn("_bucket", F.lit(0)), False
    d = df.withColumn("_ord", _cols(order_cols)[0].cast("double"))
    large = null_safe_join(d, F.broadcast(hot.select(*gc)), gc, "left_semi") if gc else d
    cuts = large.groupBy(*gc).agg(
        F.array_distinct(F.percentile_approx("_ord", [i / b for i in range(1, b)], 10 * b)).alias("_cuts"))
    t = null_safe_join(d, F.broadcast(cuts), gc, "left") if gc else with_scalars(d, cuts)
    # binary search: how many cuts lie below the value
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(b.bit_length()))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= F.size("_cuts")) & (F.get("_cuts", at + s - 1) < F.col("_ord")), at + s).otherwise(at))
    return t.select(*df.columns, F.when(F.col("_cuts").isNull(), 0).otherwise(F.coalesce(bucket, F.lit(0))).alias("_bucket")), True


def _attach(t: DataFrame, per_bucket: DataFrame, gc: list[str]) -> DataFrame:
    """Left join of a small table with a row per bucket of the groups that were cut."""
    return null_safe_join(t, F.broadcast(per_bucket), [*gc, "_bucket"], "left")


def cumulative_sums(df: DataFrame, order_cols: Sequence, sum_cols: Sequence[str],
                    group_cols: Sequence[str] = (), suffix: str = "_cum",
                    num_partitions: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` by ``order_cols`` within ``group_cols``.

    Groups within a fair share of the rows are summed by a plain window. Larger ones (fewer than the
    partitions) are cut into buckets of their first order column; rows are shuffled once, by (group,
    bucket), and get the totals of the buckets before theirs, broadcast with a row per cut bucket.
    ``order_cols`` must be a total order within a group; a null group is a group.
    """
    gc, oc = list(group_cols), _cols(order_cols)
    t, cut = _bucketed(df, oc, gc, num_partitions or shuffle_partitions(df.sparkSession), split_rows)
    w = Window.partitionBy(*gc, "_bucket").orderBy(*oc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = t.select("*", *[F.sum(c).over(w).alias(f"_l_{c}") for c in sum_cols])
    if not cut:
        return local.select(*df.columns, *[F.col(f"_l_{c}").alias(f"{c}{suffix}") for c in sum_cols])
    totals = t.groupBy(*gc, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*gc).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # buckets after the first exist in cut groups only
    offs = totals.select("_bucket", *gc, *[F.sum(f"_t_{c}").over(w_off).alias(f"_o_{c}") for c in sum_cols]).where("_bucket > 0")
    out = _attach(local, offs, gc)
    return out.select(*df.columns, *[(F.coalesce(f"_o_{c}", F.lit(0)) + F.col(f"_l_{c}")).alias(f"{c}{suffix}")
                                     for c in sum_cols])


def with_next(df: DataFrame, order_cols: Sequence, cols: Sequence[str], group_cols: Sequence[str] = (),
              prefix: str = "next_", num_partitions: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``cols`` of the following row by ``order_cols`` within ``group_cols``; null on the last row.

    Cut like the running sums: the last row of a bucket takes the first row of the next bucket that
    has rows. A followed row is told from a last one by the struct, so nulls in ``cols`` are kept.
    """
    gc, oc = list(group_cols), _cols(order_cols)
    t, cut = _bucketed(df, oc, gc, num_partitions or shuffle_partitions(df.sparkSession), split_rows)
    row = F.struct(*cols)
    t = t.withColumn("_row", row)
    local = t.withColumn("_next", F.lead("_row").over(Window.partitionBy(*gc, "_bucket").orderBy(*oc)))
    if cut:
        first = t.groupBy(*gc, "_bucket").agg(F.min_by("_row", F.struct(*oc)).alias("_first"))
        after = F.lead("_first").over(Window.partitionBy(*gc).orderBy("_bucket")).alias("_after")
        border = first.select(*gc, "_bucket", after).where("_after IS NOT NULL")  # rows of cut groups only
        local = _attach(local, border, gc).withColumn("_next", F.coalesce("_next", "_after"))
    return local.select(*df.columns, *[F.col(f"_next.{c}").alias(prefix + c) for c in cols])


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], interpolation: str = "linear") -> DataFrame:
    """One row with a column ``q0, q1, ...`` per entry of ``qs``: exact quantiles by position.

    Reads only ``col``. Rows collapse to (value, count) with map-side combine, so
    a value held by a third of the rows is one row; running counts then give the
    value at each position. ``linear`` interpolates between the two nearest
    positions, ``nearest`` takes the value at the rounded position. NaN and null
    are left out; without values all quantiles are null.
    """
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation {interpolation}")
    v = F.col(col).cast("double")
    counts = (df.select(v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy("_v").agg(F.count(F.lit(1)).alias("_n")))
    runs = cumulative_sums(pin(counts), ["_v"], ["_n"])
    runs = with_scalars(runs, runs.agg(F.coalesce(F.max("_n_cum"), F.lit(0)).alias("_total")))

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("_n_cum") - F.col("_n") <= pos) & (pos < F.col("_n_cum")), F.col("_v")))

    found, names = [], []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        if interpolation == "nearest":
            found.append(at(F.round(pos)).alias(f"q{i}"))
        else:
            found += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"), F.max(pos).alias(f"_pos{i}")]
            part = F.col(f"_pos{i}") - F.floor(f"_pos{i}")
            names.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(f"q{i}"))
    one = runs.agg(*found)
    return one.select(*names) if names else one
