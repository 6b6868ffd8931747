"""Selection by rank without a global sort.

* ``first_rows``: the first ``n`` rows of a total order.
* ``cells_with``: the cells of a total order that hold any of some positions.
* ``quantiles``: exact quantiles of many ranks in many groups.

All narrow an interval by counting. ``first_rows`` takes pivots from a small
sample, counts the rows between them (map-side combine: a few hundred numbers
in all) and goes on inside the interval that holds the n-th row, until it is
short enough to sort; a hundred times fewer rows each round. ``quantiles``
asks a sketch for the values around each rank, counts exactly what lies below
them, and sorts only the rows between. No row outside the last interval is
exchanged or written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesight.functions.columns import with_scalars
from citesight.plans.joins import null_safe_join
from citesight.plans.rowindex import cumulative_sums, pin, with_row_index

PIVOTS, SAMPLE, SHORT = 255, 4_000, 10_000
#: Pivots of ``cells_with``.
CELL_PIVOTS = 1_023


def _pivots(inside: DataFrame, rows: int, count: int) -> DataFrame:
    """One row ``_p``: an ascending array of at most ``count`` keys of a sample of ``SAMPLE`` or so."""
    share = SAMPLE / rows
    while True:
        some = inside.select("_key") if share >= 1 else inside.select("_key").sample(fraction=share, seed=17)
        keys = F.array_sort(F.array_distinct(F.collect_list("_key")))
        step = F.greatest(F.floor(F.size("_p") / (count + 1)), F.lit(1))
        thin = F.filter("_p", lambda _, i: i % step == F.floor(step / 2))
        out = pin(some.agg(keys.alias("_p")).select(thin.alias("_p")).select(F.slice("_p", 1, count).alias("_p")))
        if share >= 1 or out.first()["_p"]:
            return out
        share *= 8


def _below(ascending: str, value: str, count: int) -> Column:
    """How many of at most ``count`` ``ascending`` entries are less than ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(count.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= F.size(ascending)) & (F.get(ascending, at + s - 1) < F.col(value)), at + s).otherwise(at))


def _slot(count: int) -> Column:
    """Where ``_key`` lies among the ascending ``_p``: 2i between pivots i - 1 and i, 2i + 1 on pivot i."""
    below = _below("_p", "_key", count)
    on = F.coalesce(F.get("_p", below) == F.col("_key"), F.lit(False))
    return F.when(on, below * 2 + 1).otherwise(below * 2)


def first_rows(df: DataFrame, order_cols: Sequence, n: int, pivots: int = PIVOTS, short: int = SHORT) -> DataFrame:
    """The first ``n`` rows by ``order_cols`` (ascending, nulls first), or all if there are fewer.

    Rows that are equal in all order columns are told apart by a hash of the whole row. The result is
    not sorted. ``df`` is read about twice per round; its order columns alone are looked at.
    """
    key = F.struct(*[c.alias(f"k{i}") if isinstance(c, Column) else F.col(c).alias(f"k{i}")
                     for i, c in enumerate(order_cols)])
    keyed = df.withColumn("_key", key)
    inside, kept, rows, need = keyed, [], df.count(), n
    if rows <= n:
        return df
    while rows > short:
        p = _pivots(inside, rows, pivots)
        slots = with_scalars(inside, p).select(*df.columns, "_key", _slot(pivots).alias("_slot"))
        counts = sorted((r["_slot"], r["count"]) for r in slots.groupBy("_slot").count().collect())  # 2 * pivots + 1 at most
        before, at, rows = 0, 0, 0
        for at, rows in counts:
            if before + rows >= need:
                break
            before += rows
        low = with_scalars(inside, p)
        lo, hi = F.get("_p", F.lit((at + 1) // 2 - 1)), F.get("_p", F.lit(at // 2))
        if before:  # all slots before the n-th row's
            limit = F.col("_key") < hi if at % 2 else F.col("_key") <= lo
            kept.append(low.where(limit).select(df.columns))
        if at % 2:
            part = low.where(F.col("_key") == hi)
        else:
            part = low
            if at > 0:
                part = part.where(F.col("_key") > lo)
            if at // 2 < len(p.first()["_p"]):
                part = part.where(F.col("_key") < hi)
        inside, need = part.select(*df.columns, "_key"), need - before
        if at % 2:  # equal keys: cut by the row's hash, by position where they are many
            if need < rows:
                ix = with_row_index(inside.withColumn("_h", F.xxhash64(*df.columns)), ["_h"], "_i")
                inside = ix.where(F.col("_i") < need).select(*df.columns, "_key")
            rows = need
            break
    last = inside.select(df.columns)
    if need < rows:  # at most `short` rows
        last = inside.withColumn("_h", F.xxhash64(*df.columns)).orderBy("_key", "_h").limit(need).select(df.columns)
    out = last
    for part in kept:
        out = part.unionByName(out)
    return out


def cells_with(df: DataFrame, keys: Sequence[str], wanted: DataFrame, pos: str, pivots: int = CELL_PIVOTS,
               short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` in those cells of the order ``keys`` that hold a position of ``wanted`` (column ``pos``,
    counted from 0), and ``wanted`` with its positions counted among these rows alone.

    The order is cut at sampled pivots and the rows of a cell are counted where they lie (at most
    ``2 * pivots + 1`` numbers), so a later sort moves the cells in question only. A short table, or more positions
    than cells, are given back as they are. ``keys`` must name a row; ``wanted`` is read three times.
    """
    rows = df.count()
    if rows <= short or wanted.count() > 2 * pivots:
        return df, wanted
    keyed = df.withColumn("_key", F.struct(*keys))
    p = _pivots(keyed, rows, pivots)
    slots = with_scalars(keyed, p).select(*df.columns, _slot(pivots).alias("_slot"))
    counts = sorted((r["_slot"], r["count"]) for r in slots.groupBy("_slot").count().collect())
    ends, total = [], 0  # the last position of each cell
    for _, n in counts:
        total += n
        ends.append(total - 1)
    spark = df.sparkSession
    placed = with_scalars(wanted, spark.createDataFrame([(ends,)], "_ends array<long>"))
    placed = placed.select(*wanted.columns, _below("_ends", pos, len(ends)).alias("_cell"))
    hit = {r["_cell"] for r in placed.select("_cell").distinct().collect()}
    less, left_out = [], 0  # rows left out before each cell
    for cell, (_, n) in enumerate(counts):
        less.append(left_out)
        left_out += 0 if cell in hit else n
    kept = [False] * (2 * pivots + 1)
    for cell in hit:
        kept[counts[cell][0]] = True
    near = with_scalars(slots, spark.createDataFrame([(kept,)], "_kept array<boolean>"))
    moved = with_scalars(placed, spark.createDataFrame([(less,)], "_less array<long>"))
    moved = moved.withColumn(pos, F.col(pos) - F.get("_less", F.col("_cell"))).select(*wanted.columns)
    return near.where(F.get("_kept", F.col("_slot"))).select(*df.columns), moved


def quantiles(df: DataFrame, col: str, qs: Sequence[float], group_cols: Sequence[str] = (),
              interpolation: str = "linear", accuracy: int = 1_000, whole: int = 10_000) -> DataFrame:
    """(group..., q0, q1, ...): exact quantiles by position of each group's values; NaN and null left out.

    A sketch of rank error ``1 / accuracy`` gives a cell of values around each rank; small groups (up
    to ``whole`` values) have one cell of all values. Rows below each cell are counted, rows inside
    collapse to (value, count), and running counts find the value at each position. Where a cell
    misses its positions the group is done again with one cell; so the result never rests on the
    sketch. ``linear`` interpolates between the two nearest positions, ``nearest`` rounds.
    """
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation {interpolation}")
    gc, ranks = list(group_cols), range(len(qs))
    v = F.col(col).cast("double")
    values = df.select(*gc, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    near = [(max(0.0, q - 3 / accuracy), min(1.0, q + 3 / accuracy)) for q in qs]
    sketch = F.percentile_approx("_v", [x for pair in near for x in pair], accuracy)
    inf = float("inf")
    cells = pin(values.groupBy(*gc).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_s")).select(*gc, "_n", *[
        c for i in ranks for c in (
            F.when((F.col("_n") <= whole) | F.lit(near[i][0] == 0), -inf).otherwise(F.get("_s", F.lit(2 * i))).alias(f"_lo{i}"),
            F.when((F.col("_n") <= whole) | F.lit(near[i][1] == 1), inf).otherwise(F.get("_s", F.lit(2 * i + 1))).alias(f"_hi{i}"))]))

    def at(i: int, up: bool) -> Column:
        pos = F.lit(float(qs[i])) * (F.col("_n") - 1)
        if interpolation == "nearest":
            return F.round(pos)
        return F.ceil(pos) if up else F.floor(pos)

    while True:
        met = null_safe_join(values, cells, gc) if gc else with_scalars(values, cells)
        below = met.groupBy(*gc).agg(F.first("_n").alias("_n"), *[
            c for i in ranks for c in (F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}"),
                                       F.count_if(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))).alias(f"_c{i}"))])
        below = pin(below)
        missed = F.lit(False)
        for i in ranks:
            missed |= (at(i, False) < F.col(f"_b{i}")) | (at(i, True) >= F.col(f"_b{i}") + F.col(f"_c{i}"))
        bad = below.where(missed).select(*gc, F.lit(True).alias("_bad"))
        if bad.isEmpty():
            break
        j = null_safe_join(cells, bad, gc, "left") if gc else cells.withColumn("_bad", F.lit(True))
        cells = pin(j.select(*gc, "_n", *[
            F.when(F.col("_bad"), side).otherwise(F.col(f"{name}{i}")).alias(f"{name}{i}")
            for i in ranks for name, side in (("_lo", -inf), ("_hi", inf))]))
    inside = met.select(*gc, "_v", F.explode(F.filter(F.array(*[
        F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(i)) for i in ranks]), lambda x: x.isNotNull())).alias("_q"))
    runs = pin(inside.groupBy(*gc, "_q", "_v").agg(F.count(F.lit(1)).alias("_r")))
    runs = cumulative_sums(runs, ["_v"], ["_r"], [*gc, "_q"])
    runs = null_safe_join(runs, below, gc) if gc else with_scalars(runs, below)

    def value(i: int, up: bool) -> Column:
        rank = at(i, up) - F.col(f"_b{i}")
        here = (F.col("_q") == i) & (F.col("_r_cum") - F.col("_r") <= rank) & (rank < F.col("_r_cum"))
        return F.max(F.when(here, F.col("_v")))
    one = runs.groupBy(*gc).agg(F.first("_n").alias("_n"), *[
        c for i in ranks for c in (value(i, False).alias(f"_x{i}"), value(i, True).alias(f"_y{i}"))])
    part = [F.lit(float(q)) * (F.col("_n") - 1) - F.floor(F.lit(float(q)) * (F.col("_n") - 1)) for q in qs]
    return one.select(*gc, *[
        (F.col(f"_x{i}") + (F.col(f"_y{i}") - F.col(f"_x{i}")) * part[i]).alias(f"q{i}") if interpolation == "linear"
        else F.col(f"_x{i}").alias(f"q{i}") for i in ranks])
