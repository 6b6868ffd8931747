"""Skew-safe equi-join for a many-to-one relation (edges -> unique key table).

A key is *hot* when it holds more than half a fair task's rows
(``count * 2P > total``); there are at most ``2P`` hot keys whatever the data
size, so the hot-key table (key, salt count) has a proven size bound and is
broadcast. A hot key holding ``s`` fair shares is spread over ``s`` salts
(at most ``P``): its left rows take a salt from a hash of the row (the same
on a retry), its right row is replicated once per salt. Each side is read
once; the join runs on (key, salt), so no task gets more than about one fair
share of any key. Cold keys keep salt 0. AQE skew-join handling stays on as a
second line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesight.functions.columns import with_scalars
from citesight.session import shuffle_partitions


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left JOIN right USING (keys)`` in which a null key meets a null key."""
    keys = _keys(keys)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    out = left.join(renamed, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{k}" for k in keys])


def _salted(counts: DataFrame, keys: list[str], count_col: str, total_col: str, p: int,
            min_rows: int) -> DataFrame:
    hot = counts.where((F.col(count_col) * (2 * p) > F.col(total_col)) & (F.col(count_col) >= min_rows))
    salts = F.least(F.ceil(F.col(count_col) * p / F.col(total_col)), F.lit(p))
    return hot.select(*keys, F.greatest(salts, F.lit(2)).cast("int").alias("_salts"))


def hot_keys(left: DataFrame, key, partitions: int | None = None,
             min_rows: int = 10_000) -> DataFrame:
    """(key, _salts) for keys of ``left`` holding more than half a fair partition
    (and at least ``min_rows`` rows); counted with map-side combine."""
    p = partitions or shuffle_partitions(left.sparkSession)
    k = _keys(key)
    per_key = left.groupBy(*k).agg(F.count(F.lit(1)).alias("_cnt"))
    total = left.agg(F.count(F.lit(1)).alias("_total"))
    return _salted(with_scalars(per_key, total), k, "_cnt", "_total", p, min_rows)


def hot_from_counts(counts: DataFrame, key: str, count_col: str = "count", partitions: int | None = None,
                    min_rows: int = 10_000) -> DataFrame:
    """Hot keys from a table that already knows each key's frequency (a vocabulary, an in-degree)."""
    p = partitions or shuffle_partitions(counts.sparkSession)
    total = counts.agg(F.sum(count_col).alias("_total"))
    return _salted(with_scalars(counts, total), [key], count_col, "_total", p, min_rows)


def split_hot_join(left: DataFrame, right: DataFrame, key, how: str = "inner",
                   partitions: int | None = None, min_rows: int = 10_000,
                   hot: DataFrame | None = None, hash_cols: list[str] | None = None) -> DataFrame:
    """``left JOIN right USING (key)`` where ``right`` is unique on ``key`` (a column or a list).

    ``hot``: (key, _salts) when already known (at most ``2 * partitions`` rows);
    otherwise counted on ``left``. ``hash_cols``: the left columns that spread a hot key's rows
    (all by default; name the narrow ones, a unique id will do).
    """
    if how not in ("inner", "left"):
        raise ValueError("split_hot_join supports inner and left joins")
    key = _keys(key)
    hot = F.broadcast((hot if hot is not None else hot_keys(left, key, partitions, min_rows))
                      .select(*key, "_salts"))
    row_hash = F.xxhash64(*[F.col(c) for c in hash_cols or left.columns])
    lft = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(row_hash, F.col("_salts")))
    ).drop("_salts")
    rgt = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return lft.join(rgt, [*key, "_salt"], how).drop("_salt")
