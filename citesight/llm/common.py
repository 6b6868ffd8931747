"""Shared helpers: staging, row ids, words, hot-key joins."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesight.plans.joins import hot_from_counts, split_hot_join
from citesight.session import ensure_checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A table is broadcast only when it has been counted and holds at most so many rows.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(names) -> list[Column]:
    """Top-level columns whatever characters their names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: Arrow functions find columns by name, and a dot in a
    name would be read as a field."""
    ship_package(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and
    every later branch sees the same rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not hold."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes that pass on the physical place of a file's rows, each row once.
_SCAN_NODES = {"Relation", "Project", "Filter", "Repartition", "SubqueryAlias"}


def _is_plain_scan(df: DataFrame) -> bool:
    lines = [x for x in df._jdf.queryExecution().analyzed().toString().splitlines() if x.strip()]
    names = [re.match(r"[\s:+\-|]*(\w*)", x)[1] for x in lines]
    return set(names) <= _SCAN_NODES and names.count("Relation") == 1 and lines[-1].endswith(" parquet")


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """Number the physical rows, to tell apart rows that repeat an id or are equal in all columns.

    For a scan of Parquet files the number is a hash of the file's path plus the row's place in the
    file: the same on every pass and every retry, however the files are split among executors. Any
    other frame is written once with its numbers.
    """
    if _is_plain_scan(df):
        place = df.metadataColumn("_metadata")  # found also beside a column of that name
        return df.withColumn(name, F.shiftright(F.xxhash64(place["file_path"]), 1) + place["row_index"])
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered-rows")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """Non-empty pieces between runs of ``separators``; no words for null."""
    return F.coalesce(F.filter(F.split(text, separators), lambda w: w != ""),
                      F.array().cast("array<string>"))


def join_by_counts(left: DataFrame, right: DataFrame, key: str, count_col: str, how: str = "left") -> DataFrame:
    """``left JOIN right`` on a key of which ``right`` holds one row and the number of left rows.

    Keys above half a fair share are salted (see ``plans.joins``).
    """
    return split_hot_join(left, right, key, how, hot=hot_from_counts(right, key, count_col))


def drop_rows(rows: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Anti-join on ``key``; the ids are counted and broadcast only up to ``broadcast_rows``, else shuffled."""
    ids = stage(ids.select(key), "dropped")
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_anti")
