"""Sources and sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesight.plans.rowindex import with_row_index
from citesight.plans.selection import first_rows
from citesight.session import ensure_checkpoint_dir
from citesight.sources.staging import footer_counts


def scan_corpus(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                glob: str = "*.par*") -> DataFrame:
    """Parquet scan of a file or folder, files matched by ``glob``; extra columns ignored,
    only ``columns`` read (pruned at the scan)."""
    df = spark.read.option("pathGlobFilter", glob).parquet(path)
    return df.select(*columns) if columns else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/citesight-{name}-{uuid.uuid4().hex[:12]}"


def ordered_chunks(df: DataFrame, order_cols: Sequence, n_chunks: int = 1, part: str = "part",
                   keep_index: bool = False) -> DataFrame:
    """``part = idx // ceil(n / N)`` clipped to ``[0, N - 1]`` by the global order ``order_cols``."""
    n_chunks = max(int(n_chunks), 1)
    ix = with_row_index(df, order_cols, "_idx", total_name="_n")
    size = F.greatest(F.ceil(F.col("_n") / F.lit(n_chunks)), F.lit(1))
    out = ix.withColumn(
        part, F.least(F.greatest(F.floor(F.col("_idx") / size), F.lit(0)), F.lit(n_chunks - 1)).cast("int"))
    out = out.drop("_n")
    return out if keep_index else out.drop("_idx")


def chunks_by_rows(df: DataFrame, order_cols: Sequence, rows_per_chunk: int, part: str = "part") -> DataFrame:
    """S3: chunks of ``rows_per_chunk`` rows (``N = ceil(n / rows)``)."""
    ix = with_row_index(df, order_cols, "_idx")
    return ix.withColumn(part, F.floor(F.col("_idx") / F.lit(int(rows_per_chunk))).cast("int")).drop("_idx")


def write_chunks(df: DataFrame, path: str, part: str = "part", compression: str = "zstd",
                 level: int = 1, mode: str = "overwrite") -> str:
    """One folder per chunk (``part=i``), zstd with the given level, column statistics on.

    One pass: rows stay in their (range-ordered) partitions and are sorted by
    chunk locally; no per-chunk re-scan and no one-task-per-chunk shuffle.
    """
    (df.sortWithinPartitions(part)
     .write.mode(mode).partitionBy(part)
     .option("compression", compression)
     .option("parquet.compression.codec.zstd.level", str(level))
     .parquet(path))
    return path


def written_counts(spark: SparkSession, path: str, part: str = "part") -> DataFrame:
    """Rows per written chunk, from the files' footers."""
    return footer_counts(spark, path, part)


def dry_run_head(df: DataFrame, n: int = 500, order_cols: Sequence = ("id",)) -> DataFrame:
    """The first ``n`` rows by ``order_cols``, selected by counting (``plans.selection``)."""
    return first_rows(df, order_cols, n)


def json_sink(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines sink."""
    df.write.mode(mode).json(path)
    return path


def params_frame(spark: SparkSession, params: dict) -> DataFrame:
    """Run parameters as one JSON object row (values as strings)."""
    row = {k: str(v) for k, v in params.items()}
    return spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "params string")


def stage_table(df: DataFrame, path: str | None = None, in_memory: bool = False) -> DataFrame:
    """Materialise a training table: written to the shared folder and read back (survives executor
    loss, cuts lineage), or, if the caller says so, kept in memory (spilling to disk)."""
    if in_memory:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    path = path or scratch_path(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_predictions(pred: DataFrame, path: str, window_col: str = "window_start", mode: str = "overwrite") -> str:
    """Prediction store, one folder per evaluation window."""
    pred.sortWithinPartitions(window_col).write.mode(mode).partitionBy(window_col).parquet(path)
    return path
