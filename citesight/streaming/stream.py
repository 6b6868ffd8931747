"""Structured Streaming for the row-wise operators.

The studied pipeline has no stream; its row-wise steps (filters, text
cleaning below the length statistics, tokens by a fixed vocabulary, labels)
are plain projections and filters, so they run unchanged on a streaming
DataFrame. No stateful operator is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citesight.sources.staging import Folder


def parquet_stream(spark: SparkSession, folder: str, schema, glob: str = "*.par*",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """The rows of a folder's files (names by ``glob``), or of one file."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a stream takes a folder or a pattern: one file goes in as the pattern that only it meets
    return r.parquet(f"{folder[:-1]}[{folder[-1]}]" if Folder(spark, folder).is_file() else folder)


def run_to_parquet(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str,
                   checkpoint: str) -> None:
    """Apply ``transform`` to every micro-batch source row and append to a Parquet sink;
    ``availableNow`` drains what is there and stops (restartable from ``checkpoint``)."""
    q = (transform(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
