"""Staged tables that are found again (S8) and chunk folders that know what they hold.

A frame's fingerprint is a digest of its analysed plan and of the path, length
and modification time of every file it reads, gathered by a Spark job that
reads no content. Equal fingerprints mean equal rows, so a table staged under
its fingerprint can be read instead of worked out again, and a changed input
gives another name. Frames whose rows do not follow from plan and files (rows
made on the driver, random numbers, Python functions) never share a name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesight.session import ensure_checkpoint_dir, shuffle_partitions

#: Plan nodes and functions that run code which the plan's text does not show.
OPAQUE = re.compile(r"Python|Pandas|Arrow|LocalRelation|LogicalRDD|ExternalRDD|ScalaUDF|MapPartitions")


def fingerprint(df: DataFrame) -> str | None:
    """Name of the rows that ``df`` stands for; None if plan and files do not tell them."""
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    text = plan.treeString(True, False, 2**31 - 1, False, False)
    files = df.inputFiles()
    if OPAQUE.search(text) or not plan.deterministic() or not files:
        return None
    seen = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    state = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
                     .alias("a"), F.sum(F.xxhash64("modificationTime", "path", "length").cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256("\n".join([text, df.schema.json(), str(plan.semanticHash()), *map(str, state)]).encode()).hexdigest()[:32]


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}" if name else self.path))

    def is_file(self) -> bool:
        return self.has() and self._fs.getFileStatus(self._at(self.path)).isFile()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))] if self.has() else []

    def touch(self, name: str) -> None:
        self._fs.create(self._at(f"{self.path}/{name}")).close()

    def drop(self, name: str = "") -> None:
        self._fs.delete(self._at(f"{self.path}/{name}" if name else self.path), True)

    def move(self, to: str) -> bool:
        return self._fs.rename(self._at(self.path), self._at(to))


@dataclass
class Staged:
    """A staged table in use. ``with`` it, or ``close`` it, when no more of its rows are read."""
    frame: DataFrame
    path: str
    reused: bool
    _leases: Folder
    _lease: str
    _keep: bool

    def close(self) -> None:
        """End this reader; the last one deletes the table unless it is to be kept."""
        self._leases.drop(self._lease)
        if not self._keep and not self._leases.names():
            self._leases.drop()
            Folder(self._leases.spark, self.path).drop()

    def __enter__(self) -> DataFrame:
        return self.frame

    def __exit__(self, *_) -> None:
        self.close()


def stage_once(df: DataFrame, auto_remove: bool = False, keep: bool = True) -> Staged:
    """The rows of ``df``, staged under their fingerprint and read from there if they already are.

    ``auto_remove`` deletes what is found and stages anew. ``keep=False`` deletes the table when its
    last reader closes. A table is written beside its place and moved there whole, so a run that was
    broken off leaves nothing that looks finished, and of two writers one wins.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/citesight-staged"
    name = fingerprint(df)
    shared = name is not None
    path = f"{base}/{name or uuid.uuid4().hex}"
    here, leases = Folder(spark, path), Folder(spark, f"{path}-readers")
    if auto_remove and here.has():
        here.drop()
    lease = uuid.uuid4().hex
    leases.touch(lease)
    reused = shared and here.has("_SUCCESS")
    if not reused:
        made = Folder(spark, f"{path}-{lease}")
        df.write.option("compression", "zstd").parquet(made.path)
        if here.has() or not made.move(path):
            made.drop()  # another writer was first
    return Staged(spark.read.schema(df.schema).parquet(path), path, reused, leases, lease, keep)


def write_sized_chunks(chunks: DataFrame, path: str, rows_per_file: int, part: str = "part", idx: str = "_idx",
                       compression: str = "zstd", level: int = 1) -> bool:
    """S4 with files of bounded size: each chunk in files of ``rows_per_file`` rows, the last one shorter.

    ``chunks`` comes from ``ordered_chunks(..., keep_index=True)``. A task writes a run of whole files: the
    rows go to the task that their file's number names, sorted by position, and the writer begins a file
    every ``rows_per_file`` rows, so no chunk has more files than its rows need. A
    manifest beside the chunks holds the run's fingerprint and, per file, rows, bytes and the range of
    positions; a rerun on the same rows finds it and writes nothing (False).
    """
    spark = chunks.sparkSession
    out, name = Folder(spark, path), fingerprint(chunks)
    if name is not None and out.has(f"_manifest/run={name}/_SUCCESS"):
        return False
    out.drop()
    first = chunks.groupBy(part).agg(F.min(idx).alias("_first"), F.count(F.lit(1)).alias("_n"))
    plan = sorted(first.collect())  # one row per chunk
    files, place = 0, F.lit(None).cast("long")
    for number, start, n in plan:
        place = F.when(F.col(part) == number, F.lit(files) + F.floor((F.col(idx) - start) / rows_per_file)).otherwise(place)
        files += -(-n // rows_per_file)
    run = -(-max(files, 1) // shuffle_partitions(spark)) if files > shuffle_partitions(spark) else 1  # files of a task
    task = F.floor(place / run).cast("int")
    (chunks.withColumn("_task", task).repartitionById(-(-max(files, 1) // run), F.col("_task"))
     .sortWithinPartitions(part, idx).drop("_task").write.partitionBy(part).option("compression", compression)
     .option("maxRecordsPerFile", rows_per_file).option("parquet.compression.codec.zstd.level", str(level)).parquet(path))
    seen = spark.read.parquet(path).groupBy(part, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    seen = seen.agg(F.count(F.lit(1)).alias("rows"), F.min(idx).alias("first"), F.max(idx).alias("last"))
    seen.coalesce(1).write.parquet(f"{path}/_manifest/run={name or uuid.uuid4().hex}")
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, bytes, rows, first, last) of each file of sized chunks."""
    return spark.read.option("basePath", f"{path}/_manifest").parquet(f"{path}/_manifest").drop("run")


def _footers(spark: SparkSession, path: str, part: str) -> DataFrame:
    other = spark.newSession()  # the two settings hold for this question alone
    other.conf.set("spark.sql.sources.useV1SourceList", "")
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return other.read.parquet(path).groupBy(part).agg(F.count(F.lit(1)).alias("rows"))


def footer_counts(spark: SparkSession, path: str, part: str = "part") -> DataFrame:
    """Rows per written chunk from the files' footers: the scan takes COUNT(*) per chunk off the
    Parquet metadata and reads no column."""
    counts = _footers(spark, path, part)
    return spark.createDataFrame(counts.collect(), counts.schema)  # one row per chunk
