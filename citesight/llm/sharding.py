"""Shards of near-equal bytes by longest-processing-time scheduling.

Documents of equal text form a group that must stay together. LPT takes the
groups by falling size and gives each to the least-loaded shard, kept in a
heap. Groups of equal size are interchangeable, so the schedule sees one row
(size, number of groups) per distinct size, in falling order: a few equal
groups go through the heap one by one, many are dealt out by arithmetic, with
the same result (the ``count`` smallest of the loads each shard would have
before each further group). Different sizes add up to at most the total, so
there are at most ``sqrt(2 * total bytes)`` rows; one task streams them with
the loads of the shards as its only state.

Which group of a size goes where follows from its number: groups are numbered
by (size falling, text digest) over range partitions, and a size's row holds
for each shard how many of its groups it takes. Sizes are summed by text
digest with map-side combine (a text held by a third of all rows is one
partial row per task), a size that many groups share is salted, and the slots
inside a shard are numbered by range partitions plus offsets, not by one task
per shard.

Cases: null texts count as empty; repeated rows belong to the group of their
text and get a slot each; an empty table gives no rows. Ties in load fall to
the smaller shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesight.llm.common import join_by_counts, stage, with_rid
from citesight.plans.rowindex import with_row_index
from citesight.session import shuffle_partitions

SHARDS, ROW_BYTES = 24, 8


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` bytes each shard takes by LPT; ``loads`` are brought up to date."""
    shards = len(loads)
    taken = [0] * shards
    if count > 4 * shards:
        # all places that a load below `level` offers are filled before any at or above it
        def below(level: int) -> list[int]:
            return [max(0, -((x - level) // size)) for x in loads]
        low, high = min(loads), max(loads) + size * count
        while low < high:  # the highest level whose places are not more than the groups
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sum(below(mid)) <= count else (low, mid - 1)
        taken = below(low)
    heap = [(x + size * t, s) for s, (x, t) in enumerate(zip(loads, taken))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, s = heap[0]
        taken[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    loads[:] = [x + size * t for x, t in zip(loads, taken)]
    return taken


def _schedule(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, start = [0] * shards, 0
        for batch in batches:
            taken, starts = [], []
            for size, count in zip(batch["bytes"].tolist(), batch["n"].tolist()):
                taken.append(np.cumsum(deal(loads, size, count)))
                starts.append(start)
                start += count
            yield pd.DataFrame({"bytes": batch["bytes"], "n": batch["n"], "start": starts, "ends": taken})
    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(with_rid(docs.select("doc_id", "text")).select(
        "rid", "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    groups = stage(with_row_index(groups, [F.col("bytes").desc(), "digest"], "number"), "shard-groups")
    plan = (groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).repartition(1)
            .sortWithinPartitions(F.col("bytes").desc())
            .mapInPandas(_schedule(shards), "bytes long, n long, start long, ends array<long>"))
    placed = join_by_counts(groups, stage(plan, "shard-plan"), "bytes", "n", "inner")
    # the shard whose share of the size holds the group's number
    mine = F.size(F.filter("ends", lambda e: e <= F.col("number") - F.col("start")))
    placed = placed.select("digest", "n_rows", mine.alias("shard"))
    rows = join_by_counts(rows, placed, "digest", "n_rows", "inner").select(
        "rid", "doc_id", "size", "text_crc32", "shard")
    return _slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                               F.lit(None).cast("int").alias("grown_shard"))


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 in the order of their row id."""
    n = shuffle_partitions(rows.sparkSession)
    parts = stage(rows.repartitionByRange(n, "shard", "rid").sortWithinPartitions("shard", "rid")
                  .withColumn("part", F.spark_partition_id())
                  .withColumn("at", F.monotonically_increasing_id()), "shard-slots")
    # a row per partition and shard held there: at most partitions + shards
    runs = parts.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    return parts.join(F.broadcast(runs), ["shard", "part"]).withColumn("slot", F.col("at") + F.col("base"))
