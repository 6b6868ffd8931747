"""Staged tables by fingerprint, sized chunks with a manifest, counts from footers."""

import os
import tempfile

from pyspark.sql import functions as F

from citesight.sources import io as S
from citesight.sources import staging as T


def folder():
    return tempfile.mkdtemp(prefix="citesight-test-")


def test_second_call_reads_changed_input_rebuilds(spark):
    src = folder() + "/in"
    spark.range(100).write.parquet(src)
    df = spark.read.parquet(src).where("id > 10")
    one, two = T.stage_once(df), T.stage_once(spark.read.parquet(src).where("id > 10"))
    assert (one.reused, two.reused, one.path) == (False, True, two.path) and two.frame.count() == 89
    assert T.stage_once(df.where("id > 20")).path != one.path
    anew = T.stage_once(df, auto_remove=True)
    assert not anew.reused and anew.path == one.path
    spark.range(100, 120).write.mode("append").parquet(src)
    more = T.stage_once(spark.read.parquet(src).where("id > 10"))
    assert not more.reused and more.path != one.path and more.frame.count() == 109


def test_last_reader_deletes(spark):
    src = folder() + "/in"
    spark.range(50).write.parquet(src)
    df = spark.read.parquet(src).where("id < 7")
    one, two = T.stage_once(df, keep=False), T.stage_once(df, keep=False)
    with one as rows:
        assert rows.count() == 7
    assert two.reused and two.frame.count() == 7  # still read
    two.close()
    where = T.Folder(spark, one.path)
    assert not where.has() and not T.Folder(spark, one.path + "-readers").has()


def test_rows_that_plan_and_files_do_not_tell_have_no_name(spark):
    src = folder() + "/in"
    spark.range(5).write.parquet(src)
    df = spark.read.parquet(src)
    assert T.fingerprint(df) and T.fingerprint(df) == T.fingerprint(spark.read.parquet(src))
    assert T.fingerprint(spark.createDataFrame([(1,)], "a int")) is None
    assert T.fingerprint(df.withColumn("r", F.rand())) is None
    assert T.fingerprint(df.mapInPandas(lambda b: b, "id long")) is None
    assert T.fingerprint(df.where("id > 1")) != T.fingerprint(df.where("id > 2"))


def test_sized_chunks_manifest_and_footers(spark):
    src, out = folder() + "/in", folder() + "/out"
    spark.range(0, 103, 1, 5).selectExpr("id", "id * 2 as v").write.parquet(src)
    chunks = S.ordered_chunks(spark.read.parquet(src), ["id"], 4, keep_index=True)
    assert T.write_sized_chunks(chunks, out, 10) and not T.write_sized_chunks(chunks, out, 10)
    rows = sorted(T.manifest(spark, out).select("part", "first", "last", "rows").collect())
    assert [r.rows for r in rows] == [10, 10, 6] * 3 + [10, 10, 5]  # 26, 26, 26 and 25 rows
    for p in range(4):
        assert len([f for f in os.listdir(f"{out}/part={p}") if f.endswith(".parquet")]) == 3
    assert sorted(map(tuple, S.written_counts(spark, out).collect())) == [(0, 26), (1, 26), (2, 26), (3, 25)]
    plan = T._footers(spark, out, "part")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [part]" in plan
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(103))


def test_a_task_writes_many_sized_files(spark):
    src, out = folder() + "/in", folder() + "/out"
    spark.range(0, 1030, 1, 5).write.parquet(src)
    chunks = S.ordered_chunks(spark.read.parquet(src), ["id"], 4, keep_index=True)  # 258, 258, 258 and 256 rows
    assert T.write_sized_chunks(chunks, out, 10)
    rows = sorted(T.manifest(spark, out).select("part", "first", "last", "rows").collect())
    assert [r.rows for r in rows] == ([10] * 25 + [8]) * 3 + [10] * 25 + [6]
    assert [r.first for r in rows] == [258 * p + 10 * i for p in range(4) for i in range(26)]
    assert all(r.last - r.first == r.rows - 1 for r in rows)
    tasks = {f.split("-")[1] for p in range(4) for f in os.listdir(f"{out}/part={p}") if f.endswith(".parquet")}
    assert len(tasks) <= 8  # the session's shuffle partitions; 104 files had 104 tasks
