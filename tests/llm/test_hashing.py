import numpy as np
import pyarrow as pa

from citesight.llm import hashing as H


def test_equal_slices_hash_alike_and_others_differ():
    data = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    codes = H.mix(np.arange(1, 257, dtype=np.uint64))[data]
    starts = np.repeat(np.arange(200), 6)
    ends = starts + np.tile(np.arange(6), 200)
    h = H.slice_hashes(codes, starts, ends)
    by = {}
    for s, e, x in zip(starts, ends, h.tolist()):
        assert by.setdefault(bytes(data[s:e]), x) == x
    assert len(set(by.values())) == len(by)


def test_joined():
    data, at = H.joined([b"ab", b"", b"c"])
    assert bytes(data) == b"ab\0\0c\0" and at.tolist() == [0, 3, 4, 6]


def test_bounded_slices_keep_all_rows_in_order():
    texts = ["aa", None, "b", "cccccccc", "", "d", "ee", "f"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": pa.array(range(8))})
    parts = list(H.bounded([batch, batch.slice(0, 0)], limit=4))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in parts) <= 11 and len(parts) > 3


def test_row_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path):
    from citesight.llm.common import with_rid
    path = str(tmp_path / "t")
    spark.range(5000).selectExpr("id % 7 as doc_id", "'x' as text", "1 as _metadata").repartition(3).write.parquet(path)
    whole = with_rid(spark.read.parquet(path)).select("rid").collect()
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    split = with_rid(spark.read.parquet(path).select("doc_id")).select("rid").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(whole) == sorted(split) and len(set(whole)) == 5000
    doubled = spark.read.parquet(path)
    doubled = with_rid(doubled.union(doubled))
    assert doubled.select("rid").distinct().count() == 10_000
