"""The row-wise operators run unchanged on a stream (file source, availableNow, checkpointed sink)."""

from pyspark.sql import functions as F

from citesight.operators import clean as C
from citesight.streaming import stream as ST


def test_stream_cleaning_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, f"Text {i} copyright." if i % 3 == 0 else f"plain de text {i}.", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    df.repartition(3).write.parquet(src)

    def transform(d):
        d = C.mark_foreign(C.null_boilerplate(C.lowercase(d, "text"), "text"), "text")
        return d.select("doc_id", "language", F.col("text").isNull().alias("gone"))

    stream = ST.parquet_stream(spark, src, df.schema, max_files_per_trigger=1)
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    ST.run_to_parquet(stream, transform, sink, ck)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r) for r in transform(df).collect())
    assert got == want
    # a restart from the checkpoint finds nothing new and writes nothing twice
    ST.run_to_parquet(ST.parquet_stream(spark, src, df.schema), transform, sink, ck)
    assert spark.read.parquet(sink).count() == 30


def test_clean_documents_of_a_file_a_folder_and_no_rows(spark, tmp_path):
    from citesight.plans.catalog.text import stream_clean
    rows = [(i, f"Text {i} copyright." if i % 3 == 0 else f"plain text {i}.", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name, some in (("folder", df.repartition(3)), ("none", df.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    want = sorted((i, "en", i % 3 == 0) for i in range(30))
    for name, rows in (("folder", want), ("file", want), ("none", [])):
        assert sorted(map(tuple, stream_clean(spark, f"{tmp_path}/{name}").collect())) == rows
