"""Sources and sinks: chunk layout and codec, staging, JSON round trip, sizing helper."""

import glob
import json
import os

import pyarrow.parquet as pq

from citesight.session import recommended_conf
from citesight.sources import io as S


def test_write_chunks_layout_and_zstd(spark, tmp_path):
    df = spark.range(0, 100, 1, 4)
    path = S.write_chunks(S.ordered_chunks(df, ["id"], 3), str(tmp_path / "out"), level=3)
    dirs = sorted(os.path.basename(d) for d in glob.glob(f"{path}/part=*"))
    assert dirs == ["part=0", "part=1", "part=2"]
    f = glob.glob(f"{path}/part=0/*.parquet")[0]
    assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"
    counts = {r.part: r.rows for r in S.written_counts(spark, path).collect()}
    assert counts == {0: 34, 1: 34, 2: 32}


def test_stage_table_where_the_caller_says(spark):
    df = spark.range(10)
    assert S.stage_table(df, in_memory=True).is_cached
    staged = S.stage_table(df)
    assert not staged.is_cached and staged.count() == 10


def test_no_private_checkpoint_folder_off_local():
    from types import SimpleNamespace

    import pytest

    from citesight.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_json_sink_and_params(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    path = S.json_sink(df, str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.schema("id long, s string").json(path).collect()] == [(1, "a")]
    p = S.params_frame(spark, {"chunks": 4, "level": 1}).collect()[0].params
    assert json.loads(p) == {"chunks": "4", "level": "1"}


def test_recommended_conf_scales_with_input():
    small = recommended_conf(10 << 30, 64)
    big = recommended_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 192          # three waves of 64 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 409600          # 256 MB per partition
