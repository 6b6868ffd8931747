"""Plan-shape and partition-invariance checks."""

import pytest

from citesight.plans.rowindex import cumulative_sums, exact_quantiles, with_next, with_row_index
from citesight.sources import io as S

from conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 16])
def test_row_index_is_global_and_partition_free(spark, parts):
    df = spark.range(0, 1000, 1, parts).selectExpr("id * 7 % 1000 as k")
    r = with_row_index(df, ["k"], "i").orderBy("k").collect()
    assert [x.i for x in r] == list(range(1000))


def test_cumulative_sums_grouped(spark):
    df = spark.range(0, 500, 1, 5).selectExpr("id % 3 as g", "id as o", "1 as v")
    r = cumulative_sums(df, ["o"], ["v"], ["g"]).collect()
    for x in r:
        assert x.v_cum == x.o // 3 + 1


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_cumulative_sums_of_uneven_groups(spark, parts):
    import random
    rng = random.Random(parts)
    rows = [("big", rng.choice([rng.random(), rng.random() * 1e-6]), rng.randint(0, 5)) for _ in range(3000)]
    rows += [("small", float(i), i) for i in range(20)] + [("one", -1.0, 4), (None, 2.0, 1), (None, 3.0, 2)]
    rows = list({(g, o): (g, o, v) for g, o, v in rows}.values())
    df = spark.createDataFrame(rows, "g string, o double, v long")
    want, total = {}, {}
    after, last = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total[g] = total.get(g, 0) + v
        want[g, o] = total[g]
        if g in last:
            after[g, last[g]] = v
        last[g] = o
    for split in (0, 10_000):  # cut into buckets, and by a plain window
        got = cumulative_sums(df, ["o"], ["v"], ["g"], num_partitions=parts, split_rows=split).collect()
        assert {(r.g, r.o): r.v_cum for r in got} == want and len(got) == len(rows)
        alone = cumulative_sums(df.where("g = 'big'"), ["o"], ["v"], num_partitions=parts, split_rows=split).collect()
        assert all(want[r.g, r.o] == r.v_cum for r in alone)
        got = with_next(df, ["o"], ["v"], ["g"], num_partitions=parts, split_rows=split).collect()
        assert {(r.g, r.o): r.next_v for r in got if r.next_v is not None} == after and len(got) == len(rows)


def test_running_sums_shuffle_their_rows_once(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").selectExpr("l_extendedprice as o", "1 as v", "l_linenumber as g")
    assert plan(cumulative_sums(df, ["o"], ["v"], ["g"])).count("Exchange") == 1  # no group above 10,000 rows
    text = plan(cumulative_sums(df, ["o"], ["v"], ["g"], split_rows=0))
    rows = [x for x in text.splitlines() if "Exchange hashpartitioning(g" in x and "_bucket" in x]
    assert len(rows) == 2  # the rows themselves, and the totals of the buckets
    assert "rangepartitioning" not in text


def test_exact_quantiles_linear(spark):
    df = spark.range(1, 11).selectExpr("cast(id as double) as v")
    assert tuple(exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).first()) == (1.0, 3.25, 5.5, 10.0)
    assert tuple(exact_quantiles(df.where("v > 99"), "v", [0.5]).first()) == (None,)


def test_describe_reads_only_its_column(spark):
    from citesight.operators import describe as D
    df = spark.read.parquet(f"{SF001}/lineitem.parquet")
    text = plan(D.describe_column(df, "l_quantity"))
    scans = [x for x in text.splitlines() if "FileScan" in x and "lineitem" in x]
    assert scans and all("l_orderkey" not in x for x in scans)


def test_chunks_do_not_depend_on_partitions(spark):
    df = spark.range(0, 103, 1, 9)
    a = sorted((r.id, r.part) for r in S.ordered_chunks(df, ["id"], 4).collect())
    b = sorted((r.id, r.part) for r in S.ordered_chunks(df.coalesce(1), ["id"], 4).collect())
    assert a == b and max(p for _, p in a) == 3


def test_scan_prunes_and_pushes(spark):
    df = S.scan_corpus(spark, f"{SF001}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 10")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_no_python_udf_and_no_single_partition_on_corpus(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    for name in ("g5_neighbourhood_table", "f4_citation_delays", "c6_clean_text", "e6_roc_auc"):
        p = plan(q[name](spark, SF001))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "WindowGroupLimit" in p or name != "g5_neighbourhood_table"


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
