"""Selection by rank: heads, samples, grouped quantiles, and what builds on them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesight.operators import describe as D
from citesight.operators import metrics as E
from citesight.operators import sampling as B
from citesight.operators import tokens as K
from citesight.plans import jobs as J
from citesight.plans.selection import cells_with, first_rows, quantiles
from conftest import SF001


def order(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("n", [0, 1, 37, 500, 999, 1300, 5000])
def test_first_rows_with_ties_nulls_and_a_hot_key(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 3, 3, 3, rng.randint(0, 400)]), rng.randint(0, 5), i % 11) for i in range(1300)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(7)
    got = first_rows(df, ["a", "b"], n, pivots=5, short=20).collect()
    want = sorted(rows, key=lambda r: order(r[:2]))[:n]
    assert sorted((tuple(r)[:2] for r in got), key=order) == [r[:2] for r in want]
    left = list(rows)
    for r in got:
        left.remove(tuple(r))  # every row comes from the table, as often as it is there


def test_first_rows_of_equal_rows_and_descending(spark):
    df = spark.range(900).selectExpr("1 as a", "id % 2 as b")
    assert first_rows(df, ["a"], 450, pivots=3, short=10).count() == 450
    got = first_rows(spark.range(900), [-F.col("id")], 100, pivots=3, short=10).collect()
    assert sorted(r.id for r in got) == list(range(800, 900))


def test_heads_exchange_no_full_table(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_comment") \
        if "l_comment" in spark.read.parquet(f"{SF001}/lineitem.parquet").columns else \
        spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    out = first_rows(df, ["l_orderkey", "l_linenumber"], 50, pivots=15, short=100)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "Exchange hashpartitioning" not in text
    assert "TakeOrderedAndProject" in text  # the short rest alone
    assert out.count() == 50
    assert B.sample_n(df.withColumnRenamed("l_orderkey", "id").dropDuplicates(["id"]), 20, seed=1).count() == 20


@pytest.mark.parametrize("at", [[0], [1299, 1299, 0], [640, 655, 655, 641], list(range(0, 1300, 130))])
def test_cells_with_positions_keep_the_rows_drawn(spark, at):
    rng = random.Random(5)
    rows = [(None if i < 30 else i // 40, i) for i in range(1300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    wanted = spark.createDataFrame(list(enumerate(at)), "draw int, p long")
    near, moved = cells_with(df, ["a", "b"], wanted, "p", pivots=63, short=20)
    kept = sorted((tuple(r) for r in near.collect()), key=order)
    full = sorted(rows, key=order)
    assert [kept[r.p] for r in moved.orderBy("draw").collect()] == [full[p] for p in at]
    assert len(kept) <= len(set(at)) * 100  # 1300 / 63 rows a cell, with room for uneven pivots
    assert cells_with(df, ["a", "b"], wanted, "p", short=1300)[0] is df  # a short table as it is


def test_draws_do_not_depend_on_the_cells(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("id"), (F.col("id") % 3).alias("v"))
    a = {(r.draw, r.id, r.v) for r in B.sample_uniform_replace(df, 50, seed=2).collect()}
    monkeypatch.setattr(B, "cells_with", lambda d, keys, draws, pos: (d, draws))
    assert len(a) == 50 and a == {(r.draw, r.id, r.v) for r in B.sample_uniform_replace(df, 50, seed=2).collect()}


def test_draws_number_keys_only(spark):
    df = spark.range(200).selectExpr("id", "repeat('x', 100) as wide")
    out = B.sample_uniform_replace(df, 50, seed=2)
    assert out.columns == ["draw", "id", "wide"] and out.count() == 50
    assert B.sample_uniform_replace(df.where("false"), 50).count() == 0


@pytest.mark.parametrize("accuracy, whole", [(1000, 10_000), (40, 5), (10, 0)])
def test_grouped_quantiles_are_exact(spark, accuracy, whole):
    rng = random.Random(accuracy)
    rows = [(g, rng.choice([float(rng.randint(0, 9)), rng.gauss(0, 1), 4.0])) for g in ("a", "b", None) for _ in range(700)]
    rows += [("one", 2.5), ("nan", float("nan")), ("a", None), ("a", float("nan")), ("two", 1.0), ("two", 2.0)]
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r[0]: r[1:] for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", qs, ["g"],
                                          accuracy=accuracy, whole=whole).collect()}
    assert set(got) == {"a", "b", None, "one", "two"}
    for g, q in got.items():
        v = [x for h, x in rows if h == g and x is not None and not math.isnan(x)]
        assert np.allclose(q, np.quantile(v, qs), atol=1e-12)
    alone = quantiles(spark.createDataFrame(rows, "g string, v double"), "v", qs, accuracy=accuracy, whole=whole).first()
    assert np.allclose(alone, np.quantile([x for _, x in rows if x is not None and not math.isnan(x)], qs))


def test_histogram_auto_bins_per_group_as_numpy(spark):
    rng = random.Random(9)
    rows = [(g, rng.gauss(g, 1 + g)) for g in (0, 1, 2) for _ in range(200)] + [(3, 5.0)] * 4
    got = E.value_histogram(spark.createDataFrame(rows, "g int, v double"), "v", "auto", ["g"]).collect()
    for g in range(3):
        v = [x for h, x in rows if h == g]
        assert len([r for r in got if r.g == g]) == len(np.histogram_bin_edges(v, "auto")) - 1
    assert [(r.bin, r["count"]) for r in got if r.g == 3] == [(0, 4)]


def test_density_curve_near_the_direct_sum(spark):
    rng = random.Random(10)
    v = [rng.gauss(3, 2) for _ in range(400)]
    rows = [("a", x) for x in v] + [("flat", 1.0), ("flat", 1.0), ("a", None), ("a", float("nan"))]
    got = E.density_curve(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()
    bw = np.std(v, ddof=1) * len(v) ** -0.2
    assert {r.g for r in got} == {"a"} and len(got) == 200
    for r in got:
        direct = np.exp(-0.5 * ((r.x - np.array(v)) / bw) ** 2).sum() / (len(v) * bw * math.sqrt(2 * math.pi))
        assert abs(direct - r.density) < 1e-4


def test_nan_scores_do_not_move_bins_or_win(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, nan), (0, None)], "y int, prob double")
    assert sorted((r.cls, r.bin, r["count"], r.class_pct) for r in E.prob_histogram_by_class(df).collect()) == [
        (0, 0, 1, 50.0), (1, 39, 1, 50.0)]
    m = spark.createDataFrame([(0, [nan, 0.2, 0.1]), (1, [nan, nan, nan]), (2, [0.1, None, 0.3]), (3, [])], "i int, p array<double>")
    assert [r[0] for r in m.orderBy("i").select(E.argmax_class("p")).collect()] == [1, None, 2, None]


def test_reports_guard_nan_rows_and_count_them(spark):
    nan = float("nan")
    rows = [("a", 0, [0.7, 0.3]), ("a", 1, [0.2, 0.8]), ("a", 1, [nan, 0.4]), ("a", None, [0.5, 0.5]), (None, 0, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "g string, y int, probs array<double>")
    got = {r.g: r for r in J.ordinal_report(df, ["g"], 2).collect()}
    assert (got["a"].examples, got["a"].nan_rows, got["a"].accuracy) == (2, 2, 1.0)
    assert math.isclose(got["a"].mae, 0.25) and math.isclose(got["a"].wasserstein, 0.25)
    assert 0 < got["a"].norm_entropy < 1 and got["a"].roc_auc_ovo == 1.0
    assert got[None].examples == 1 and math.isclose(got[None].wasserstein, 0.1)


def test_cdf_distance_of_many_classes(spark):
    rng = random.Random(4)
    rows = [([rng.random() for _ in range(30)], [rng.random() for _ in range(30)]) for _ in range(5)]
    for p in (1, 2, 3):
        got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(E.cdf_distance("a", "b", p)).collect()]
        for (a, b), d in zip(rows, got):
            u, v = np.cumsum(a) / sum(a), np.cumsum(b) / sum(b)
            assert math.isclose(d, (np.abs(u - v) ** p).sum() ** (1 / p), rel_tol=1e-9)


def test_describe_any_type(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'b', DATE '2020-01-02', true, array(1)), (2, 'a', DATE '2020-01-04', false, array(2)),
                      (NULL, NULL, NULL, NULL, NULL) AS t(n, s, d, f, l)""")
    got = {r.column: r for r in D.describe_columns(df, ["n", "s", "d", "f", "l"]).collect()}
    assert [got[c].kind for c in "nsdfl"] == ["number", "text", "date", "boolean", "other"]
    assert all((got[c]["count"], got[c].null_count) == (2, 1) for c in "nsdfl")
    assert (got["s"].min_text, got["s"].max_text, got["s"].mean) == ("a", "b", None)
    assert (got["d"].min_text, got["d"].p50 - got["d"].min) == ("2020-01-02", 1.0)
    assert got["f"].mean == 0.5 and got["n"].p25 == 1.25


def test_mean_pool_of_repeated_and_missing_ids(spark):
    rows = [(1, [5]), (1, [6]), (None, [5, 6]), (2, []), (3, None), (4, [0])]
    t = spark.createDataFrame(rows, "id long, toks array<long>")
    v = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 3.0])], "token_id long, vec array<float>")
    for bound in (1 << 20, 0):  # broadcast and shuffled vectors
        got = sorted(((r.id, tuple(r.mean_vec)) for r in K.mean_pool(t, "id", "toks", v, 2, broadcast_bytes=bound).collect()), key=repr)
        assert got == sorted([(1, (1.0, 0.0)), (1, (0.0, 3.0)), (None, (0.5, 1.5)), (2, (0.0, 0.0)), (3, (0.0, 0.0)), (4, (0.0, 0.0))], key=repr)
