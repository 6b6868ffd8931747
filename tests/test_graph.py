"""Neighbourhood table: no look-ahead, ties, priorities, duplicates, missing references."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citesight.operators import neighbours as G
from citesight.plans.joins import split_hot_join

SCHEMA = ("id long, publication_date date, referenced_works array<long>, topic_name string, "
          "subfield_name string, score double, emb array<float>, cited_by_count long")


def d(y, m=1, day=1):
    return dt.date(y, m, day)


def corpus(spark):
    rows = [
        (1, d(1990), [], "a", "x", 1.0, [1.0], 0),
        (2, d(1991), [1], "a", "y", 5.0, [2.0], 1),
        (3, d(1992), [1, 2], "b", "x", 3.0, [3.0], 2),
        (4, d(1995), [1, 2, 3, 3, 99], "a", "x", 2.0, [4.0], 7),   # duplicate ref 3, missing ref 99
        (5, d(1996), [4, 6], "a", "x", 2.0, [5.0], 3),              # 6 is after t_end
        (6, d(2000), [1], "a", "x", 9.0, [6.0], 4),
        (7, d(1995), None, "a", "x", 1.0, [7.0], 4),                # null references
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_no_look_ahead_and_t_start_only_on_targets(spark):
    spec = G.GraphSpec(t_start=d(1995), t_end=d(1999), top_k=10)
    t = G.neighbourhood_table(corpus(spark), spec).collect()
    got = {r.id: r.graph_ids for r in t}
    # targets only from 1995 on; history before t_start is a neighbour; 6 (>= t_end) never is
    assert set(got) == {4, 5}
    assert 6 not in got[5]
    # 4 cites 1, 2, 3, 3 (99 missing): priority topic 'a' first (1, 2), then subfield 'x' (3, 3)
    assert got[4] == [1, 2, 3, 3]
    assert got[5] == [4]


def test_priority_then_sort_then_id(spark):
    spec = G.GraphSpec(t_end=d(1999), top_k=2)
    t = {r.id: r.graph_ids for r in G.neighbourhood_table(corpus(spark), spec).collect()}
    # ties on priority 0 between 1 (score 1) and 2 (score 5): ascending neighbour score
    assert t[4] == [1, 2]
    spec_desc = G.GraphSpec(t_end=d(1999), top_k=2, sort_descending=True)
    t = {r.id: r.graph_ids for r in G.neighbourhood_table(corpus(spark), spec_desc).collect()}
    assert t[4] == [2, 1]


def test_topk_by_sort_descending(spark):
    spec = G.GraphSpec(t_end=d(1999), top_k=1)
    c = G.prepare_corpus(corpus(spark), spec)
    e = G.category_match(G.citation_edges(c, spec), spec.category_cols)
    got = {r.id: r.graph_ids for r in G.topk_by_sort(e, spec).collect()}
    assert got[4] == [2]      # highest neighbour score


def test_split_hot_join_equals_plain_join(spark):
    left = spark.range(0, 5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"),
                                        F.col("id").alias("v"))
    right = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    a = sorted(tuple(r) for r in split_hot_join(left, right, "k", min_rows=10).collect())
    b = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert a == b


def test_rewindow_edges_stop_at_window_end(spark):
    spec = G.GraphSpec(top_k=5)
    r = {(x.window_start.year, x.id): x.graph_ids
         for x in G.rewindow(corpus(spark), spec, "1995-01-01", "1997-01-01").collect()}
    assert r[(1995, 4)] == [1, 2, 3, 3]
    assert r[(1996, 5)] == [4]


def test_rewindow_keeps_the_length_limits_of_the_table(spark):
    spec = G.GraphSpec(top_k=5, max_len=1, graph_max_len=1)
    one = {x.id for x in G.neighbourhood_table(corpus(spark), spec).collect()}
    many = {x.id for x in G.rewindow(corpus(spark), spec, "1990-01-01").collect()}
    assert many == one | {5} and 4 not in many  # 5 cites 6, which is not older than its window


def test_salted_feature_fetch_changes_nothing(spark):
    plain = G.GraphSpec(top_k=5, hot_count_col=None)
    salted = G.GraphSpec(top_k=5, hot_partitions=50, hot_min_rows=1)
    a = sorted(str(r) for r in G.neighbourhood_table(corpus(spark), plain).collect())
    assert sorted(str(r) for r in G.neighbourhood_table(corpus(spark), salted).collect()) == a


def test_rolling_window_right_closed(spark):
    rows = [(1, d(2000, 1, 1), "a", 1.0, [1.0]), (2, d(2000, 1, 5), "a", 3.0, [2.0]),
            (3, d(2000, 1, 31), "a", 2.0, [3.0]), (4, d(2000, 2, 2), "a", 0.5, [4.0])]
    df = spark.createDataFrame(rows, "id long, publication_date date, topic_name string, score double, emb array<float>")
    r = {x.id: x.graph_ids for x in G.rolling_category_topk(df, "topic_name", "publication_date", "score", "emb",
                                                            top_k=2, period_days=30).collect()}
    assert r[1] == [1]
    assert r[3] == [2, 3]          # (Jan 1, Jan 31]: 1 is out
    assert r[4] == [2, 3]          # (Jan 3, Feb 2]


def test_hot_cited_work_same_result_when_split(spark):
    # work 0 is cited by every other work (a third of all edges and more)
    rows = [(0, d(1990), [], "a", "x", 0.5, [0.0], 300)]
    rows += [(i, d(1991), [0, i - 1] if i > 1 else [0], "a" if i % 2 else "b", "x", float(i % 7), [float(i)], 1)
             for i in range(1, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = G.GraphSpec(top_k=2, hot_min_rows=10**9)
    split = G.GraphSpec(top_k=2, hot_min_rows=1)
    a = sorted((r.id, tuple(r.graph_ids)) for r in G.neighbourhood_table(df, plain).collect())
    b = sorted((r.id, tuple(r.graph_ids)) for r in G.neighbourhood_table(df, split).collect())
    assert a == b and len(a) == 299
    for no_count in (G.GraphSpec(top_k=2, hot_min_rows=1, hot_count_col=None),):
        c = sorted((r.id, tuple(r.graph_ids)) for r in G.neighbourhood_table(df, no_count).collect())
        assert c == a


def test_salted_left_join_keeps_unmatched_and_hot_rows(spark):
    # key 1 holds 60 % of the left rows (hot, salted); key 99 has no right row
    left = spark.range(0, 1000).select(
        F.when(F.col("id") < 600, 1).when(F.col("id") < 610, 99).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"))
    right = spark.range(0, 1000).where("id <> 99").select(F.col("id").alias("k"), (F.col("id") + 5).alias("w"))
    got = sorted(tuple(r) for r in split_hot_join(left, right, "k", how="left", min_rows=10).collect())
    want = sorted(tuple(r) for r in left.join(right, "k", "left").collect())
    assert got == want and len(got) == 1000
    assert sum(1 for k, _, w in got if k == 99 and w is None) == 10


@pytest.mark.parametrize("period, offset", [(1, -1), (7, -7), (5, -12), (4, 0), (6, 3), (30, -30), (3, -2)])
def test_rolling_topk_by_blocks_equals_brute_force(spark, period, offset):
    import datetime
    import random
    rng = random.Random(period * 31 + offset)
    start = datetime.date(1969, 12, 20)  # days on both sides of the epoch
    rows = [(i, rng.choice("abc"), start + datetime.timedelta(days=rng.choice([rng.randint(0, 40), 17])),
             rng.choice([None, 1.0, 2.0, rng.random()]), [float(i)]) for i in range(150)]
    rows += [(1000, None, start, 1.0, [0.0]), (1001, "a", None, 1.0, [0.0])]
    df = spark.createDataFrame(rows, "id long, c string, d date, s double, f array<double>")
    got = {r.id: r.graph_ids for r in G.rolling_category_topk(df, "c", "d", "s", "f", 3, period, offset).collect()}
    want = {}
    for i, c, d, _, _ in rows:
        if c and d:
            near = sorted(((-x[3] if x[3] is not None else 9), x[0]) for x in rows if x[1] == c and x[2] is not None
                          and offset < (x[2] - d).days <= offset + period)[:3]
            if near:
                want[i] = [n for _, n in near]
    assert got == want


def test_rolling_topk_joins_blocks_not_candidates(spark):
    import re
    df = spark.range(300).selectExpr("id", "'a' as c", "cast(id % 90 as int) as _day", "id * 0.5 as s")
    text = G.rolling_lists(df, "c", "s", "id", 3, 30, -30)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in text.splitlines() if re.search(r"\bJoin\b", x)]
    assert len(joins) == 1 and "_b#" in joins[0]  # one row per (category, block) on either side


def test_works_cite_across_blocks_keys_and_nulls_without_exchanging_edges(spark):
    # repeated, negative, sparse and missing keys, missing dates, the ends of the key blocks
    import random
    import tempfile
    from collections import Counter, defaultdict
    from citesight.sources import fixtures as fx
    r, path = random.Random(5), tempfile.mkdtemp(prefix="citesight-test-")
    keys = [r.choice([r.randrange(-2200, -1900), r.randrange(0, 250), r.randrange(2000, 2150), r.randrange(10**12), None]) for _ in range(1200)]
    orders = [(k, 1, None if r.random() < .05 else d(1990) + dt.timedelta(days=r.randrange(2000)), "a", "F", 1.0) for k in keys]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string, "
                          "o_totalprice double").repartition(5).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, "m", 1)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    for t in ("embeddings", "documents"):
        spark.range(3).write.parquet(f"{path}/{t}.parquet")
    day = defaultdict(list)
    for o in orders:
        day[o[0]].append(o[2])
    hub = min(((o[2] is not None, o[2] or d(1), o[0] is not None, o[0] or 0) for o in orders))
    hub = hub[3] if hub[2] else None
    refs, years = defaultdict(list), defaultdict(Counter)
    for k, _, when, *_ in orders:
        if k is None or when is None:
            continue
        cited = [k - x for x in fx.CITATION_OFFSETS]
        if hub is not None and k % 3 == 0 and k - hub not in fx.CITATION_OFFSETS:
            cited.append(hub)
        for ref in cited:
            for other in day.get(ref, ()):
                if other is not None and other < when:
                    refs[k].append(ref)
                    years[ref][when.year] += 1
    w = fx.works(spark, path)
    got = Counter((x.id, tuple(x.referenced_works or ()), tuple(zip(x.counts_by_year_years or (), x.counts_by_year_counts or ())),
                   x.cited_by_count) for x in w.collect())
    assert got == Counter((k, tuple(sorted(refs[k])), tuple(sorted(years[k].items())), sum(years[k].values())) for k in keys)
    plan = fx.citations_by_work(fx.table(spark, path, "orders"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(_block") == 1
