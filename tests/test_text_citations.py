"""Cleaning, citation features, density clustering, labels, sampling and describe edge cases."""

import datetime as dt
import math

from pyspark.sql import functions as F

from citesight.operators import citations as FE
from citesight.operators import clean as C
from citesight.operators import describe as D
from citesight.operators import labels as L
from citesight.operators import sampling as B
from citesight.operators import tokens as K


def test_boilerplate_and_markers(spark):
    df = spark.createDataFrame([(1, "Copyright holds.", "en"), (2, "uses de facto", "en"), (3, None, "en"),
                                (4, "plain text.", "en")], "id long, text string, language string")
    out = {r.id: r for r in C.clean_column(df, "text", level=2).collect()}
    assert out[1].text is None                  # lower-cased, then 'copyright'
    assert out[2].language == "unknown"         # 'de ' marker
    assert out[3].text is None and out[3].language == "en"
    assert out[4].text == "plain text."


def test_length_bounds_keep_inside(spark):
    rows = [(i, "x" * n + ".") for i, n in enumerate([10, 11, 12, 10, 11, 12, 10, 500])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("language", F.lit("en"))
    out = C.clean_column(df, "text", min_len=5, level=4).where("text is not null").count()
    assert out == 8 or out == 7    # the 500-char outlier is above mean + 3 sd only with enough rows
    lvl5 = C.clean_column(df, "text", min_len=12, level=5).collect()
    assert all(r.text.endswith(".") for r in lvl5)


def test_reverse_citations_and_delays(spark):
    rows = [(1, dt.date(2000, 1, 1), [], 3), (2, dt.date(2001, 6, 1), [1], 0), (3, dt.date(2002, 1, 1), [1, 1], 0)]
    df = spark.createDataFrame(rows, "id long, publication_date date, referenced_works array<long>, cited_by_count long")
    rc = {(r.id, r.cited_by_date): r.n_citing for r in FE.reverse_citations(df).collect()}
    assert rc == {(1, dt.date(2001, 6, 1)): 1, (1, dt.date(2002, 1, 1)): 2}
    s = FE.citation_summary(FE.reverse_citations(df))
    r = FE.citation_delays(FE.attach_citers(df, s)).collect()
    assert len(r) == 1 and r[0].missing == 0
    assert r[0].cited_by_delta_years_first == 1 and r[0].cited_by_delta_days_first == 517


def test_bursts_border_point_goes_left_and_noise(spark):
    rows = [(1, [0, 2, 4, 6, 8], [5, 1, 1, 1, 5]),   # cores 0, 2 | 6, 8 (eps 2, min 4); 4 borders both -> left
            (2, [0, 10], [1, 1]),                    # noise only
            (3, [], [])]                             # empty: skipped
    df = spark.createDataFrame(rows, "id long, counts_by_year_delta array<int>, counts_by_year_counts array<long>")
    out = FE.citation_bursts(df, eps=2, min_weight=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert 3 not in by
    assert by[2][0].n_clusters == 0 and by[2][0].noise_ratio == 1.0
    c = sorted(by[1], key=lambda r: r.cluster)
    assert by[1][0].n_clusters == 2
    assert c[0].n_members == 3 and c[1].n_members == 2      # 0, 2, 4 | 6, 8
    assert math.isclose(c[0].centroid, (0 * 5 + 2 * 1 + 4 * 1) / 7)
    assert by[1][0].noise_ratio == 0.0


def test_labels_strict_threshold_and_ordinal_boundary(spark):
    df = spark.createDataFrame([(15,), (16,), (3,)], "y long")
    r = df.select(L.label_threshold("y", 15).alias("t"), L.label_ordinal("y", [3, 15]).alias("o")).collect()
    assert [x.t for x in r] == [0, 1, 0]
    assert [x.o for x in r] == [2, 2, 1]


def test_pad_truncate_lengths(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3],), ([1, 2, 3, 4],)], "x array<long>")
    r = [x.p for x in df.select(L.pad_truncate("x", 3).alias("p")).collect()]
    assert r == [[1, 2, 0], [1, 2, 3], [1, 2, 3]]


def test_inverse_freq_min_equals_max(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    r = B.inverse_freq_weights(df, "v").collect()
    assert {x.bin for x in r} == {0}
    assert all(math.isclose(x.weight, 1 / (2 + 1e-6)) for x in r)


def test_bucket_counts_empty_bucket(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "v long")
    c = {r.label: r["count"] for r in D.bucket_counts(df, "v", [0, 1, 2, 10]).collect()}
    assert c == {"0-1": 1, "1-2": 1, "2-10": 1}
    c = D.balance_weights(D.bucket_counts(df, "v", [0, 1, 2, 3])).collect()
    assert any(math.isnan(r.weight) for r in c)


def test_tokenise_null_text_and_unknown(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "zz")], "doc_id long, text string")
    vocab = K.build_vocab(docs.where("doc_id = 1"), "text")
    t = {r.doc_id: r.text_tokens for r in K.tokenise(docs, "doc_id", "text", vocab).collect()}
    assert t[2] == []
    assert t[1] == [1, 4, 5, 4, 2]
    assert t[3] == [1, 3, 2]


def test_sample_n_reproducible(spark):
    df = spark.range(1000)
    a = sorted(r.id for r in B.sample_n(df.repartition(3), 50, seed=1).collect())
    b = sorted(r.id for r in B.sample_n(df.repartition(11), 50, seed=1).collect())
    assert a == b and len(a) == 50


def test_contains_any_equals_each_needle_alone(spark):
    import random
    rng = random.Random(12)
    bits = C.FOREIGN_MARKERS + C.BOILERPLATE_PHRASES + ["x", "d", "e", "e ", "ké", "日", " ", "]", "^", "-", "\\", "😀"]
    rows = [("".join(rng.choice(bits) if rng.random() < 0.3 else rng.choice("abc .") for _ in range(rng.randint(0, 12))),) for _ in range(400)]
    rows += [(None,), ("",), ("]",), ("a-b",), ("de",), ("de ",)]
    df = spark.createDataFrame(rows, "t string")
    for needles in (C.FOREIGN_MARKERS, C.BOILERPLATE_PHRASES, ["]", "^", "-", "\\"], ["😀", "é", "日本", "日"], [], [""]):
        got = df.select("t", C.contains_any("t", needles).alias("hit")).collect()
        for r in got:
            want = any(n in r.t for n in needles) if r.t is not None else None
            assert bool(r.hit) == bool(want), (needles, r)


def test_bounds_of_all_columns_in_one_pass_equal_one_by_one(spark):
    rows = [(i, "word " * (i % 9) + ("." if i % 3 else ""), "other " * (i % 5) + ("." if i % 4 else "x"), "en") for i in range(200)]
    rows += [(999, "w " * 900 + ".", None, "en"), (1000, None, "o" * 500 + ".", "en")]
    df = spark.createDataFrame(rows, "id int, a string, b string, language string")
    for la, lb in ((4, 5), (5, 4), (3, 3), (5, 5), (1, 4)):
        one = C.clean_column(C.clean_column(df, "a", 5, la), "b", 5, lb)
        both = C.clean_text(df, [C.CleanSpec("a", la, 5), C.CleanSpec("b", lb, 5)])
        assert sorted(map(repr, one.collect())) == sorted(map(repr, both.collect()))
    from citesight.operators.clean import _bounded
    plan = _bounded(df, [("a", 1, True), ("b", 1, True)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
