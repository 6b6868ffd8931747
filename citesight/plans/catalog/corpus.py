"""Queries over the corpus: filters and projections (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesight.functions.columns import list_len
from citesight.operators import filters as P
from citesight.plans.registry import register
from citesight.sources import fixtures as fx

W = fx.with_views("works")


@register("p1_time_window", W + """SELECT id, publication_date FROM works
WHERE publication_date >= DATE '1997-01-01' AND publication_date < DATE '1999-01-01'""")
def p1(spark, sf):
    w = fx.works(spark, sf)
    return P.time_window(w, "publication_date", "1997-01-01", "1999-01-01").select("id", "publication_date")


@register("p2_membership_filter", W + """SELECT id, field_id, type FROM works
WHERE field_id IN (1, 3, 5, 7) AND type IN ('article')""")
def p2(spark, sf):
    w = fx.works(spark, sf)
    w = P.membership_filter(w, "field_id", [1, 3, 5, 7])
    w = P.membership_filter(w, "type", ["article"])
    w = P.membership_filter(w, "topic_name", [])  # empty list: no filter
    return w.select("id", "field_id", "type")


@register("p3_licence_filter", W + "SELECT id FROM works WHERE is_license_safe")
def p3(spark, sf):
    return P.licence_filter(fx.works(spark, sf)).select("id")


@register("p4_null_by_licence", W + """SELECT id,
  CASE WHEN is_license_safe = false THEN NULL ELSE topic_name END AS topic_name,
  CASE WHEN is_license_safe = false THEN NULL ELSE score END AS score FROM works""")
def p4(spark, sf):
    return P.null_by_licence(fx.works(spark, sf), ["topic_name", "score"]).select("id", "topic_name", "score")


@register("p5_drop_nulls", W + """SELECT id FROM works
WHERE referenced_works IS NOT NULL AND counts_by_year_years IS NOT NULL""")
def p5(spark, sf):
    return P.drop_nulls(fx.works(spark, sf), ["referenced_works", "counts_by_year_years"]).select("id")


@register("p6_user_predicate", W + "SELECT id, score FROM works WHERE score > 300000 AND type = 'article'")
def p6(spark, sf):
    return P.user_predicate(fx.works(spark, sf), "score > 300000 AND type = 'article'").select("id", "score")


@register("p7_cited_and_referencing", W + """SELECT id, cited_by_count, CAST(len(referenced_works) AS INTEGER) AS n_refs
FROM works WHERE cited_by_count >= 1 AND len(referenced_works) >= 5""")
def p7(spark, sf):
    w = P.cited_and_referencing(fx.works(spark, sf))
    return w.select("id", "cited_by_count", list_len("referenced_works").alias("n_refs"))


@register("p8_max_total_length", W + """SELECT id,
  CAST(coalesce(len(referenced_works), 0) + coalesce(len(counts_by_year_years), 0) AS INTEGER) AS total_len
FROM works WHERE coalesce(len(referenced_works), 0) + coalesce(len(counts_by_year_years), 0) <= 8""")
def p8(spark, sf):
    cols = ["referenced_works", "counts_by_year_years"]
    w = P.max_total_length(fx.works(spark, sf), cols, 8)
    return w.select("id", P.total_length(cols).alias("total_len"))


@register("p9_concat_lists", W + """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, value FROM (
  SELECT id, unnest(l) AS value, unnest(range(1, len(l) + 1)) AS pos FROM (
    SELECT id, CASE WHEN referenced_works IS NULL THEN NULL
                    ELSE list_concat(referenced_works, [cited_by_count]) END AS l FROM works))""")
def p9(spark, sf):
    w = P.concat_lists(fx.works(spark, sf), ["referenced_works", "cited_by_count"], "x")
    return w.select("id", F.posexplode("x").alias("pos", "value"))


@register("p10_length_feature", W + """SELECT id, CAST(length(topic_name) AS INTEGER) AS topic_name_len,
  CAST(len(referenced_works) AS INTEGER) AS referenced_works_len FROM works""")
def p10(spark, sf):
    w = P.length_feature(fx.works(spark, sf), ["topic_name", "referenced_works"])
    return w.select("id", "topic_name_len",
                    F.when(F.col("referenced_works").isNotNull(), F.col("referenced_works_len"))
                    .alias("referenced_works_len"))


@register("p10_length_feature_text", """SELECT doc_id, CAST(length(text) AS INTEGER) AS text_len FROM documents""")
def p10t(spark, sf):
    return P.length_feature(fx.documents(spark, sf), ["text"]).select("doc_id", "text_len")


# ---------------------------------------------------------------- sources and sinks (S)
from citesight.operators import describe as D  # noqa: E402
from citesight.operators import sampling as B  # noqa: E402
from citesight.sources import io as S  # noqa: E402
from citesight.functions.columns import with_scalars

_IDX = W + """, ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM works)
"""


@register("s1_scan_corpus", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s1(spark, sf):
    return S.scan_corpus(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@register("s2_ordered_chunks", _IDX + """SELECT id, CAST(least(floor(idx / greatest(ceil(n / 7), 1)), 6) AS INTEGER) AS part FROM ix""")
def s2(spark, sf):
    return S.ordered_chunks(fx.works(spark, sf).select("id"), ["id"], 7)


@register("s3_chunks_by_rows", _IDX + "SELECT id, CAST(floor(idx / 2000) AS INTEGER) AS part FROM ix")
def s3(spark, sf):
    return S.chunks_by_rows(fx.works(spark, sf).select("id"), ["id"], 2000)


@register("s4_write_chunks", _IDX + """SELECT id, topic_name, CAST(least(floor(idx / greatest(ceil(n / 7), 1)), 6) AS INTEGER) AS part
FROM ix JOIN works USING (id)""")
def s4(spark, sf):
    w = fx.works(spark, sf).select("id", "topic_name")
    path = S.write_chunks(S.ordered_chunks(w, ["id"], 7), S.scratch_path(spark, "chunks"))
    return spark.read.parquet(path).select("id", "topic_name", "part")


@register("s5_written_counts", _IDX + """SELECT CAST(least(floor(idx / greatest(ceil(n / 7), 1)), 6) AS INTEGER) AS part,
  count(*) AS rows FROM ix GROUP BY 1""")
def s5(spark, sf):
    w = fx.works(spark, sf).select("id")
    path = S.write_chunks(S.ordered_chunks(w, ["id"], 7), S.scratch_path(spark, "chunks"))
    return S.written_counts(spark, path)


@register("s4_sized_chunks", _IDX + """, ch AS (SELECT idx, CAST(least(floor(idx / greatest(ceil(n / 7), 1)), 6) AS INTEGER) AS part FROM ix),
fl AS (SELECT part, idx, floor((idx - min(idx) OVER (PARTITION BY part)) / 500) AS f FROM ch)
SELECT part, count(*) AS rows, min(idx) AS first, max(idx) AS last, FALSE AS rewritten FROM fl GROUP BY part, f""")
def s4s(spark, sf):
    from citesight.sources import staging as ST
    works = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic_name"))
    c = S.ordered_chunks(works, ["id"], 7, keep_index=True)
    path = S.scratch_path(spark, "sized")
    ST.write_sized_chunks(c, path, 500)
    again = ST.write_sized_chunks(c, path, 500)
    return ST.manifest(spark, path).select("part", "rows", "first", "last", F.lit(again).alias("rewritten"))


@register("s8_stage_once", "SELECT o_orderkey AS id, o_totalprice AS score, FALSE AS first_reused, TRUE AS second_reused FROM orders WHERE o_orderstatus = 'F'")
def s8o(spark, sf):
    from citesight.sources import staging as ST
    t = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    one, two = ST.stage_once(t, auto_remove=True), ST.stage_once(t)
    return two.frame.select("*", F.lit(one.reused).alias("first_reused"), F.lit(two.reused).alias("second_reused"))


@register("s6_dry_run_head", W + "SELECT id, publication_date FROM works ORDER BY id LIMIT 50")
def s6(spark, sf):
    return S.dry_run_head(fx.works(spark, sf).select("id", "publication_date"), 50)


@register("s7_json_sink", W + "SELECT id, topic_name, score FROM works")
def s7(spark, sf):
    path = S.json_sink(fx.works(spark, sf).select("id", "topic_name", "score"), S.scratch_path(spark, "json"))
    return spark.read.schema("id long, topic_name string, score double").json(path)


@register("s7_params_json", W + """SELECT '{"chunks": "7", "compression": "zstd", "level": "1"}' AS params,
  (SELECT count(*) FROM works) AS rows""")
def s7p(spark, sf):
    # run parameters as one JSON row, next to the counts they describe
    p = S.params_frame(spark, {"chunks": 7, "compression": "zstd", "level": 1})
    n = fx.works(spark, sf).agg(F.count(F.lit(1)).alias("rows"))
    return with_scalars(p, n)


@register("s8_stage_table", W + "SELECT id, cited_by_count FROM works WHERE referenced_works IS NOT NULL")
def s8(spark, sf):
    t = fx.works(spark, sf).where(F.col("referenced_works").isNotNull()).select("id", "cited_by_count")
    return S.stage_table(t)


@register("s9_export_predictions", fx.with_views("scored_windows") + """SELECT make_date(w, 1, 1) AS window_start,
  id, y, prob FROM scored_windows""")
def s9(spark, sf):
    p = fx.scored_windows(spark, sf).withColumn("window_start", F.make_date("w", F.lit(1), F.lit(1)))
    path = S.export_predictions(p, S.scratch_path(spark, "pred"))
    r = spark.read.parquet(path)
    return r.select(F.col("window_start").cast("date").alias("window_start"), "id", "y", "prob")


# ---------------------------------------------------------------- sampling (B)
_DRAW = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@register("b1_sample_n", W + "SELECT id, score FROM works ORDER BY md5(id || '|42'), id LIMIT 500")
def b1(spark, sf):
    return B.sample_n(fx.works(spark, sf).select("id", "score"), 500, seed=42)


@register("b2_head_n", W + "SELECT id, score FROM works ORDER BY id LIMIT 1000")
def b2(spark, sf):
    return B.head_n(fx.works(spark, sf).select("id", "score"), 1000)


@register("b3_sample_uniform_replace", W + f""", ix AS (SELECT id, score, row_number() OVER (ORDER BY id) - 1 AS pos FROM works),
dr AS (SELECT draw, CAST(floor({_DRAW.format("draw || '|7'")} * (SELECT count(*) FROM works)) AS BIGINT) AS pos
       FROM range(0, 2000) t(draw))
SELECT draw, id, score FROM dr JOIN ix USING (pos)""")
def b3(spark, sf):
    return B.sample_uniform_replace(fx.works(spark, sf).select("id", "score"), 2000, seed=7)


_B4 = W + """, st AS (SELECT min(CAST(score AS DOUBLE)) AS mn, max(CAST(score AS DOUBLE)) AS mx FROM works),
b AS (SELECT id, CAST(CASE WHEN mx - mn = 0 THEN 0 ELSE least(greatest(CAST(trunc((score - mn) / (mx - mn) * 100) AS BIGINT), 0), 99) END AS INTEGER) AS bin
      FROM works, st),
c AS (SELECT bin, count(*) AS c FROM b GROUP BY bin)
"""


@register("b4_inverse_freq_weights", _B4 + "SELECT b.id, b.bin, 1.0 / (c.c + 1e-6) AS weight FROM b JOIN c USING (bin)")
def b4(spark, sf):
    return B.inverse_freq_weights(fx.works(spark, sf).select("id", "score"), "score", 100).select("id", "bin", "weight")


@register("b5_sample_weighted_replace", _B4 + f""", bw AS (SELECT b.id, b.bin, w.score, 1.0 / (c.c + 1e-6) AS weight
        FROM b JOIN c USING (bin) JOIN works w USING (id)),
ix AS (SELECT *, row_number() OVER (ORDER BY bin, id) - 1 AS pos FROM bw),
bins AS (SELECT bin, count(*) AS cnt, count(*) * any_value(weight) AS mass, min(pos) AS start FROM ix GROUP BY bin),
cum AS (SELECT *, sum(mass) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS mhi FROM bins),
edge AS (SELECT bin, cnt, start, coalesce(lag(mhi) OVER (ORDER BY bin), 0) AS mlo,
                CASE WHEN lead(mhi) OVER (ORDER BY bin) IS NULL THEN CAST('inf' AS DOUBLE) ELSE mhi END AS mtop FROM cum),
dr AS (SELECT draw, {_DRAW.format("draw || '|1|11'")} * (SELECT max(mhi) FROM cum) AS u1, {_DRAW.format("draw || '|2|11'")} AS u2
       FROM range(0, 5000) t(draw)),
pk AS (SELECT draw, CAST(start + floor(u2 * cnt) AS BIGINT) AS pos FROM dr JOIN edge ON u1 >= mlo AND u1 < mtop)
SELECT pk.draw, ix.id, ix.score, ix.bin, ix.weight FROM pk JOIN ix USING (pos)""")
def b5(spark, sf):
    binned = B.inverse_freq_weights(fx.works(spark, sf).select("id", "score"), "score", 100)
    return B.sample_weighted_replace(binned, 5000, seed=11)


# ---------------------------------------------------------------- describe (D)
BUCKETS = [0, 1, 2, 4, 8, 16, 100]
_BK = W + """, bk AS (SELECT CAST(i - 1 AS INTEGER) AS bucket, b[i] || '-' || b[i + 1] AS label, CAST(b[i] AS DOUBLE) AS lo,
                CAST(b[i + 1] AS DOUBLE) AS hi FROM (SELECT [0, 1, 2, 4, 8, 16, 100] AS b), range(1, 7) t(i)),
cnt AS (SELECT bk.bucket, bk.label, bk.lo, bk.hi, count(w.id) AS count FROM bk
        LEFT JOIN works w ON w.cited_by_count >= bk.lo AND w.cited_by_count < bk.hi GROUP BY ALL)
"""


@register("d1_bucket_counts", _BK + "SELECT * FROM cnt")
def d1(spark, sf):
    return D.bucket_counts(fx.works(spark, sf), "cited_by_count", BUCKETS)


@register("d2_bucket_proportions", _BK + """SELECT label, count, count * 100.0 / sum(count) OVER () AS pct,
  round_even(count * 100.0 / sum(count) OVER (), 1) AS proportion FROM cnt""")
def d2(spark, sf):
    return D.bucket_proportions(D.bucket_counts(fx.works(spark, sf), "cited_by_count", BUCKETS)).select(
        "label", "count", "pct", "proportion")


@register("d3_balance_weights", _BK + """SELECT label, CASE WHEN count = 0 THEN CAST('nan' AS DOUBLE)
  ELSE sum(count) OVER () / (count(*) OVER () * count) END AS weight FROM cnt""")
def d3(spark, sf):
    return D.balance_weights(D.bucket_counts(fx.works(spark, sf), "cited_by_count", BUCKETS)).select("label", "weight")


@register("d4_describe_column", W + """SELECT count(score) AS count, CAST(count_if(score IS NULL) AS BIGINT) AS null_count,
  CAST(count_if(isnan(score)) AS BIGINT) AS nan_count,
  round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min,
  round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.75), 6) AS p75, max(score) AS max FROM works""")
def d4(spark, sf):
    from citesight.functions.columns import r6
    d = D.describe_column(fx.works(spark, sf), "score")
    return d.select("count", "null_count", "nan_count", r6("mean").alias("mean"), r6("std").alias("std"), "min",
                    r6("p25").alias("p25"), r6("p50").alias("p50"), r6("p75").alias("p75"), "max")


_DESC = """SELECT '{c}' AS "column", count({c}) AS count, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count,
  CAST(0 AS BIGINT) AS nan_count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM ww"""


@register("d5_describe_job", W + ", ww AS (SELECT * FROM works WHERE publication_date >= DATE '1996-01-01' "
          "AND publication_date < DATE '2000-01-01' AND cited_by_count >= 1 AND len(referenced_works) >= 5)\n"
          + " UNION ALL ".join(_DESC.format(c=c) for c in ("score", "cited_by_count", "field_id")))
def d5(spark, sf):
    from citesight.functions.columns import r6
    w = P.cited_and_referencing(fx.works(spark, sf))
    d = D.describe_columns(w, ["score", "cited_by_count", "field_id"], "publication_date", "1996-01-01", "2000-01-01")
    return d.select("column", "count", "null_count", "nan_count", r6("mean").alias("mean"), r6("std").alias("std"), "min",
                    r6("p25").alias("p25"), r6("p50").alias("p50"), r6("p75").alias("p75"), "max")


_REPORT = """SELECT '{c}' AS "column", 'statistic' AS item, k AS label, v AS value, CASE k WHEN 'min' THEN mn WHEN 'max' THEN mx END AS text FROM (
  SELECT unnest(['count', 'null_count', 'nan_count', 'mean', 'std', 'min', 'p25', 'p50', 'p75', 'max']) AS k, unnest(vs) AS v, mn, mx FROM (
    SELECT [CAST(count({c}) AS DOUBLE), CAST(count_if({c} IS NULL) AS DOUBLE), 0, avg({n}), stddev_samp({n}), min({n}), quantile_cont({n}, 0.25),
            quantile_cont({n}, 0.5), quantile_cont({n}, 0.75), max({n})] AS vs, {t} FROM works))"""
_REPORT_BUCKETS = """SELECT 'cited_by_count' AS "column", item, label, CASE item WHEN 'count' THEN count
    WHEN 'proportion' THEN round_even(count * 100.0 / sum(count) OVER (PARTITION BY item), 1)
    ELSE CASE WHEN count = 0 THEN CAST('nan' AS DOUBLE) ELSE sum(count) OVER (PARTITION BY item) / (count(*) OVER (PARTITION BY item) * count) END
  END AS value, CAST(NULL AS VARCHAR) AS text FROM cnt, (SELECT unnest(['count', 'proportion', 'weight']) AS item)"""


@register("d6_describe_report", _BK + 'SELECT "column", item, label, round(value, 6) AS value, text FROM (' + " UNION ALL ".join([
    _REPORT.format(c="cited_by_count", n="CAST(cited_by_count AS DOUBLE)", t="min(cited_by_count)::VARCHAR AS mn, max(cited_by_count)::VARCHAR AS mx"),
    _REPORT.format(c="publication_date", n="CAST(publication_date - DATE '1970-01-01' AS DOUBLE)",
                   t="min(publication_date)::VARCHAR AS mn, max(publication_date)::VARCHAR AS mx"),
    _REPORT.format(c="topic_name", n="CAST(NULL AS DOUBLE)", t="min(topic_name) AS mn, max(topic_name) AS mx"),
    _REPORT.format(c="is_license_safe", n="CAST(is_license_safe::INT AS DOUBLE)",
                   t="min(is_license_safe)::VARCHAR AS mn, max(is_license_safe)::VARCHAR AS mx"), _REPORT_BUCKETS]) + ")")
def d6(spark, sf):
    from citesight.functions.columns import r6
    d = D.describe_report(fx.works(spark, sf), ["cited_by_count", "publication_date", "topic_name", "is_license_safe"], BUCKETS)
    return d.select("column", "item", "label", r6("value").alias("value"), "text")


@register("d4_describe_column_grouped", W + """SELECT topic_name, count(score) AS count, round(avg(score), 6) AS mean, min(score) AS min,
  round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.75), 6) AS p75, max(score) AS max FROM works GROUP BY topic_name""")
def d4g(spark, sf):
    from citesight.functions.columns import r6
    d = D.describe_column(fx.works(spark, sf), "score", group_cols=["topic_name"])
    return d.select("topic_name", "count", r6("mean").alias("mean"), "min", *[r6(p).alias(p) for p in ("p25", "p50", "p75")], "max")
