"""URL filter: domain rules first, then a character language-model ratio; DataFrame expressions only.

A rule is a host and a path prefix with a verdict; it fits the host, its
subdomains and every path that starts with its own; the longest wins. URLs
that no rule fits are judged by two character Markov models, one of the
rule-accepted and one of the rule-rejected URLs. Orders 0 to ``ORDER`` are
interpolated (Witten-Bell): a context seen ``n`` times with ``t`` different
successors gives ``(count + t * lower order) / (n + t)``, a context never
seen passes on to the next shorter one, and below order 0 lies the uniform
distribution. The score is the mean over a URL's characters of the
difference of the log probabilities. The cut is calibrated on labelled URLs
that the counts have not seen (three sixteenths, by hash): the middle of the
gap between hundredths that maximises accepted plus rejected rates, nearest to
0 among equals.

Counts are taken over all labelled rows with map-side combine. Probabilities
are worked out once per distinct gram, order by order; a join key there has
at most one row per character of the alphabet. The grams of the URLs then
meet the model in a join that salts hot grams by the counts at hand.

Cases: a null URL, or one without ``://``, has empty host and path and is
scored on what text there is; without examples of either kind all scores are
0 and the verdict is allow; repeated rows each get their row; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesight.functions.columns import with_scalars
from citesight.llm.common import ascii_lower, join_by_counts, stage, with_rid

#: (host, path prefix, verdict): the rules of the query's contract, fixed values.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 4
BEGIN, STOP = "\x02", "\x03"
CALIBRATION = ("0", "1", "2")
BINS = 2_000


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str, str]], h: Column, p: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null if none fits."""
    none = F.lit(None).cast("string")
    name, verdict = [none], [none]
    for rh, rp, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name.insert(0, F.when(fits, F.lit(rh + rp)))
        verdict.insert(0, F.when(fits, F.lit(v)))
    return F.coalesce(*name), F.coalesce(*verdict)


def _probabilities(grams: DataFrame, order: int) -> DataFrame:
    """(gram, n, pa, pr): smoothed probability of the last character after the others, per class."""
    tables = [grams]
    for _ in range(order):
        tables.insert(0, tables[0].groupBy(F.substring("gram", 2, order + 1).alias("gram"))
                      .agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n")))
    lower = None
    for o, t in enumerate(tables):
        ctx = Window.partitionBy(F.substring("gram", 1, o))
        t = t.select("gram", "n", "a", "r",
                     *[F.sum(c).over(ctx).alias(f"n{c}") for c in "ar"],
                     *[F.sum((F.col(c) > 0).cast("long")).over(ctx).alias(f"t{c}") for c in "ar"])
        if lower is None:
            size = t.agg((1.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("u"))
            t = with_scalars(t, size)
            t = t.withColumns({"la": F.col("u"), "lr": F.col("u")})
        else:
            t = t.withColumn("tail", F.substring("gram", 2, order + 1)).join(
                lower.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "tail")
        lower = t.select("gram", "n", *[F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"l{c}"))
                                               / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"l{c}")).alias(f"p{c}")
                                        for c in "ar"])
    return lower


def _cut(scored: DataFrame) -> DataFrame:
    """One row ``cut`` from (score, label) of calibration URLs; at most 2 * BINS + 1 bins."""
    at = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(BINS)), F.lit(-BINS))
    bins = scored.groupBy(at.alias("bin")).agg(F.sum((F.col("label") == "allow").cast("long")).alias("a"),
                                               F.sum((F.col("label") == "block").cast("long")).alias("r"))
    every, above = Window.partitionBy(), Window.orderBy(F.desc("bin"))
    # a cut at a bin does the same as any above the next lower bin held: take the middle
    lower = F.lead("bin").over(above)
    bins = bins.select("bin", (F.coalesce((F.col("bin") + lower + 1) / 200.0, F.col("bin") / 100.0)).alias("cut"),
                       F.sum("a").over(above).alias("a_above"), F.sum("r").over(above).alias("r_above"),
                       F.sum("a").over(every).alias("a_all"), F.sum("r").over(every).alias("r_all"))
    gain = F.when((F.col("a_all") > 0) & (F.col("r_all") > 0),
                  F.col("a_above") * F.col("r_all") - F.col("r_above") * F.col("a_all"))
    best = bins.select(F.struct(gain.alias("gain"), (-F.abs("cut")).alias("near"), "cut").alias("s")).where(
        F.col("s.gain").isNotNull())
    return best.agg(F.coalesce(F.max("s")["cut"], F.lit(0.0)).alias("cut"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    url = F.col("url")
    rows = with_rid(pages.select("page_id", "url")).select(
        "rid", "page_id", host(url).alias("host"), path(url).alias("path"),
        F.when(url.contains("://"), F.lit("")).otherwise(F.coalesce(url, F.lit(""))).alias("bare"),
        F.md5(F.coalesce(url, F.lit("")).cast("binary")).alias("md5"))
    name, label = longest_rule(rules, F.col("host"), F.col("path"))
    rows = rows.select("rid", "page_id", "host", "path", name.alias("rule"), label.alias("label"),
                       F.substring("md5", 1, 1).isin(*CALIBRATION).alias("held"),
                       F.concat(F.lit(BEGIN * order), "host", "path", "bare", F.lit(STOP)).alias("s"))
    occurrences = rows.select("rid", "label", "held", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("s") - order), lambda i: F.substring(F.col("s"), i, F.lit(order + 1))))
        .alias("gram"))
    seen = ~F.col("held")
    grams = stage(occurrences.groupBy("gram").agg(
        F.sum((seen & (F.col("label") == "allow")).cast("long")).alias("a_"),
        F.sum((seen & (F.col("label") == "block")).cast("long")).alias("r_"),
        F.count(F.lit(1)).alias("n")).select("gram", F.coalesce("a_", F.lit(0)).alias("a"),
                                             F.coalesce("r_", F.lit(0)).alias("r"), "n"), "url-grams")
    model = stage(_probabilities(grams, order).select(
        "gram", "n", (F.log("pa") - F.log("pr")).alias("llr")), "url-model")
    scores = (join_by_counts(occurrences.select("rid", "gram"), model, "gram", "n", "inner")
              .groupBy("rid").agg((F.sum("llr") / F.count(F.lit(1))).alias("score")))
    scored = stage(rows.drop("s").join(scores, "rid"), "url-scores")
    cut = _cut(scored.where(F.col("held") & F.col("label").isNotNull()))
    own = F.when(F.col("score") >= F.col("cut"), F.lit("allow")).otherwise(F.lit("block"))
    return with_scalars(scored, cut).select("page_id", "host", "path", "rule",
                                            F.coalesce("label", own).alias("verdict"), F.round("score", 6).alias("score"))
