"""Quality rules judged per document and per host, in DataFrame expressions only.

Each text gets exact counts (words, symbols, repeated lines, words inside
repeated ``RUN``-word windows) and fails the base rules by them: too few
words, or too many inside repeats. Failures are then summed by host (the
``source`` column), rule by rule. Raw rates of small hosts are noisy, so each
is shrunk towards the corpus: a beta prior is fitted to the host rates of the
rule by the method of moments, and a host's rate is its posterior mean
``(failed + a) / (docs + a + b)``. A host loses its documents when its rate by
any rule lies more than ``OUTLIER`` standard deviations of that prior above
the prior's mean, or above ``max_rate``. The counts are staged once (narrow
rows, no text), summed with map-side combine, and the host verdict comes back
by a join that salts hot hosts with the counts at hand.

Windows are sorted by (64-bit hash, place) and two neighbours of equal hash
count as equal only if their words are: no collision invents a repeat,
however long the text.

Cases: null and empty texts have no words and fail; a null source is a host
of its own; one host, or hosts of equal rates, keep their own shared rate and
are no outliers; repeated rows count as often as they occur; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesight.functions.columns import with_scalars
from citesight.llm.common import SPACE_RUN, join_by_counts, split_words, stage

RUN = 3
SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_RATE = 50, 50, 0.5
RULES = ("short", "repeats")
#: Standard deviations of the prior beyond which a host's rate is an outlier.
OUTLIER = 3.0
#: Strength of the prior when all hosts have the same rate.
EQUAL_HOSTS_STRENGTH = 1e6


def _next(a: Column, fn) -> Column:
    return F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), fn)


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, split_words(text, SPACE_RUN).alias("w"), lines.alias("lines"),
                     F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"))
    keep = [*keep, "n_symbols"]
    df = df.select(
        *keep, F.size("w").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "w",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    keep = [*keep, "n_words", "word_chars", "n_dup_lines"]
    for _ in range(RUN - 1):
        df = df.select(*keep, "w", _next(F.col("h"), lambda a, b: F.xxhash64(a, b)).alias("h"))
    whole = F.slice("h", F.lit(1), F.greatest(F.col("n_words") - (RUN - 1), F.lit(0)).cast("int"))
    df = df.select(*keep, "w", F.sort_array(F.transform(
        whole, lambda x, i: F.struct(x.alias("h"), i.alias("i")))).alias("p"))

    def same(x: Column, y: Column) -> Column:
        words = F.lit(True)
        for k in range(RUN):
            words = words & (F.get("w", x["i"] + k) == F.get("w", y["i"] + k))
        return F.when(x["h"] == y["h"], words).otherwise(False)

    # only windows beside one of equal hash are looked at word by word
    repeated = F.filter("p", lambda x, i: F.coalesce(same(x, F.get("p", i + 1)), F.lit(False))
                        | F.coalesce(same(x, F.get("p", i - 1)), F.lit(False)))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"].cast("long")))
    df = df.select(*keep, places.alias("at"))
    steps = _next(F.col("at"), lambda a, b: F.least(F.lit(RUN).cast("long"), b - a))
    return df.select(*keep, F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def host_rates(counts: DataFrame, max_rate: float = MAX_RATE, outlier: float = OUTLIER) -> DataFrame:
    """(host, docs, and of each rule: failed, rate, cut; rejected).

    ``counts`` (host, fails_<rule>...). Rates are shrunk with the rule's empirical beta prior; the cut
    lies ``outlier`` standard deviations of the prior above its mean, at most at ``max_rate``.
    """
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[
        F.sum(F.col(f"fails_{r}").cast("long")).alias(f"failed_{r}") for r in RULES])
    raw = {r: F.col(f"failed_{r}") / F.col("docs") for r in RULES}
    prior = hosts.agg(*[f(raw[r]).alias(f"{n}_{r}") for r in RULES for n, f in (("mean", F.avg), ("var", F.var_pop))])
    strength = {r: F.when(F.col(f"var_{r}") > 0, F.greatest(
        F.col(f"mean_{r}") * (1 - F.col(f"mean_{r}")) / F.col(f"var_{r}") - 1, F.lit(0.0))).otherwise(F.lit(EQUAL_HOSTS_STRENGTH))
        for r in RULES}
    prior = prior.select(*[c for r in RULES for c in (F.col(f"mean_{r}"), strength[r].alias(f"strength_{r}"))])
    hosts = with_scalars(hosts, prior)
    rate, cut = {}, {}
    for r in RULES:
        mean, s = F.col(f"mean_{r}"), F.col(f"strength_{r}")
        # rounded, so that equal hosts do not part by the last bit
        rate[r] = F.round((F.col(f"failed_{r}") + mean * s) / (F.col("docs") + s), 9)
        cut[r] = F.round(F.least(mean + outlier * F.sqrt(mean * (1 - mean) / (s + 1)), F.lit(max_rate)), 9)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (rate[r] > cut[r])
    return hosts.select("host", "docs", *[c for r in RULES for c in (
        F.col(f"failed_{r}"), rate[r].alias(f"rate_{r}"), cut[r].alias(f"cut_{r}"))], rejected.alias("rejected"))


def host_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
               max_rate: float = MAX_RATE, outlier: float = OUTLIER) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``."""
    host = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("host")
    counts = text_counts(docs.select("doc_id", host, "text"), ["doc_id", "host"])
    counts = stage(counts.withColumns({
        "fails_short": F.col("n_words") < min_words,
        "fails_repeats": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")}), "host-rules")
    rates = stage(host_rates(counts, max_rate, outlier), "host-rates")
    out = join_by_counts(counts, rates.select("host", "docs", "rejected"), "host", "docs")
    failed = F.col("fails_short") | F.col("fails_repeats")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))
