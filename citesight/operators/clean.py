"""Text cleaning.

Phrase and marker checks are literal tests on the JVM (see ``contains_any``).
Length statistics are one global aggregate joined back as a one-row
broadcast; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the studied pipeline's lists, in its order) ---
# Boilerplate phrases: a text containing any of them is nulled.
BOILERPLATE_PHRASES = [
    "keywords:", "keywords:query=", "http", "abstract", "abstract advertisement return to issue",
    "paper accepted for publicationarticle views", "altimetric-citations", "copyright", "copyright",
    "©reference to this paper", "google scholar", "an abstract is not available for this content",
    "published by", "preview is available", "uses cookies to", "log in", "log in or register",
    "enter your email",
]
# Foreign-language markers: a text containing any of them marks the row's language 'unknown'.
FOREIGN_MARKERS = [
    "de ",
    "的", "了", "在", "是", "和", "与", "及", "或", "为", "被", "有", "无", "以", "对", "对于", "根据", "按", "由",
    "因此", "而且", "然而", "但", "但是", "同时", "并", "并且", "此外", "另外", "进一步", "总之", "综上", "可见",
    "表明", "显示", "证明", "说明", "指出", "认为", "发现", "提出", "方法", "研究", "分析", "讨论", "介绍",
    "的", "了", "是", "在", "和", "与", "对", "有", "无", "以", "为", "被", "等",
    "à", "á", "â", "ã", "ä", "å", "æ", "è", "é", "ê", "ë", "ì", "í", "î", "ï", "ò", "ó", "ô", "õ", "ö", "ø",
    "œ", "ù", "ú", "û", "ü", "ý", "ÿ",
    "À", "Á", "Â", "Ã", "Ä", "Å", "Æ", "È", "É", "Ê", "Ë", "Ì", "Í", "Î", "Ï", "Ò", "Ó", "Ô", "Õ", "Ö", "Ø",
    "Œ", "Ù", "Ú", "Û", "Ü", "Ý",
    "ç", "Ç", "ñ", "Ñ", "ð", "Ð", "þ", "Þ", "ß",
]
# --- end of fixed values ---


def contains_any(col: Column | str, needles: Sequence[str]) -> Column:
    """True when ``col`` contains any needle literally (case-sensitive).

    A needle that holds another one adds nothing and is left out. Single characters are one character
    class, looked up in one pass over the text; needles beyond ASCII are not looked for in texts that
    are all ASCII, which their byte count tells. The rest are byte-level ``contains`` checks (inside
    whole-stage codegen; one regex alternation is five times slower, as the JVM's engine tries its
    branches one by one at every position).
    """
    c = F.col(col) if isinstance(col, str) else col
    uniq = list(dict.fromkeys(needles))
    if "" in uniq:
        return c.isNotNull()
    least = [n for n in uniq if not any(m != n and m in n for m in uniq)]

    def any_of(some: Sequence[str]) -> Column:
        cond = F.lit(False)
        for n in (n for n in some if len(n) > 1):
            cond = cond | c.contains(n)
        singles = [n for n in some if len(n) == 1]
        if len(singles) > 2:
            return cond | c.rlike("[" + "".join(f"\\x{{{ord(n):x}}}" for n in singles) + "]")
        for n in singles:
            cond = cond | c.contains(n)
        return cond
    ascii_only = [n for n in least if n.isascii()]
    wide = [n for n in least if not n.isascii()]
    found = any_of(ascii_only)
    return found | ((F.octet_length(c) != F.char_length(c)) & any_of(wide)) if wide else found


def lowercase(df: DataFrame, col: str) -> DataFrame:
    """C1."""
    return df.withColumn(col, F.lower(col))


def null_boilerplate(df: DataFrame, col: str, phrases: Sequence[str] = BOILERPLATE_PHRASES) -> DataFrame:
    """Null the text when it contains any phrase."""
    return df.withColumn(col, F.when(contains_any(col, phrases), F.lit(None)).otherwise(F.col(col)))


def mark_foreign(df: DataFrame, col: str, markers: Sequence[str] = FOREIGN_MARKERS,
                 language_col: str = "language") -> DataFrame:
    """Set ``language`` to 'unknown' when the text contains any marker."""
    return df.withColumn(language_col, F.when(contains_any(col, markers), F.lit("unknown"))
                         .otherwise(F.col(language_col)))


def length_outliers(df: DataFrame, col: str, min_len: int, upper: bool = False) -> DataFrame:
    """C4: null texts shorter than ``max(mean - 3 std, min_len)`` (and, with
    ``upper``, longer than ``mean + 3 std``); sample std over non-null lengths."""
    return _bounded(df, [(col, min_len, upper)])


def _bounded(df: DataFrame, limits: Sequence[tuple[str, int, bool]]) -> DataFrame:
    """C4 for several columns: the bounds of all of them are one aggregate over the rows."""
    if not limits:
        return df
    stats = df.agg(*[f(F.length(c)).alias(f"_{n}{i}") for i, (c, _, _) in enumerate(limits)
                     for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    stats = stats.select(*[e for i, (_, least, _) in enumerate(limits) for e in (
        F.greatest(F.col(f"_mean{i}") - F.col(f"_std{i}") * 3, F.lit(float(least))).alias(f"_low{i}"),
        (F.col(f"_mean{i}") + F.col(f"_std{i}") * 3).alias(f"_high{i}"))])
    # a one-row broadcast, deliberately a join: as a scalar subquery the bounds would be inlined
    # and the level-5 filter pushed below the cleaning, evaluating the phrase checks twice per row
    j = df.join(F.broadcast(stats), how="inner")
    for i, (c, _, upper) in enumerate(limits):
        bad = F.length(c) < F.col(f"_low{i}")
        if upper:
            bad = bad | (F.length(c) > F.col(f"_high{i}"))
        j = j.withColumn(c, F.when(bad, F.lit(None)).otherwise(F.col(c)))
    return j.drop(*stats.columns)


def require_full_stop(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose text ends with '.' (null drops)."""
    return df.where(F.col(col).endswith("."))


@dataclass(frozen=True)
class CleanSpec:
    col: str
    level: int = 1
    min_len: int = 0


def _matched(df: DataFrame, s: CleanSpec, phrases: Sequence[str], markers: Sequence[str], language_col: str) -> DataFrame:
    """Levels 1 and 2 of one column."""
    if s.level > 1:
        df = lowercase(df, s.col)
    return mark_foreign(null_boilerplate(df, s.col, phrases), s.col, markers, language_col)


def clean_text(df: DataFrame, specs: Sequence[CleanSpec], phrases: Sequence[str] = BOILERPLATE_PHRASES,
               markers: Sequence[str] = FOREIGN_MARKERS, language_col: str = "language") -> DataFrame:
    """Several columns, each with its own level (1-5) and minimum length, in their order.

    The length bounds of a column are those of the rows that the columns before it have kept. Only
    level 5 drops rows, so all columns up to the next one of level 5 share one pass for their bounds.
    """
    batch: list[CleanSpec] = []
    for i, s in enumerate(specs):
        df = _matched(df, s, phrases, markers, language_col)
        batch.append(s)
        if s.level > 4 or i == len(specs) - 1:
            df = _bounded(df, [(b.col, b.min_len, b.level > 3) for b in batch if b.level > 2])
            batch = []
        if s.level > 4:
            df = require_full_stop(df, s.col)
    return df


def clean_column(df: DataFrame, col: str, min_len: int = 0, level: int = 1, **kw) -> DataFrame:
    """One column through levels 1-5."""
    return clean_text(df, [CleanSpec(col, level, min_len)], **kw)


def drop_report(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, rows and non-null values before and after cleaning."""
    def counts(d, stage):
        return d.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.count(F.col(c)).alias(c) for c in cols]).withColumn("stage", F.lit(stage))
    b, a = counts(before, "before"), counts(after, "after")
    stack = "stack({}, {}) as (column, values)".format(
        len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    b = b.selectExpr("rows as rows_before", stack).withColumnRenamed("values", "values_before")
    a = a.selectExpr("rows as rows_after", stack).withColumnRenamed("values", "values_after")
    return (b.join(a, "column")
            .select("column", "rows_before", "rows_after",
                    (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
                    "values_before", "values_after",
                    (F.col("values_before") - F.col("values_after")).alias("values_removed")))
