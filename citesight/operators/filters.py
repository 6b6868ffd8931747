"""Filters and projections (P1-P10). All are narrow: no shuffle, pushed to the scan where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesight.functions.columns import list_len


def time_window(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Half-open ``[start, end)``; either side optional."""
    c = F.col(col)
    if start is not None:
        df = df.where(c >= F.lit(start))
    if end is not None:
        df = df.where(c < F.lit(end))
    return df


def membership_filter(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """Keep rows whose ``col`` is in ``values``; an empty list keeps all."""
    if not values:
        return df
    return df.where(F.col(col).isin(list(values)))


def licence_filter(df: DataFrame, col: str = "is_license_safe") -> DataFrame:
    """Keep rows whose licence flag is true (null drops)."""
    return df.where(F.col(col))


def null_by_licence(df: DataFrame, cols: Sequence[str], licence_col: str = "is_license_safe") -> DataFrame:
    """Set ``cols`` to null where the licence flag is false (null flag keeps the value)."""
    lic = F.col(licence_col)
    return df.withColumns({c: F.when(lic == F.lit(False), F.lit(None)).otherwise(F.col(c)) for c in cols})


def drop_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: drop rows with a null in any listed column."""
    return df.dropna(how="any", subset=list(cols))


def user_predicate(df: DataFrame, predicate: Column | str | None) -> DataFrame:
    """Caller predicate, a Column or a SQL expression string."""
    if predicate is None:
        return df
    return df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)


def cited_and_referencing(df: DataFrame, min_cited: int = 1, min_refs: int = 5,
                          cited_col: str = "cited_by_count", refs_col: str = "referenced_works") -> DataFrame:
    """``cited_by_count >= min_cited AND len(referenced_works) >= min_refs``."""
    return df.where((F.col(cited_col) >= min_cited) & (list_len(refs_col) >= min_refs))


def total_length(cols: Sequence[str]) -> Column:
    """Summed element count; a null list counts 0 (whatever the legacy ``size(null)`` setting)."""
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(list_len(c), F.lit(0))
    return out


def max_total_length(df: DataFrame, cols: Sequence[str], max_len: int) -> DataFrame:
    """Drop rows whose summed list length over ``cols`` exceeds ``max_len``."""
    return df.where(total_length(cols) <= max_len)


def concat_lists(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Concatenate list columns in order; scalars become one-element lists."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.col(c) if isinstance(types[c], T.ArrayType) else F.array(F.col(c)) for c in cols]
    elem = None
    for c in cols:
        t = types[c].elementType if isinstance(types[c], T.ArrayType) else types[c]
        elem = t if elem is None else elem
    parts = [F.transform(p, lambda x: x.cast(elem)) for p in parts]
    return df.withColumn(out, F.concat(*parts))


def length_feature(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: ``{col}_len``: characters for text, elements for lists, TypeError otherwise."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for c in cols:
        t = types[c]
        if isinstance(t, T.StringType):
            new[f"{c}_len"] = F.length(c)
        elif isinstance(t, T.ArrayType):
            new[f"{c}_len"] = list_len(c)
        else:
            raise TypeError(f"Len operation not supported for {t.simpleString()}")
    return df.withColumns(new)
