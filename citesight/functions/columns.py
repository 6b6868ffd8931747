"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def list_len(c) -> Column:
    """Element count; null for a null list (independent of legacy size settings)."""
    c = col(c)
    return F.when(c.isNotNull(), F.size(c))


def once(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once per row however often, or inside whatever lambda, the body
    uses it (a name bound by a lambda; a column of an earlier select is put back into the expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def r6(c) -> Column:
    """Round a float output to 6 places (both engines round half away from zero)."""
    return F.round(col(c).cast("double"), 6)


def with_scalars(df, one_row, cols=None):
    """Attach the columns of a one-row aggregate as scalar subqueries.

    Each is evaluated once (Spark merges them into one subquery) and inlined
    as a value: no join, nothing broadcast but the value itself.
    """
    cols = list(cols or one_row.columns)
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in cols])
