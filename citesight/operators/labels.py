"""Labels, class weights, padding, masks and span splits (L1-L10): row-wise column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from citesight.functions.columns import col


def label_nonzero(y) -> Column:
    """L1: 0 if y = 0 else 1."""
    return F.when(col(y) == 0, F.lit(0)).otherwise(F.lit(1))


def label_threshold(y, theta: float = 15) -> Column:
    """L2: 1 if y > theta (strict) else 0."""
    return (col(y) > F.lit(theta)).cast("int")


def label_log(y) -> Column:
    """L3: ln(y + 1)."""
    return F.log1p(col(y).cast("double"))


def label_ordinal(y, boundaries: Sequence[float]) -> Column:
    """L4: bucket index, a boundary value goes up: number of boundaries <= y."""
    b = F.array(*[F.lit(v) for v in boundaries])
    return F.size(F.filter(b, lambda v: v <= col(y)))


def class_weight(y, weights: Sequence[float]) -> Column:
    """Weight of class index ``y`` (null when out of range)."""
    return F.get(F.array(*[F.lit(float(w)) for w in weights]), col(y).cast("int"))


def pad_truncate(x, max_len: int, pad=0) -> Column:
    """Right-pad with ``pad`` to ``max_len`` and cut to ``max_len``."""
    x = col(x)
    return F.slice(F.concat(x, F.array_repeat(F.lit(pad).cast("long"), max_len)), 1, max_len)


def pad_mask(x, pad=0) -> Column:
    """True where the element is not the pad value."""
    return F.transform(col(x), lambda v: v != F.lit(pad))


def neighbour_pad_mask(graph_x, top_k: int, graph_max_len: int, dim: int) -> tuple[Column, Column]:
    """Pad the neighbour list with zero vectors to ``top_k``, cut to
    ``graph_max_len``; mask 1 for real neighbours (``min(n, top_k)``)."""
    g = col(graph_x)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    padded = F.concat(F.transform(g, lambda v: F.transform(v, lambda e: e.cast("float"))),
                      F.array_repeat(zero, top_k))
    width = max(top_k, 1)
    cut = F.slice(padded, 1, F.greatest(F.size(g), F.lit(top_k)))
    cut = F.slice(cut, 1, graph_max_len)
    n_real = F.least(F.size(g), F.lit(top_k))
    mask = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i < n_real).cast("int"))
    return cut, mask


def span_offset(id_col, length: Column, n_forward: int, seed: int = 0) -> Column:
    """Deterministic offset in ``[0, max(len - n_forward - 1, 0)]`` (arithmetic, repeatable in SQL)."""
    upper = F.greatest(length - n_forward - 1, F.lit(0))
    return F.pmod(col(id_col) * 7919 + seed, upper + 1)


def span_split_forward(x, id_col, max_len: int, n_forward: int, seed: int = 0, pad=0) -> tuple[Column, Column]:
    """x = tokens ``[max(off - max_len, 0), off)``; y = the same span shifted by
    ``n_forward``; both right-padded to ``max_len``."""
    x = col(x)
    off = span_offset(id_col, F.size(x), n_forward, seed)
    start = F.greatest(off - max_len, F.lit(0))
    xs = F.slice(x, start + 1, off - start)
    ys = F.slice(x, start + 1 + n_forward, F.greatest(F.least(off + n_forward, F.size(x)) - start - n_forward,
                                                      F.lit(0)))
    return pad_truncate_keep(xs, max_len, pad), pad_truncate_keep(ys, max_len, pad)


def span_split_both(x, id_col, max_len: int, n_forward: int, n_backward: int, seed: int = 0,
                    pad=0) -> tuple[Column, Column]:
    """X as L9 but left-padded; y = ``[off - n_backward, off + n_forward)``
    (start clamped at 0), right-padded to ``n_forward + n_backward``."""
    x = col(x)
    off = span_offset(id_col, F.size(x), n_forward, seed)
    start = F.greatest(off - max_len, F.lit(0))
    xs = F.slice(x, start + 1, off - start)
    ystart = F.greatest(off - n_backward, F.lit(0))
    ys = F.slice(x, ystart + 1, F.greatest(F.least(off + n_forward, F.size(x)) - ystart, F.lit(0)))
    xpad = F.concat(F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(max_len) - F.size(xs), F.lit(0))), xs)
    return xpad, pad_truncate_keep(ys, n_forward + n_backward, pad)


def pad_truncate_keep(x: Column, n: int, pad=0) -> Column:
    """Right-pad to ``n`` when shorter; never cut."""
    return F.concat(x, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(n) - F.size(x), F.lit(0))))
