"""Composed jobs: the operators in the order a user runs them, each as one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesight.operators import clean as C
from citesight.operators import filters as P
from citesight.operators import labels as L
from citesight.operators import metrics as E
from citesight.operators import model as M
from citesight.operators import neighbours as G
from citesight.operators import tokens as K
from citesight.operators.losses import hetero_mae
from citesight.plans.joins import null_safe_join
from citesight.sources.io import ordered_chunks, stage_table


@dataclass(frozen=True)
class PreprocessSpec:
    """What a preprocess run keeps, cleans and adds."""
    id_col: str
    time_col: str
    text_col: str
    clean: Sequence[C.CleanSpec]
    start: object = None
    end: object = None
    members: tuple[tuple[str, tuple], ...] = ()
    licensed_only: bool = False
    null_unlicensed: Sequence[str] = ()
    phrases: Sequence[str] = tuple(C.BOILERPLATE_PHRASES)
    embed_dim: int | None = None
    chunks: int = 1


def preprocess(df: DataFrame, spec: PreprocessSpec) -> DataFrame:
    """Filters (licence, dates, members), licence nulling, cleaning, null drop, tokens of the whole
    vocabulary, optional vectors, and ordered chunks. The cleaned rows are staged once: vocabulary,
    tokens and chunks read them, not the cleaning."""
    if spec.licensed_only:
        df = P.licence_filter(df)
    df = P.time_window(df, spec.time_col, spec.start, spec.end)
    for col, values in spec.members:
        df = P.membership_filter(df, col, values)
    if spec.null_unlicensed:
        df = P.null_by_licence(df, spec.null_unlicensed)
    df = C.clean_text(df, spec.clean, phrases=spec.phrases)
    df = stage_table(P.drop_nulls(df, [s.col for s in spec.clean]))
    df = K.tokenise(df, spec.id_col, spec.text_col, K.build_vocab(df, spec.text_col))
    if spec.embed_dim:
        df = K.embed_batch(df, spec.text_col, dim=spec.embed_dim)
    return ordered_chunks(df, [spec.time_col, spec.id_col], spec.chunks)


def text_token_table(df: DataFrame, id_col: str, token_cols: Sequence[str], y_col: str, max_len: int, theta: float,
                     weights: Sequence[float], time_col: str | None = None, start=None, end=None,
                     predicate: str | None = None) -> DataFrame:
    """Training rows (id, x, mask, label, weight) of token lists: nulls dropped, predicate, window,
    lists joined, rows above ``max_len`` dropped, the rest padded and masked."""
    df = P.user_predicate(P.drop_nulls(df, [*token_cols, y_col]), predicate)
    if time_col is not None:
        df = P.time_window(df, time_col, start, end)
    df = P.concat_lists(P.max_total_length(df, token_cols, max_len), list(token_cols), "_x")
    label = L.label_threshold(y_col, theta)
    x = F.transform("_x", lambda v: v.cast("long"))
    real = F.size("_x")
    return df.select(id_col, L.pad_truncate(x, max_len).alias("x"),
                     F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= real).cast("int")).alias("mask"),
                     label.alias("label"), L.class_weight(label, weights).alias("weight"))


def formatted_vectors(table: DataFrame, top_k: int, dim: int, theta: float, weights: Sequence[float],
                      id_col: str = "id") -> DataFrame:
    """(id, x, graph_x, graph_x_mask, y, weight) of a neighbourhood table with vector features."""
    # renamed first: inside a lambda a name means the new column of the same select
    table = table.withColumnRenamed("graph_x", "_graph")
    graph_x, mask = L.neighbour_pad_mask("_graph", top_k, top_k, dim)
    label = L.label_threshold(F.col("y")[0], theta)
    return table.select(id_col, "x", graph_x.alias("graph_x"), mask.alias("graph_x_mask"), label.alias("y"),
                        L.class_weight(label, weights).alias("weight"))


def formatted_tokens(table: DataFrame, max_len: int, graph_max_len: int, theta: float, weights: Sequence[float],
                     id_col: str = "id") -> DataFrame:
    """(id, x, mask, graph_x, graph_x_mask, y, weight) of a neighbourhood table with token lists."""
    def padded(c, n):
        longs = F.transform(c, lambda v: v.cast("long"))
        mask = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= F.size(c)).cast("int"))
        return L.pad_truncate(longs, n), mask
    # renamed first: inside a lambda a name means the new column of the same select
    table = table.withColumnsRenamed({"x": "_own", "graph_x": "_graph"})
    x, mask = padded("_own", max_len)
    graph_x, graph_mask = padded("_graph", graph_max_len)
    label = L.label_threshold(F.col("y")[0], theta)
    return table.select(id_col, x.alias("x"), mask.alias("mask"), graph_x.alias("graph_x"),
                        graph_mask.alias("graph_x_mask"), label.alias("y"), L.class_weight(label, weights).alias("weight"))


# ----------------------------------------------------------------- reports per kind of predictions
def _joined(parts: Sequence[DataFrame], g: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = null_safe_join(out, p, g, "left")
    return out


def _guarded(df: DataFrame, g: list[str], cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """E1 once for a whole report: the rows in which ``cols`` hold numbers, and per group how many did
    (``examples``) and did not (``nan_rows``)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & E._present(df, c)
    counts = df.groupBy(*g).agg(F.count_if(ok).alias("examples"), F.count_if(~ok).alias("nan_rows"))
    return df.where(ok), counts


def regression_report(df: DataFrame, group_cols: Sequence[str], y="y", p="pred") -> DataFrame:
    """Per group: examples, MAE, WAPE; rows with a NaN or null on either side are left out and counted."""
    g = list(group_cols)
    df, counts = _guarded(df, g, [y, p])
    return _joined([counts, E.mae(df, y, p, g), E.wape(df, y, p, g)], g)


def heteroscedastic_report(df: DataFrame, group_cols: Sequence[str], y="y", p="pred", sigma="sigma") -> DataFrame:
    """The regression report with mean sigma, 3-sigma capture and the sigma-scaled error."""
    g = list(group_cols)
    df, counts = _guarded(df, g, [y, p, sigma])
    return _joined([counts, regression_report(df, g, y, p).drop("examples", "nan_rows"), E.sigma_capture(df, y, p, sigma, g), hetero_mae(df, y, p, sigma, g)], g)


def classification_report(df: DataFrame, group_cols: Sequence[str], y="y", probs="probs") -> DataFrame:
    """Per group: examples, one-hot MAE, accuracies, weighted and macro F1, precision and recall,
    one-versus-one AUC and average precision."""
    g = list(group_cols)
    df, counts = _guarded(df, g, [y, probs])
    df = df.withColumn("pred", E.argmax_class(probs))
    return _joined([counts, E.one_hot_mae(df, probs, y, g),
                    E.multiclass_summary(df, y, "pred", g), E.roc_auc_ovo(df, probs, y, g),
                    E.ap_multiclass(df, probs, y, g)[1]], g)


def ordinal_report(df: DataFrame, group_cols: Sequence[str], n_classes: int, y="y", probs="probs") -> DataFrame:
    """The classification report with distribution distances to the true class and the entropy."""
    g = list(group_cols)
    t = _guarded(df, g, [y, probs])[0].withColumn("_target", E.one_hot(y, n_classes))
    return _joined([classification_report(df, g, y, probs), E.wasserstein(t, probs, "_target", g),
                    E.energy_distance(t, probs, "_target", g), E.norm_entropy(t, probs, g)], g)


def sliding_report(df: DataFrame, report: Callable[..., DataFrame], start: str, end: str | None = None, every: int = 1,
                   unit: str = "year", date_col: str = "d", **columns) -> DataFrame:
    """E29 for the trackers of classes, ordinal classes and numbers: one of the reports above per window
    ``[start + i * every unit, ...)``, all windows in one plan. ``columns`` go to the report."""
    return report(E.assign_windows(df, start, end, every, unit, date_col), ["window_start"], **columns)


def windowed_evaluation(corpus: DataFrame, spec: G.GraphSpec, model, start: str, end: str | None = None, every: int = 1,
                        unit: str = "year", theta: float = 2) -> DataFrame:
    """Neighbourhoods of every window (G8), scored by one model (M2), evaluated per window."""
    table = G.rewindow(corpus, spec, start, end, every, unit)
    table = table.withColumn("label", L.label_threshold(F.col("y")[0], theta).cast("double"))
    # scored once, read by each metric
    scored = stage_table(M.score_batch(model, table, keep=(spec.id_col, spec.time_col, "label")))
    return E.sliding_eval(scored, start, end, every, unit, spec.time_col, "label", "prob")
