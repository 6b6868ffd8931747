"""Citation-neighbourhood operators (G1-G8): the core self-joins.

Plan shape of the neighbourhood table (G1-G5): the targets (citing works,
already cut to ``[t_start, t_end)``) explode their reference lists; the
edge list joins the neighbour table on the cited id (hot cited works are
salted, see ``plans.joins``). Ids, references, categories and sort keys are
staged once as a light corpus and read by every branch; feature vectors are
read for kept neighbours and final targets only. The category filter and the
priority are plain expressions; the per-target top-k is ``row_number <= k``,
which Catalyst turns into a partial ``WindowGroupLimit`` on both sides of
the shuffle, so no target carries more than k candidates per task across
the network; the k survivors are collected (bounded by k) and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesight.operators.metrics import assign_windows
from citesight.plans.joins import hot_from_counts, split_hot_join
from citesight.sources.io import stage_table

SUFFIX = "_referenced"


@dataclass(frozen=True)
class GraphSpec:
    id_col: str = "id"
    refs_col: str = "referenced_works"
    time_col: str = "publication_date"
    category_cols: Sequence[str] = ("topic_name", "subfield_name")
    sort_cols: Sequence[str] = ("score",)
    sort_descending: bool = False
    feature_col: str = "emb"            # neighbour feature (vector or token list)
    x_cols: Sequence[str] = ("emb",)
    y_cols: Sequence[str] = ("cited_by_count",)
    top_k: int = 15
    t_start: object = None
    t_end: object = None
    predicate: object = None
    max_len: int | None = None
    graph_max_len: int | None = None
    flatten_features: bool = False      # token lists: concatenate; vectors: keep a list of vectors
    required: Sequence[str] = field(default_factory=tuple)
    hot_count_col: str | None = "cited_by_count"  # in-degree column naming hot cited works, if present
    hot_min_rows: int = 10_000                     # a key is salted only above this many edges
    hot_partitions: int | None = None              # fair share = edges / partitions (session's by default)


def prepare_corpus(df: DataFrame, spec: GraphSpec) -> DataFrame:
    """Null drop on the used columns, caller predicate and ``t_end`` (both edge ends)."""
    used = list(dict.fromkeys([spec.id_col, spec.refs_col, spec.time_col, *spec.category_cols,
                               *spec.sort_cols, spec.feature_col, *spec.x_cols, *spec.y_cols,
                               *spec.required]))
    extra = [spec.hot_count_col] if spec.hot_count_col in df.columns and spec.hot_count_col not in used else []
    df = df.select(*used, *extra).dropna(how="any", subset=used)
    if spec.predicate is not None:
        df = df.where(F.expr(spec.predicate) if isinstance(spec.predicate, str) else spec.predicate)
    if spec.t_end is not None:
        df = df.where(F.col(spec.time_col) < F.lit(spec.t_end))
    return df


def citation_edges(corpus: DataFrame, spec: GraphSpec, targets: DataFrame | None = None,
                   extra_target_cols: Sequence[str] = (), with_features: bool = False) -> DataFrame:
    """G1: one row per (citing work, reference) whose both ends are in ``corpus``.

    Right-hand columns get the ``_referenced`` suffix; duplicate references are kept.
    Edges are light by default (ids, categories, sort keys): the neighbour
    feature is fetched only for the top-k survivors (``attach_features``).
    """
    t = corpus if targets is None else targets
    left = t.select(spec.id_col, *extra_target_cols, *spec.category_cols,
                    F.explode(spec.refs_col).alias("ref"))
    right = corpus.select(F.col(spec.id_col).alias("ref"),
                          *[F.col(c).alias(c + SUFFIX) for c in dict.fromkeys([*spec.category_cols,
                                                                               *spec.sort_cols,
                                                                               spec.time_col])],
                          *([F.col(spec.feature_col).alias("feature" + SUFFIX)] if with_features else []))
    # targets cut to a window have their own popular works: count them on their edges
    hot = in_degree_hot(corpus, spec) if targets is None else None
    return split_hot_join(left, right, "ref", hot=hot, partitions=spec.hot_partitions, min_rows=spec.hot_min_rows)


def in_degree_hot(corpus: DataFrame, spec: GraphSpec) -> DataFrame | None:
    """Hot cited works from the in-degree column, without counting edges; None without the column."""
    if not spec.hot_count_col or spec.hot_count_col not in corpus.columns:
        return None
    return hot_from_counts(corpus.select(F.col(spec.id_col).alias("ref"), spec.hot_count_col), "ref",
                           spec.hot_count_col, partitions=spec.hot_partitions, min_rows=spec.hot_min_rows)


def attach_features(ranked: DataFrame, corpus: DataFrame, spec: GraphSpec) -> DataFrame:
    """Late materialisation: the neighbour feature for the (at most k per target) kept edges.

    A neighbour kept by a large share of targets holds at most its in-degree
    of them; works with a hot in-degree are salted before their vector widens
    the rows.
    """
    if "feature" + SUFFIX in ranked.columns:
        return ranked
    feats = corpus.select(F.col(spec.id_col).alias("ref"), F.col(spec.feature_col).alias("feature" + SUFFIX))
    return split_hot_join(ranked, feats, "ref", hot=in_degree_hot(corpus, spec), partitions=spec.hot_partitions,
                          min_rows=spec.hot_min_rows)


def light_corpus(corpus: DataFrame, spec: GraphSpec) -> DataFrame:
    """The narrow columns of a prepared corpus, staged in the shared folder and read by every branch."""
    cols = dict.fromkeys([spec.id_col, spec.refs_col, spec.time_col, *spec.category_cols, *spec.sort_cols])
    extra = [spec.hot_count_col] if spec.hot_count_col in corpus.columns else []
    return stage_table(corpus.select(*dict.fromkeys([*cols, *extra])))


def category_match(edges: DataFrame, category_cols: Sequence[str]) -> DataFrame:
    """Keep an edge when any category is equal at both ends."""
    cond = F.lit(False)
    for c in category_cols:
        cond = cond | (F.col(c) == F.col(c + SUFFIX))
    return edges.where(cond)


def category_priority(category_cols: Sequence[str]) -> Column:
    """Index of the first category equal at both ends (list order = priority)."""
    return F.coalesce(*[F.when(F.col(c) == F.col(c + SUFFIX), F.lit(i)) for i, c in enumerate(category_cols)])


def _topk(edges: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _collect(ranked: DataFrame, group_cols: Sequence[str], flatten: bool) -> DataFrame:
    if "feature" + SUFFIX not in ranked.columns:
        ranked = ranked.withColumn("feature" + SUFFIX, F.lit(None))
    agg = ranked.groupBy(*group_cols).agg(F.array_sort(F.collect_list(
        F.struct("rank", "ref", F.col("feature" + SUFFIX).alias("f")))).alias("_nb"))
    feats = F.transform("_nb", lambda s: s["f"])
    return agg.select(*group_cols,
                      F.transform("_nb", lambda s: s["ref"]).alias("graph_ids"),
                      (F.flatten(feats) if flatten else feats).alias("graph_x"))


def topk_by_sort(edges: DataFrame, spec: GraphSpec, group_cols: Sequence[str] | None = None,
                 corpus: DataFrame | None = None) -> DataFrame:
    """Per citing work the ``top_k`` neighbours by the neighbour's sort columns
    (descending), then neighbour id; their features in that order (fetched from
    ``corpus`` for the survivors when the edges are light)."""
    g = list(group_cols or [spec.id_col])
    order = [F.col(c + SUFFIX).desc() for c in spec.sort_cols] + [F.col("ref").asc()]
    ranked = _topk(edges, g, order, spec.top_k)
    if corpus is not None:
        ranked = attach_features(ranked.select(*g, "rank", "ref"), corpus, spec)
    return _collect(ranked, g, spec.flatten_features)


def topk_by_category_priority(edges: DataFrame, spec: GraphSpec,
                              group_cols: Sequence[str] | None = None,
                              corpus: DataFrame | None = None) -> DataFrame:
    """rank = first matching category, then the neighbour's sort columns
    (ascending unless ``sort_descending``), then neighbour id; keep ``top_k``."""
    g = list(group_cols or [spec.id_col])
    pri = category_priority(spec.category_cols)
    sc = [F.col(c + SUFFIX).desc() if spec.sort_descending else F.col(c + SUFFIX).asc() for c in spec.sort_cols]
    ranked = _topk(edges.withColumn("priority", pri), g, [F.col("priority").asc(), *sc, F.col("ref").asc()],
                   spec.top_k)
    if corpus is not None:
        ranked = attach_features(ranked.select(*g, "rank", "ref"), corpus, spec)
    return _collect(ranked, g, spec.flatten_features)


def _concat(cols: Sequence[str], types: dict) -> Column:
    from pyspark.sql import types as T
    parts = [F.col(c) if isinstance(types[c], T.ArrayType) else F.array(F.col(c).cast("double")) for c in cols]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def neighbourhood_table(corpus: DataFrame, spec: GraphSpec, by_priority: bool = True,
                        targets: DataFrame | None = None) -> DataFrame:
    """``(id, x, graph_x, graph_ids, y)`` for targets in ``[t_start, t_end)`` with
    at least one neighbour; neighbours come from the whole corpus before ``t_end``."""
    c = prepare_corpus(corpus, spec)
    light = light_corpus(c, spec)

    def cut(df):
        # t_start only cuts targets; pushing it before the explode keeps history as neighbours
        return df if spec.t_start is None else df.where(F.col(spec.time_col) >= F.lit(spec.t_start))
    t = cut(c if targets is None else targets)
    own = None if targets is None and spec.t_start is None else cut(light if targets is None else targets)
    nb = _neighbours(c, light, spec, by_priority, own)
    return _rows(t.join(nb, spec.id_col, "inner"), c, spec, [spec.id_col, spec.time_col])


def _neighbours(c: DataFrame, light: DataFrame, spec: GraphSpec, by_priority: bool, targets: DataFrame | None,
                extra: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """Kept neighbours with their features, ranked on the light corpus."""
    edges = citation_edges(light, spec, targets, extra_target_cols=extra)
    edges = category_match(edges if keep is None else edges.where(keep), spec.category_cols)
    g = [spec.id_col, *[x for x in extra if x == "window_start"]]
    feats = c.select(spec.id_col, spec.feature_col, *([spec.hot_count_col] if spec.hot_count_col in c.columns else []))
    topk = topk_by_category_priority if by_priority else topk_by_sort
    return topk(edges, spec, g, corpus=feats)


def _rows(joined: DataFrame, c: DataFrame, spec: GraphSpec, keep: Sequence[str]) -> DataFrame:
    """The table's columns and its null and length limits."""
    types = {f.name: f.dataType for f in c.schema.fields}
    out = joined.select(*keep, _concat(spec.x_cols, types).alias("x"), "graph_x", "graph_ids",
                        _concat(spec.y_cols, types).alias("y"))
    out = out.dropna(how="any", subset=["graph_x", "x", "y"]).where(F.size("graph_x") >= 1)
    if spec.max_len is not None:
        out = out.where(F.size("x") <= spec.max_len)
    if spec.graph_max_len is not None:
        out = out.where(F.size("graph_x") <= spec.graph_max_len)
    return out


def observed_max_lengths(table: DataFrame) -> DataFrame:
    """Longest x and graph_x."""
    return table.agg(F.max(F.size("x")).alias("max_len"), F.max(F.size("graph_x")).alias("graph_max_len"))


def _merge_lists(lists: Column, k: int) -> Column:
    """The ``k`` best entries (s, ref) of some k-lists: largest ``s`` first, nulls last, then smallest ref."""
    def before(x, y):
        return (F.when(x["s"].isNull() & y["s"].isNull(), 0).when(x["s"].isNull(), 1).when(y["s"].isNull(), -1)
                .when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1).otherwise(0))

    def order(x, y):
        b = before(x, y)
        return F.when(b != 0, b).when(x["ref"] < y["ref"], -1).when(x["ref"] > y["ref"], 1).otherwise(0)
    return F.slice(F.array_sort(F.flatten(lists), order), 1, k)


def _running_lists(days: Column, k: int, kind: str) -> Column:
    """For each day of a block the k-list of all days up to it."""
    return F.aggregate(days, F.array().cast(f"array<{kind}>"), lambda acc, d: F.concat(acc, F.array(
        _merge_lists(F.filter(F.array(F.get(acc, F.size(acc) - 1), d["best"]), lambda x: x.isNotNull()), k))))


def rolling_lists(base: DataFrame, category_col: str, sort_col: str, id_col: str, top_k: int, period_days: int,
                  offset_days: int) -> DataFrame:
    """(category, _day, rank, ref): the ``top_k`` works of the category in ``(_day + offset, _day + offset + period]``.

    Day lists first: the top k of each (category, day), which loses nothing, as a window holds whole
    days. The calendar is cut into blocks of ``period`` days; a window is the end of one block and the
    beginning of the next (or one whole block). Each block folds its at most ``period`` day lists into
    a k-list up to every day and one from every day on, so a window merges two k-lists, whatever
    lies in it. Blocks and windows meet as one row per (category, block) each.
    """
    w = Window.partitionBy(category_col, "_day").orderBy(F.col(sort_col).desc_nulls_last(), F.col(id_col).asc())
    pruned = base.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k)
    entry = F.struct(F.col(sort_col).alias("s"), F.col(id_col).alias("ref"))
    days = pruned.groupBy(category_col, "_day").agg(F.collect_list(entry).alias("best"))  # k entries
    days = stage_table(days.withColumn("best", _merge_lists(F.array("best"), top_k)))
    kind = days.schema["best"].dataType.simpleString()

    def block(day: Column) -> Column:
        return F.floor(day / period_days)
    first, last = F.col("_day") + offset_days + 1, F.col("_day") + offset_days + period_days
    ends = F.struct(last.alias("at"), F.lit(True).alias("head"))
    asked = days.select(category_col, "_day", F.explode(F.when(block(first) == block(last), F.array(ends)).otherwise(
        F.array(ends, F.struct(first.alias("at"), F.lit(False).alias("head"))))).alias("q"))
    asked = asked.groupBy(category_col, block(F.col("q.at")).alias("_b")).agg(
        F.collect_list(F.struct("_day", "q.at", "q.head")).alias("asked"))
    held = days.groupBy(category_col, block(F.col("_day")).alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("_day", "best"))).alias("days"))
    held = held.select(category_col, "_b", F.transform("days", lambda d: d["_day"]).alias("at"),
                       _running_lists(F.col("days"), top_k, kind).alias("heads"),
                       F.reverse(_running_lists(F.reverse("days"), top_k, kind)).alias("tails"))

    def answer(q):
        # days up to the window's end, or days before its beginning
        n = F.size(F.filter("at", lambda d: F.when(q["head"], d <= q["at"]).otherwise(d < q["at"])))
        return F.struct(q["_day"].alias("_day"),
                        F.when(q["head"], F.get("heads", n - 1)).otherwise(F.get("tails", n)).alias("best"))
    got = asked.join(held, [category_col, "_b"]).select(
        category_col, F.explode(F.transform("asked", answer)).alias("a")).select(category_col, "a.*")
    got = got.where("best IS NOT NULL").groupBy(category_col, "_day").agg(F.collect_list("best").alias("lists"))
    got = got.select(category_col, "_day", F.posexplode(_merge_lists(F.col("lists"), top_k)).alias("rank", "e"))
    return got.select(category_col, "_day", (F.col("rank") + 1).alias("rank"), F.col("e.ref").alias("ref"))


def _rolling(corpus: DataFrame, category_col: str, time_col: str, sort_col: str, feature_col: str, top_k: int,
             period_days: int, offset_days: int | None, id_col: str, flatten: bool) -> tuple[DataFrame, DataFrame]:
    """(the works' keys with ``_day``, neighbours with features per (category, _day))."""
    day = F.datediff(F.col(time_col), F.lit("1970-01-01"))
    base = stage_table(corpus.select(id_col, category_col, time_col, sort_col).withColumn("_day", day)
                       .dropna(subset=[category_col, "_day"]))
    ranked = stage_table(rolling_lists(base, category_col, sort_col, id_col, top_k, period_days,
                                       -period_days if offset_days is None else offset_days))
    # features only for the kept k per (category, day), not for every candidate in the window
    feats = corpus.select(F.col(id_col).alias("ref"), F.col(feature_col).alias("feature" + SUFFIX))
    return base, _collect(split_hot_join(ranked, feats, "ref"), [category_col, "_day"], flatten)


def rolling_category_topk(corpus: DataFrame, category_col: str, time_col: str, sort_col: str,
                          feature_col: str, top_k: int, period_days: int, offset_days: int | None = None,
                          id_col: str = "id") -> DataFrame:
    """Per (category, date) the ``top_k`` works by ``sort_col`` (descending, then id)
    among works of that category dated in ``(t + offset, t + offset + period]`` (see ``rolling_lists``).

    The offset is ``-period`` by default and may have either sign. Works without category or date
    take no part."""
    base, nb = _rolling(corpus, category_col, time_col, sort_col, feature_col, top_k, period_days, offset_days, id_col, False)
    # many works share one (category, day): a crowded day is salted by the works' ids
    works = base.select(id_col, category_col, time_col, "_day")
    return split_hot_join(works, nb, [category_col, "_day"], hash_cols=[id_col]).select(
        id_col, category_col, time_col, "graph_ids", "graph_x")


def rolling_table(corpus: DataFrame, spec: GraphSpec, period_days: int, offset_days: int | None = None) -> DataFrame:
    """G6 as a training table: ``(id, date, x, graph_x, graph_ids, y)`` of works from ``t_start`` on.

    First category and sort column of ``spec``; nulls, predicate and ``t_end`` hold for works and
    neighbours, ``t_start`` and the length limits for the works alone. Works without a neighbour are
    left out."""
    c = prepare_corpus(corpus, spec)
    cat = spec.category_cols[0]
    _, nb = _rolling(c, cat, spec.time_col, spec.sort_cols[0], spec.feature_col, spec.top_k, period_days, offset_days,
                     spec.id_col, spec.flatten_features)
    own = c if spec.t_start is None else c.where(F.col(spec.time_col) >= F.lit(spec.t_start))
    own = own.withColumn("_day", F.datediff(F.col(spec.time_col), F.lit("1970-01-01")))
    return _rows(split_hot_join(own, nb, [cat, "_day"], hash_cols=[spec.id_col]), c, spec, [spec.id_col, spec.time_col])


def rewindow(corpus: DataFrame, spec: GraphSpec, start: str, end: str | None = None, every: int = 1,
             unit: str = "year", by_priority: bool = True) -> DataFrame:
    """G1-G5 for all windows ``[start + i * every unit, ...)`` up to ``end`` (by default the latest
    date plus one day) in one plan.

    A target's window follows from its date by arithmetic; an edge is kept only when the neighbour is
    older than that window's end. The length limits are those of G5.
    """
    c = prepare_corpus(corpus, spec)
    light = light_corpus(c, spec)
    tcol = spec.time_col
    extra = ["window_start", "window_end"]
    own = assign_windows(light, start, end, every, unit, tcol)
    nb = _neighbours(c, light, spec, by_priority, own, extra, F.col(tcol + SUFFIX) < F.col("window_end"))
    # the window follows from the work's date again: one join
    works = assign_windows(c, start, end, every, unit, tcol, dates=light)
    return _rows(nb.drop("window_start").join(works, spec.id_col), c, spec, [*extra, spec.id_col, tcol])
