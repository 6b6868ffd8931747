"""Trie of shared conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; its id is its smallest member
conversation and its depth, which names it uniquely. Nodes come from running
sums along each conversation: every turn adds two 64-bit hashes of its place
and its SHA-256, split into four 32-bit lanes, so equal prefixes have equal
sums. Within a group of equal sums all members must have the same last turn
(compared by SHA-256); with that true at every depth, by induction all
members share the whole prefix, and a collision ends the job instead of
giving a wrong node.

The rollup of a value over subtrees splits the forest at weighted centroids.
A node weighs as many as its members, so the weight of its whole subtree is
known from its group alone (turns that its members have from it on). In a
component the nodes with more than half of the weight form a path from the
top; the lowest of them is the centroid. The total of the centroid's side of
the component is added to every node on the way from the centroid to the top,
the centroid included; its children's subtrees and the rest above it are the
next components, each of at most half the weight. An ancestor and a
descendant are parted exactly once, by a centroid between them, so every node
receives each node below it once.

Components above ``bound`` are split by Spark jobs (one round per halving, at
most log2(weight / bound) of them, all components of a round at once): one
aggregate finds the centroids, joins on (conversation, depth) with the path
table find which nodes lie below and which on the way to the top. Components
within ``bound`` are worked through in tasks, many at a time, in numpy. There
are at most total weight / bound large components; they are broadcast only
after a count.

Hot keys: turns of a conversation longer than a fair share get their places
and running sums from range partitions plus offsets; joins on a key that many
rows share are salted. The ids that end in a node are sorted by range
partitions and joined to segments of bounded length; a node's digest streams
over its segments.

Cases: rows without a conv_id belong to no conversation; turns of equal
number are ordered by role and text, repeats stay as turns of their own; a
null role or text is empty; an empty table gives no rows, not even a root;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesight.functions.columns import with_scalars
from citesight.llm.common import BROADCAST_ROWS, join_by_counts, stage
from citesight.plans.joins import hot_keys, split_hot_join
from citesight.plans.rowindex import cumulative_sums, with_row_index
from citesight.session import ship_package, shuffle_partitions

LANES = ("a", "b", "c", "d")
LOW = (1 << 32) - 1
#: Heaviest component that a task decomposes by itself.
BOUND = 1 << 16
#: Most ids in one segment of a node's endings.
SEGMENT = 1 << 16
#: A conversation is never taken for a hot one below so many turns.
HOT_TURNS = 10_000


def _running(turns: DataFrame, order: list[str], sums: list[str], min_rows: int) -> DataFrame:
    """Running sums of ``sums`` in each conversation, by ``order``; names end in ``_cum``.

    Conversations of more than half a fair share of the turns (at most two per partition exist) are
    numbered by range partitions and summed in buckets, all others by a window.
    """
    hot = stage(hot_keys(turns, "conv_id", min_rows=min_rows), "trie-hot")
    w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = turns.join(F.broadcast(hot), "conv_id", "left_anti").select(
        "*", *[F.sum(c).over(w).alias(f"{c}_cum") for c in sums])
    if hot.isEmpty():
        return plain
    long = with_row_index(turns.join(F.broadcast(hot), "conv_id", "left_semi"), ["conv_id", *order], "_at")
    long = cumulative_sums(long, ["_at"], sums, ["conv_id"])
    return plain.unionByName(long.select(plain.columns))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered(conversations: DataFrame, min_rows: int = HOT_TURNS) -> DataFrame:
    """(conv_id, place from 1, digest, n_bytes) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"))
    return _running(rows, ["turn", "role", "text"], ["one"], min_rows).select(
        "conv_id", F.col("one_cum").alias("place"), _digest(F.col("role"), F.col("text")).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"))


def rebuild(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first one: (turns, conversations).

    Conversation c takes the first h turns of c - c % family, then its own after its first h;
    h = crc32(c) % heads. The second frame holds (conv_id, n_turns), also of those left without turns.
    """
    c, turns = F.col("conv_id"), stage(turns, "trie-places")
    lens = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = lens.select("conv_id", "n", (c - F.pmod(c, F.lit(family))).alias("base"),
                        (F.crc32(c.cast("string")) % heads).alias("h"))
    given = lens.select(c.alias("base"), F.col("n").alias("n_base"))
    convs = stage(convs.join(given, "base", "left").select(
        "conv_id", "base", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("taken"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"), "n"), "trie-convs")
    # at most heads - 1 turns of a base reach at most `family` conversations
    lent = turns.where(F.col("place") < heads).select(
        c.alias("base"), "place", "digest", "n_bytes").join(convs.where("h > 0"), "base").where(
        F.col("place") <= F.col("h")).select("conv_id", "place", "digest", "n_bytes")
    own = join_by_counts(turns, convs.select("conv_id", "h", "taken", "n"), "conv_id", "n", "inner").where(
        F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_bytes")
    return lent.unionByName(own), convs.select("conv_id", (F.col("taken") + F.col("kept")).alias("n_turns"))


def paths(turns: DataFrame, convs: DataFrame, min_rows: int = HOT_TURNS) -> tuple[DataFrame, DataFrame]:
    """(nodes without the root, path rows): the node at each place of each conversation."""
    one, two = F.xxhash64("place", "digest"), F.xxhash64(F.lit("second"), "digest", "place")
    lanes = [one.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(two, 32)]
    t = _running(turns.withColumns(dict(zip(LANES, lanes))), ["place"], list(LANES), min_rows)
    key = F.concat_ws("-", "place", *[f"{x}_cum" for x in LANES])
    t = join_by_counts(t.select("conv_id", "place", "digest", "n_bytes", F.unhex(F.sha2(key, 256)).alias("key")),
                       convs, "conv_id", "n_turns", "inner")
    t = stage(t, "trie-turns")
    rest = F.col("n_turns") - F.col("place")
    same = F.when(F.min("digest") == F.max("digest"), F.min("n_bytes")).otherwise(
        F.raise_error(F.lit("two prefixes with the same hash")).cast("long"))
    nodes = stage(t.groupBy("place", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), same.alias("n_bytes"),
        F.sum(rest + 1).alias("weight")), "trie-groups")
    names = nodes.select("key", F.col("conv_id").alias("rep"), "n_convs")
    steps = join_by_counts(t.select("conv_id", "place", "key", rest.alias("rest")), names, "key", "n_convs", "inner")
    return nodes, stage(steps.select("conv_id", "place", "rep", "rest"), "trie-paths")


def _endings(ends: DataFrame, segment: int) -> DataFrame:
    """(conv_id, depth, ends_sha256): digest of the ids that end in each node, ascending and comma-joined."""
    n = shuffle_partitions(ends.sparkSession)
    size = Window.partitionBy("depth", "conv_id", "part").orderBy("member")
    cut = ends.repartitionByRange(n, "depth", "conv_id", "member").withColumn("part", F.spark_partition_id())
    cut = stage(cut, "trie-ends")  # the part of a row must not change between readings
    runs = cut.withColumn("piece", F.floor((F.row_number().over(size) - 1) / segment)).groupBy(
        "depth", "conv_id", "part", "piece").agg(F.sort_array(F.collect_list("member")).alias("ids"))
    runs = stage(runs.select("depth", "conv_id", "part", "piece",
                             F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")), "trie-segments")
    many = runs.groupBy("depth", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))
    whole = many.where("n = 1").select("depth", "conv_id", F.sha2("ids", 256).alias("ends_sha256"))
    split = F.broadcast(many.where("n > 1").select("depth", "conv_id"))  # at most partitions + rows / segment

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if at != (row.depth, row.conv_id):
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (row.depth, row.conv_id), hashlib.sha256(row.ids.encode())
                else:
                    state.update(b"," + row.ids.encode())
            yield pd.DataFrame(done, columns=["depth", "conv_id", "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["depth", "conv_id", "ends_sha256"])

    streamed = (runs.join(split, ["depth", "conv_id"], "left_semi").repartition("depth", "conv_id")
                .sortWithinPartitions("depth", "conv_id", "part", "piece").drop("part", "piece")
                .mapInPandas(stream, "depth long, conv_id long, ends_sha256 string"))
    return whole.unionByName(streamed)


class Forest:
    """Trees of nodes in preorder: ``parent`` (-1 at a top) and ``size`` of each node's subtree."""

    def __init__(self, depth: np.ndarray, parent: np.ndarray) -> None:
        n = len(depth)
        level = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[level], prepend=-1, append=depth.max(initial=0) + 1))
        levels = [level[a:b] for a, b in zip(cuts, cuts[1:])]
        size = np.ones(n, np.int64)
        for v in reversed(levels):
            inner = v[parent[v] >= 0]
            np.add.at(size, parent[inner], size[inner])
        pre = np.zeros(n, np.int64)
        tops = np.flatnonzero(parent < 0)
        pre[tops] = np.cumsum(size[tops]) - size[tops]
        for v in levels:
            v = v[parent[v] >= 0]
            if len(v):
                v = v[np.argsort(parent[v], kind="stable")]
                before = np.cumsum(size[v]) - size[v]
                first = np.flatnonzero(np.diff(parent[v], prepend=-1))
                before -= np.repeat(before[first], np.diff(first, append=len(v)))
                pre[v] = pre[parent[v]] + 1 + before
        self.order = np.argsort(pre)  # row of each preorder position
        self.size = size[self.order]
        self.parent = np.where(parent[self.order] >= 0, pre[parent[self.order]], -1)


def decompose(forest: Forest, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (nodes x columns) over subtrees; ``weight``: of each node's subtree. All in preorder."""
    n = len(weight)
    weight, totals, at = weight.copy(), np.zeros_like(values), np.arange(n)
    comp = np.full(n, -1)
    comp[forest.parent < 0] = at[forest.parent < 0]
    comp = np.maximum.accumulate(comp)
    live = at
    while len(live):
        top = comp[live]
        heavy = live[2 * weight[live] > weight[top]]
        centroid = np.zeros(n, np.int64)
        centroid[comp[heavy]] = heavy  # in preorder: the lowest one is written last
        c = centroid[top]
        end = c + forest.size[c]
        below = (live >= c) & (live < end)
        side = np.zeros_like(values)
        np.add.at(side, top[below], values[live[below]])
        way = (live <= c) & (c < live + forest.size[live])
        totals[live[way]] += side[top[way]]
        above = way & (live != c)
        weight[live[above]] -= weight[c[above]]
        # the parts under the centroid are named by its children: rows by component, in preorder
        under = np.flatnonzero(below & (live != c))
        under = under[np.argsort(top[under], kind="stable")]
        rows = live[under]
        heads = np.where(forest.parent[rows] == c[under], np.arange(len(rows)), 0)
        comp[rows] = rows[np.maximum.accumulate(heads)] if len(rows) else rows
        live = live[live != c]
    return totals


def _locate(depth: np.ndarray, rep: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Row of the node (depth - 1, up) for each row, -1 where it is not among the rows (depth, rep)."""
    ids, code = np.unique(np.concatenate([rep, up]), return_inverse=True)
    own, want = depth * len(ids) + code[:len(rep)], (depth - 1) * len(ids) + code[len(rep):]
    order = np.argsort(own)
    at = np.minimum(np.searchsorted(own[order], want), len(own) - 1)
    return np.where(own[order[at]] == want, order[at], -1)


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roll up whole components, sorted by component: those of one batch at a time."""
    def solve(t: pd.DataFrame) -> pd.DataFrame:
        depth, rep, up = (t[c].to_numpy(np.int64) for c in ("depth", "conv_id", "up"))
        parent = _locate(depth, rep, up)
        tops = (depth == t["top_depth"].to_numpy()) & (rep == t["top"].to_numpy())
        parent = np.where(tops, -1, parent)
        f = Forest(depth, parent)
        t = t.iloc[f.order]
        done = decompose(f, t["weight"].to_numpy(np.int64), t[["leaf", "saved"]].to_numpy(np.int64))
        return pd.DataFrame({"depth": t["depth"], "conv_id": t["conv_id"],
                             "n_leaves": t["n_leaves"] + done[:, 0], "saved_tokens": t["saved_tokens"] + done[:, 1]})

    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            last = batch.iloc[-1]
            own = (batch["top"] == last["top"]) & (batch["top_depth"] == last["top_depth"])
            if not own.all() or (held and (held[-1].iloc[-1][["top", "top_depth"]] != last[["top", "top_depth"]]).any()):
                ready = [*held, batch[~own]]
                held = [batch[own]]
                yield solve(pd.concat(ready))
            else:
                held.append(batch)
    if held:
        yield solve(pd.concat(held))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def rollup(nodes: DataFrame, steps: DataFrame, bound: int = BOUND) -> DataFrame:
    """(depth, conv_id, n_leaves, saved_tokens): ``leaf`` and ``saved`` summed over subtrees.

    ``nodes`` (conv_id, depth, up, weight, leaf, saved): a tree by (depth - 1, up). ``steps`` (conv_id,
    place, rep, up): the node at each depth of each conversation and that node's parent.
    """
    top = ["top", "top_depth"]
    root = nodes.where("depth = 0")
    live = with_scalars(nodes, root.select(F.col("conv_id").alias("top"))).select(
        "*", F.lit(0).cast("long").alias("top_depth"), F.lit(0).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"))
    cols, ready, done = live.columns, [], []
    while True:
        heavy = stage(live.where((F.col("conv_id") == F.col("top")) & (F.col("depth") == F.col("top_depth"))
                                 & (F.col("weight") > bound)).select(*top, F.col("weight").alias("total")), "trie-large")
        n = heavy.count()  # at most total weight / bound components
        ready.append(live.join(_small(heavy, n), top, "left_anti"))
        if not n:
            break
        live = live.join(_small(heavy, n), top)
        half = live.where(F.col("weight") * 2 > F.col("total"))
        cents = stage(half.groupBy(*top).agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c")).select(
            *top, *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("conv_id", "depth", "weight")]), "trie-centroids")
        live = live.join(_small(cents, n), top)
        # the node at the centroid's next depth above each node, and its parent: is that the centroid?
        live = live.withColumns({"at": F.col("c_depth") + 1, "row": F.monotonically_increasing_id()})
        seen = steps.select("conv_id", F.col("place").alias("at"), F.col("rep").alias("child"), F.col("up").alias("child_up"))
        itself = (F.col("conv_id") == F.col("c_conv_id")) & (F.col("depth") == F.col("c_depth"))
        live = split_hot_join(live, seen, ["conv_id", "at"], "left", hash_cols=["conv_id", "depth"])
        under = F.coalesce((F.col("depth") > F.col("c_depth")) & (F.col("child_up") == F.col("c_conv_id")), F.lit(False))
        # the way from each centroid to the top of its component
        way = steps.select(F.col("conv_id").alias("c_conv_id"), F.col("place").alias("depth"), F.col("rep").alias("conv_id"))
        way = way.join(_small(cents, n), "c_conv_id").where(
            (F.col("depth") <= F.col("c_depth")) & (F.col("depth") >= F.col("top_depth")))
        way = way.select(*top, "depth", "conv_id", F.lit(True).alias("on_way"))
        roots = cents.where("top_depth = 0").select(*top, F.lit(0).cast("long").alias("depth"), F.col("top").alias("conv_id"),
                                                    F.lit(True).alias("on_way"))
        live = live.join(way.unionByName(roots), [*top, "depth", "conv_id"], "left")
        live = stage(live.select(*cols, "c_conv_id", "c_depth", "c_weight", "child", itself.alias("itself"),
                                 under.alias("under"), F.coalesce("on_way", F.lit(False)).alias("way")), "trie-round")
        sides = live.where("under OR itself").groupBy(*top).agg(F.sum("leaf").alias("s_leaf"), F.sum("saved").alias("s_saved"))
        live = live.join(_small(sides, n), top)
        live = stage(live.select(
            "conv_id", "depth", "up", F.when(F.col("way") & ~F.col("itself"), F.col("weight") - F.col("c_weight"))
            .otherwise(F.col("weight")).alias("weight"), "leaf", "saved",
            F.when(F.col("under"), F.col("child")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            *[(F.col(a) + F.when(F.col("way"), F.col(b)).otherwise(0)).alias(a)
              for a, b in (("n_leaves", "s_leaf"), ("saved_tokens", "s_saved"))], "itself"), "trie-split")
        done.append(live.where("itself").select("depth", "conv_id", "n_leaves", "saved_tokens"))
        live = live.where("NOT itself").select(cols)
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    out = out.repartition(*top).sortWithinPartitions(*top).mapInPandas(
        _local, "depth long, conv_id long, n_leaves long, saved_tokens long")
    for more in done:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame, bound: int = BOUND, segment: int = SEGMENT,
                min_rows: int = HOT_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with the counts of its subtree."""
    turns, convs = rebuild(ordered(conversations, min_rows))
    return trie(turns, convs, bound, segment, min_rows)


def trie(turns: DataFrame, convs: DataFrame, bound: int = BOUND, segment: int = SEGMENT,
         min_rows: int = HOT_TURNS) -> DataFrame:
    """The trie of (conv_id, place, digest, n_bytes) and (conv_id, n_turns), see ``prefix_trie``."""
    ship_package(convs.sparkSession)
    convs = stage(convs, "trie-lengths")
    groups, steps = paths(turns, convs, min_rows)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                     F.sum(F.col("n_turns") + 1).alias("weight")).where("n_convs > 0")
    least = root.select("conv_id").scalar()
    # the parent of the node that a conversation reaches at a place is the node it reaches one place before
    before = steps.select("conv_id", (F.col("place") + 1).alias("place"), F.col("rep").alias("up"))
    steps = stage(steps.join(before, ["conv_id", "place"], "left").select(
        "conv_id", "place", "rep", F.when(F.col("place") == 1, least).otherwise(F.col("up")).alias("up"), "rest"), "trie-steps")
    ups = steps.where(F.col("conv_id") == F.col("rep")).select("conv_id", "place", "up")
    nodes = groups.join(ups, ["conv_id", "place"]).select(
        "conv_id", F.col("place").alias("depth"), "up", "n_convs", "n_bytes", "weight").unionByName(
        root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("up"), "n_convs", zero.alias("n_bytes"), "weight"))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(kids, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")
    sums = rollup(nodes.select("conv_id", "depth", F.coalesce("up", F.lit(-1)).alias("up"), "weight",
                               F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
                               ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), steps, bound)
    ends = steps.where("rest = 0").select(F.col("place").alias("depth"), F.col("rep").alias("conv_id"), F.col("conv_id").alias("member"))
    ends = ends.unionByName(convs.where("n_turns = 0").select(zero.alias("depth"), least.alias("conv_id"), F.col("conv_id").alias("member")))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, ["depth", "conv_id"]).join(_endings(ends, segment), ["depth", "conv_id"], "left")
            .select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
