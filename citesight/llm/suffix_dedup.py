"""Exact removal of repeated byte strings by a hash-compared sort of anchored suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere, in
any text, is removed. Sorting the suffixes at all positions of a corpus would
move it many times over, so only anchored suffixes are sorted:

1. Each string of LENGTH bytes is anchored at the smallest 8-byte hash among
   its first ``SPREAD`` positions. Equal strings are anchored at equal places,
   and about two positions in SPREAD are anchors. An anchor serves a run of
   string starts; its context is the bytes of all of them.
2. Anchors are counted by the hash of the ``LENGTH - SPREAD + 1`` bytes that
   all their strings hold. Counts of one end the matter. Where all contexts of
   a hash are equal, every string of every context is repeated. Only where
   they differ are bytes needed, once for each distinct context.
3. Differing contexts meet by that hash. In batches of whole groups their
   suffixes (from the anchor on) are sorted by merging runs; two suffixes are
   compared through their longest common extension, found by binary search
   over prefix polynomial hashes. Common extensions of neighbours to the right
   of the anchor, and hashes of the bytes to its left, say for each offset
   which contexts hold the same string. Each such string is compared byte by
   byte with the first of its class, so no collision in this step removes
   anything.
4. The repeated runs return to the anchors, are joined per text and cut out.

A hash with more than ``HOT_CONTEXTS`` distinct contexts is not gathered in
one task: its strings are spread, one row per offset, and counted with
map-side combine. Joins on anchor hashes and contexts salt hot keys by their
counts. Texts are handled in blocks, so memory does not grow with their
length beyond the text itself.

Only step 3 compares bytes. That two contexts are equal as a whole (step 2, all
exact copies) rests on two independent 64-bit hashes, of the anchor's bytes and
of the context, and the spread strings of hot hashes on a 128-bit digest.

Cases: null texts are empty; texts shorter than LENGTH lose nothing; repeated
rows lose all strings of LENGTH bytes; matches never cross texts and are
judged on the input; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesight.llm.common import join_by_counts, stage, with_rid
from citesight.llm.hashing import POWERS, bounded, mix, slice_hashes

LENGTH, SPREAD, GRAM = 200, 137, 8
SHARED = LENGTH - SPREAD + 1
HOT_CONTEXTS = 16_384
#: String starts of a long text that are anchored at a time; contexts sorted at a time.
BLOCK, BATCH = 1 << 20, 4_096
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 32) - 1)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): anchors of one block and the string starts that each serves."""
    grams = mix(np.ndarray((len(data) - GRAM + 1,), "<u8", data.tobytes(), strides=(1,)))
    at = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams & ~_PLACE) | at, SPREAD)[:len(data) - LENGTH + 1]
    place = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.append(first[1:], len(place)) - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, place, back, reach, key, context): back and reach are the largest and smallest offset of
    the anchor in its strings."""
    names = ["rid", "place", "back", "reach", "key", "context"]

    def table(held):
        cols = [np.concatenate(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    for batch in bounded(batches):
        held, rows = [], 0
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode()
            for at in range(0, len(raw) - LENGTH + 1, BLOCK):
                data = np.frombuffer(raw[at:at + BLOCK + LENGTH - 1], np.uint8)
                place, first, last = anchors(data)
                codes = _CODE[data]
                key = slice_hashes(codes, place, place + SHARED)
                whole = slice_hashes(codes, first, last + LENGTH)
                back, reach = place - first, place - last
                context = mix(whole + (back * (SPREAD + 1) + reach).astype(np.uint64))
                held.append((np.full(len(place), rid), place + at, back, reach, key.view(np.int64), context.view(np.int64)))
                rows += len(place)
                if rows >= 1 << 16:
                    yield table(held)
                    held, rows = [], 0
        if held:
            yield table(held)


class Suffixes:
    """Anchored suffixes in one buffer, compared through prefix polynomial hashes."""

    def __init__(self, contexts: list[bytes], back: np.ndarray) -> None:
        sizes = np.array([len(c) for c in contexts], np.int64)
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        start = np.cumsum(sizes) - sizes
        self.at, self.size = start + back, sizes - back
        POWERS.grow(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_CODE[self.data] * POWERS.up[:len(self.data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * POWERS.down[start]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes i and j, by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.at[i], self.at[j]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes(a, mid) == self.hashes(b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Suffix i before suffix j; equal ones by number."""
        n = self.common(i, j)
        end_i, end_j = n == self.size[i], n == self.size[j]
        last = len(self.data) - 1
        a, b = self.data[np.minimum(self.at[i] + n, last)], self.data[np.minimum(self.at[j] + n, last)]
        return np.where(end_i | end_j, end_i & (~end_j | (i < j)), a < b)

    def order(self) -> np.ndarray:
        """Mergesort: the place of an element in a merged run is its own plus its rank in the sibling run."""
        n = len(self.at)
        out, width = np.arange(n), 1
        while width < n:
            spot = np.arange(n)
            begin = spot // width * width
            other = np.where(begin // width % 2 == 0, begin + width, begin - width)
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            base = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                before = self.less(out[mid], out[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            merged = np.empty(n, np.int64)
            merged[np.minimum(begin, other) + (spot - begin) + (low - base)] = out
            out, width = merged, width * 2
        return out


def repeated_offsets(contexts: list[bytes], back: np.ndarray, reach: np.ndarray, count: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context the byte runs, relative to its anchor, of its repeated strings."""
    s = Suffixes(contexts, back)
    order = s.order()
    after = np.append(0, s.common(order[:-1], order[1:])) if len(order) > 1 else np.zeros(len(order), np.int64)
    at, back, reach, many = s.at[order], back[order], reach[order], count[order] > 1
    strings = np.lib.stride_tricks.sliding_window_view(s.data, LENGTH)
    marks = []
    for x in range(int(reach.min()), int(back.max()) + 1):
        right = np.cumsum(after < LENGTH - x)
        held = np.flatnonzero((reach <= x) & (x <= back))
        if not len(held):
            continue
        begin = at[held] - x
        cls = mix(right[held].astype(np.uint64)) + s.hashes(begin, x)
        by = np.argsort(cls, kind="stable")
        new = np.concatenate([[True], cls[by][1:] != cls[by][:-1]])
        head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        differ = (strings[begin[by]] != strings[begin[head]]).any(axis=1)
        if differ.any():  # colliding hashes: classes of the bytes themselves
            group = np.unique(strings[begin[by]], axis=0, return_inverse=True)[1].ravel()
        else:
            group = np.cumsum(new) - 1
        size = np.bincount(group, 1 + many[held[by]])
        hit = held[by][size[group] > 1]
        marks.append(np.stack([order[hit], np.full(len(hit), x)], axis=1))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for i, x in (np.concatenate(marks)[::-1].tolist() if marks else ()):
        runs = out[i]  # offsets fall, so runs begin later and later
        if runs and -x <= runs[-1][1]:
            runs[-1] = (runs[-1][0], LENGTH - x)
        else:
            runs.append((-x, LENGTH - x))
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Work through contexts sorted by key, a batch of whole groups at a time."""
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def done(rows):
        contexts = [r["bytes"] for r in rows]
        found = repeated_offsets(contexts, *(np.array([r[c] for r in rows], np.int64) for c in ("back", "reach", "n")))
        hit = [(r["key"], r["context"], [{"a": a, "b": b} for a, b in f]) for r, f in zip(rows, found) if f]
        if hit:
            key, context, runs = zip(*hit)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(context, pa.int64()),
                                              pa.array(runs, run_type)], ["key", "context", "runs"])

    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if len(rows) >= BATCH and r["key"] != rows[-1]["key"]:
                yield from done(rows)
                rows = []
            rows.append(r)
    if rows:
        yield from done(rows)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per string of each context: (key, context, n, x, digest)."""
    for batch in batches:
        for r in batch.to_pylist():
            x = np.arange(r["reach"], r["back"] + 1)
            digests = [xxhash.xxh3_128_digest(r["bytes"][r["back"] - i:r["back"] - i + LENGTH]) for i in x.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), r[c])) for c in ("key", "context", "n")]
                + [pa.array(x.astype(np.int32)), pa.array(digests, pa.binary())], ["key", "context", "n", "x", "digest"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        rows = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = (text or "").encode()
            rows += [{"key": w["key"], "context": w["context"], "n": w["n"], "back": w["back"], "reach": w["reach"],
                      "bytes": raw[w["place"] - w["back"]:w["place"] - w["reach"] + LENGTH]} for w in wanted]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("key", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("back", pa.int64()), ("reach", pa.int64()),
            ("bytes", pa.binary())]))


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        sizes, removed, counts, digests = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode()
            gone, kept, at = _merged(spans or []), hashlib.sha256(), 0
            for a, b in gone:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in gone))
            counts.append(len(gone))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(rid, spans): byte runs (a, b) of each row (rid, text) that are covered by repeated strings."""
    found = stage(rows.mapInArrow(_anchor_rows, "rid long, place long, back long, reach long, key long, context long"),
                  "anchors")
    contexts = found.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"))
    keys = (contexts.groupBy("key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds"))
            .where(F.col("rows") > 1))
    live = stage(join_by_counts(found, stage(keys, "anchor-keys"), "key", "rows", "inner"), "live-anchors")
    plain = live.where(F.col("kinds") == 1).select(
        "rid", (F.col("place") - F.col("back")).alias("a"), (F.col("place") - F.col("reach") + LENGTH).alias("b"))
    mixed = live.where(F.col("kinds") > 1)
    kinds = mixed.groupBy("key", "context", "back", "reach", "kinds").agg(
        F.min(F.struct("rid", "place")).alias("own"), F.count(F.lit(1)).alias("n"))
    wanted = kinds.groupBy("own.rid").agg(F.collect_list(F.struct(
        "key", "context", "back", "reach", "kinds", "n", F.col("own.place").alias("place"))).alias("wanted"))
    cut = "key long, context long, n long, back long, reach long, bytes binary"
    hot = F.col("kinds") > hot_contexts

    def bytes_of(which):
        own = wanted.select("rid", F.filter("wanted", which).alias("wanted")).where(F.size("wanted") > 0)
        return rows.join(own, "rid").select("text", "wanted").mapInArrow(_cut_contexts, cut)

    usual = (bytes_of(lambda w: w["kinds"] <= hot_contexts).repartition("key").sortWithinPartitions("key", "context")
             .mapInArrow(_sorted_groups, "key long, context long, runs array<struct<a:int,b:int>>"))
    if not kinds.where(hot).isEmpty():
        strings = stage(bytes_of(lambda w: w["kinds"] > hot_contexts).mapInArrow(
            _spread, "key long, context long, n long, x int, digest binary"), "spread-strings")
        twice = strings.groupBy("digest", "x").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where(F.col("n") > 1)
        twice = stage(twice.select(F.struct("digest", "x").alias("string"), "m"), "twice")
        spread = join_by_counts(strings.select(F.struct("digest", "x").alias("string"), "key", "context"), twice,
                                "string", "m", "inner")
        usual = usual.unionByName(spread.groupBy("key", "context").agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("string.x")).alias("a"), (LENGTH - F.col("string.x")).alias("b")))).alias("runs")))
    usual = stage(usual, "repeated-runs")
    sizes = mixed.select("key", "context", "rid", "place").withColumn("kind", F.struct("key", "context"))
    counts = kinds.select(F.struct("key", "context").alias("kind"), "n")
    marked = usual.select(F.struct("key", "context").alias("kind"), "runs").join(counts, "kind")
    spans = join_by_counts(sizes.drop("key", "context"), stage(marked, "marked-contexts"), "kind", "n", "inner").select(
        "rid", "place", F.explode("runs").alias("r")).select(
        "rid", (F.col("place") + F.col("r.a")).alias("a"), (F.col("place") + F.col("r.b")).alias("b"))
    return plain.unionByName(spans).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def deduplicate(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    rows = with_rid(docs.select("doc_id", "text"))
    spans = repeated_spans(rows.select("rid", "text"), hot_contexts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
