"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item
is one window). Documents and items are cut into overlapping ``GRAM``-word
grams; of every run of ``window - GRAM + 1`` grams the one with the smallest
hash is a fingerprint. A window spans exactly one such run, and the choice
depends on its words alone, so each occurrence of a window in a document
holds the same fingerprint at the same place: joining fingerprints loses no
shared window. A hit is extended to the whole window on both sides and
compared word by word, so hash collisions cost a comparison and change
nothing. Windows of short items are joined on the hash of the whole window.

The distinct windows are counted, rows and bytes; as many as fit
``broadcast_rows`` and ``broadcast_bytes`` are broadcast at a time, further
ones in blocks of even shares (by a hash of the whole window, so a
fingerprint that many windows share is spread too). The item ids of one
window are kept in parts of about ``ITEMS_PER_PART``, so no row grows with
the benchmark. Text is never shuffled: what leaves a scan task is one row
per document and one per verified hit.

Cases: null or wordless texts have no words, no hits and are clean; an empty
benchmark leaves all documents clean; repeated document rows each get their
row; items without an id mark words but are not counted; texts may hold up
to 2**28 words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesight.llm.common import BROADCAST_ROWS, ascii_lower, drop_rows, fresh, split_words, stage, with_rid

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 8
ITEMS_PER_PART = 10_000
BROADCAST_BYTES = 256 << 20
#: Bytes a window's row and an element of its lists take besides their characters.
ROW_BYTES, ELEMENT_BYTES = 96, 24
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_WORD)


def _shifted(a: Column, by: int, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, F.slice(a, F.lit(by + 1), F.greatest(F.size(a), F.lit(1))), fn)


def _fingerprints(df: DataFrame, window: int) -> DataFrame:
    """Add ``mins``: for each window start the smallest (gram hash, place), packed into a long.

    Equal hashes fall to the earlier place. Rows of fewer than ``window`` words get an empty list.
    """
    def pair(a, b):
        return F.xxhash64(a, b)

    keep = [c for c in df.columns]
    df = df.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("_h"))
    size = 1
    while size < GRAM:
        df = df.select(*keep, _shifted(F.col("_h"), size, pair).alias("_h"))
        size *= 2
    df = df.select(*keep, F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("w") - (GRAM - 1), F.lit(0))),
        lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))).alias("_h"))
    run, size = window - GRAM + 1, 1
    while size < run:
        step = min(size, run - size)
        df = df.select(*keep, _shifted(F.col("_h"), step, lambda a, b: F.least(a, b)).alias("_h"))
        size += step
    return df.select(*keep, F.slice("_h", F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(0))).alias("mins"))


def _whole(w: Column, place: Column, size: int) -> Column:
    """Packed hash of the ``size`` words from ``place`` on, for short windows."""
    return (F.xxhash64(F.lit(size), F.slice(w, place + 1, F.lit(size)))
            .bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("long")))


def _wholes(w: Column, size: int) -> Column:
    """Packed hash of every run of ``size`` words."""
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: _whole(w, i, size))


def windows(items: DataFrame, window: int = 13) -> DataFrame:
    """Distinct windows: (mark, back, win, items); ``back`` words lie before the fingerprint.

    A window of very many items has several rows, each with a part of the ids.
    """
    parts = max(1, -(-items.count() // ITEMS_PER_PART))  # one number
    base = items.select("item_id", words(F.col("text")).alias("w"))
    long = _fingerprints(base.where(F.size("w") >= window), window).select(
        "item_id", "w", F.posexplode("mins").alias("start", "v"))
    long = long.select("item_id", F.shiftright("v", PLACE_BITS).alias("mark"),
                       (F.col("v").bitwiseAND(F.lit(PLACE)) - F.col("start")).cast("int").alias("back"),
                       F.slice("w", F.col("start") + 1, F.lit(window)).alias("win"))
    short = base.where(F.size("w").between(1, window - 1))
    marks = F.coalesce(*[F.when(F.size("w") == n, _whole(F.col("w"), F.lit(0), n)) for n in range(1, window)])
    short = short.select("item_id", F.shiftright(marks, PLACE_BITS).alias("mark"),
                         F.lit(0).alias("back"), F.col("w").alias("win"))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")
    return (long.unionByName(short).groupBy("mark", "back", "win", part)
            .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")).drop("part"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, min_share: int = 20,
                  broadcast_rows: int = BROADCAST_ROWS, key: str | None = None,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: its words, hit words, items and verdict.

    Contaminated: a word is hit and ``min_share`` times the hits reach the words. ``key`` names a
    further column that tells rows apart and is kept.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    wins = stage(windows(items, window), "decontamination-windows")
    row_bytes = sum(F.octet_length(F.array_join(c, "")) + F.size(c) * ELEMENT_BYTES for c in ("win", "items")) + ROW_BYTES
    info = wins.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"), F.collect_set(
        F.when(F.size("win") < window, F.size("win"))).alias("short")).first()  # at most window - 1 sizes
    blocks = max(1, -(-info["n"] // broadcast_rows), -(-info["bytes"] // broadcast_bytes))
    base = docs.select("doc_id", F.col(key).alias("row") if key else F.xxhash64("text").alias("row"),
                       words(F.col("text")).alias("w"))
    marked = _fingerprints(base, window)
    lists = [F.array_distinct("mins")]
    lists += [_wholes(F.col("w"), n) for n in sorted(info["short"])]
    found = None
    for b in range(blocks):
        # the null mark stands for the document itself, once
        own = [F.array(F.lit(None).cast("long"))] if b == 0 else []
        rows = marked.select("doc_id", "row", "w", F.explode(F.concat(*own, *lists)).alias("v"))
        rows = rows.withColumn("mark", F.shiftright("v", PLACE_BITS))
        part = wins.where(F.pmod(F.xxhash64("mark", "back", "win", "items"), F.lit(blocks)) == b) if blocks > 1 else wins
        start = (F.col("v").bitwiseAND(F.lit(PLACE)) - F.col("back")).cast("int")
        hit = F.when(F.col("win").isNotNull() & (start >= 0) & (start + F.size("win") <= F.size("w")),
                     F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("win"), F.lit(0))) == F.col("win"))
        rows = (rows.join(F.broadcast(part), "mark", "left")
                .where(F.col("v").isNull() | F.coalesce(hit, F.lit(False)))
                .select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.col("v").isNull().alias("own"),
                        F.when(F.col("v").isNotNull(), F.struct(start.alias("a"), (start + F.size("win")).alias("b")))
                        .alias("span"), "items"))
        found = rows if found is None else found.unionByName(rows)
    per_doc = found.groupBy("doc_id", "row", "n_words").agg(
        F.sum(F.col("own").cast("int")).alias("times"), F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"),
                                (acc["hit"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("hit")),
        lambda acc: acc["hit"].cast("long"))
    out = per_doc.select("doc_id", "row", "n_words", covered.alias("n_hit"), "items",
                         F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_t"))
    return out.select(
        "doc_id", *([F.col("row").alias(key)] if key else []), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, min_share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    rid = fresh(docs, "rid")
    rows = with_rid(docs, rid)
    bad = contamination(rows, items, window, min_share, key=rid).where("contaminated").select(rid)
    return drop_rows(rows, bad, rid).drop(rid)
