"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint has 64 bits, bit by bit the majority over the XXH64 (seed 42)
of the text's word shingles. Fingerprints that differ in at most
``MAX_BITS`` bits are linked, and the links' connected components are the
groups.

Finding links: a fingerprint is embedded as the bit counts of its 16
four-bit segments. Flipping a bit moves one count by one, so the Manhattan
distance of two embeddings is at most the Hamming distance. The 16 counts are
taken as two halves of 8; within ``MAX_BITS = 3`` one half moves by at most
1. Each half is a cell of an integer grid. A fingerprint is stored in its two
cells and looks into them and into the cells one step up in one count (one
step down is seen from the other side), and the pair is kept only if the
fingerprints themselves differ in at most ``MAX_BITS`` bits. No link is lost.

Only distinct fingerprints are joined: copies share one. The join, on
(half, cell), sorts and spills, and Spark splits a crowded cell. Components
come from alternating large-star and small-star steps over staged links; a
hub is salted by its own link count. The driver sees two numbers per round.

Cases: null, empty and wordless texts have fingerprint zero, linked like any
other; texts of fewer words than a shingle are one shingle; repeated rows and
equal texts fall into one group; rows without an id never name a group unless
all of it lacks ids, then its id is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesight.llm.common import columns, drop_rows, fresh, join_by_counts, stage, with_rid
from citesight.llm.hashing import bounded

WORDS, MAX_BITS, SEED = 3, 3, 42
SEGMENT, HALF = 4, 8
BLOCK = 1 << 18
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of one text as an unsigned number."""
    w = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else iter([b" ".join(w)])
    total, counts = 0, np.zeros((8, 256), np.int64)
    while block := list(islice(grams, BLOCK)):
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in block), np.uint64, len(block))
        places = h.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
        total += len(block)
    ones = (counts @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """``keep`` plus ``fp``, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps.view(np.int64))], [*keep, "fp"])

    rows = rows.select(*keep, "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, f"{fields}, fp long")


def _cells(fp: Column) -> list[Column]:
    """Grid cell of each half: its segment counts as digits of base SEGMENT + 1."""
    out = []
    for half in range(64 // (SEGMENT * HALF)):
        digits = [F.bit_count(F.shiftright(fp, SEGMENT * (half * HALF + i)).bitwiseAND(F.lit((1 << SEGMENT) - 1)))
                  * F.lit((SEGMENT + 1) ** i) for i in range(HALF)]
        out.append(sum(digits[1:], digits[0]))
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    if max_bits > 3:
        raise ValueError("two halves of the grid cover distances up to 3")
    cells = fps.select("fp", F.posexplode(F.array(*_cells(F.col("fp")))).alias("half", "cell"))
    step = [(SEGMENT + 1) ** i for i in range(HALF)]
    probes = cells.select(F.col("fp").alias("a"), "half", F.explode(F.filter(F.array(
        F.col("cell"), *[F.when((F.col("cell") / s).cast("int") % (SEGMENT + 1) < SEGMENT, F.col("cell") + s)
                         for s in step]), lambda c: c.isNotNull())).alias("cell"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits
    pairs = probes.join(cells, (probes["half"] == cells["half"]) & (probes["cell"] == cells["cell"])
                        & (F.col("a") != F.col("fp")) & near)
    return pairs.select(F.least("a", "fp").alias("u"), F.greatest("a", "fp").alias("v")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the not larger) neighbours of each node on the smallest node around it."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    met = join_by_counts(sides, least, "u", "n", "inner")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
    else:
        out = met.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where(F.col("u") < F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every node with a link; the root is the smallest node of its component."""
    edges = stage(edges, "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == state:
            return edges.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        state = tuple(now)
        edges = stage(_star(stage(_star(edges, True), "large-star"), False), "small-star")


def groups(rows: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(rid, doc_id, fp, component_id, first) of rows (rid, doc_id, text).

    ``first`` is the rid of the group's row with the smallest id, nulls last.
    """
    marked = stage(fingerprints(rows, ["rid", "doc_id"], words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    fps = stage(marked.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), max_bits))
    rooted = stage(fps.join(roots, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "roots")
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("members"))
    classes = join_by_counts(rooted.select("fp", "n", "root"), heads, "root", "members", "inner").select(
        "fp", "n", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("first"))
    return join_by_counts(marked, classes, "fp", "n", "inner").select("rid", "doc_id", "fp", "component_id", "first")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return groups(with_rid(docs.select("doc_id", "text")), words, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    rid = fresh(docs, "rid")
    rows = with_rid(docs, rid)
    found = groups(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), words, max_bits)
    gone = found.where(F.col("rid") != F.col("first")).select(F.col("rid").alias(rid))
    return drop_rows(rows, gone, rid).select(*columns(docs.columns))
