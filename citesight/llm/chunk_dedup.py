"""Repeated passages removed by content-defined chunking.

A gear hash rolls over the bytes of a text: every byte shifts the hash left
and adds a table value, so it depends on the last ``GEAR_BITS`` bytes only. A
chunk ends where the top ``CUT_BITS`` bits are zero (never inside a
character). Cuts depend on nearby bytes alone, so an insertion moves the cuts
around it and no others: equal passages fall into equal chunks after their
first few dozen bytes, wherever they stand.

Chunks are known by their 64-bit digest. Its first row keeps a chunk, every
later occurrence is a repeat. Runs of at least two adjacent repeats and
``MIN_RUN`` bytes are cut out as they are. A shorter run does not show whether
chance repeats a phrase or a passage goes on around it, so each of its chunks
is a seed: it is extended byte by byte to both sides against the kept
occurrence, and a verified repeat of ``MIN_WORDS`` words, or of ``MIN_REPEAT``
bytes where words are long or not spaced, is cut out whole. A single colliding
digest removes nothing.

Few seeds have such surroundings. One of the two sides must reach half of what
the chunk lacks to so many one-letter words, so chunks carry a byte of hash of
that many bytes on each side; where both differ the seed is done, none is lost.

Repeats inside one text are found while it is chunked. Across texts the first
row of each digest is a primitive minimum with map-side combine, and chunks
meet it in a join that salts digests held by many rows with the counts at
hand. Chunk rows are staged once; the text is shuffled once, to meet its runs.
The bytes around kept occurrences are read where the texts lie, by a broadcast
of their places up to ``BROADCAST_ROWS`` of them; beyond that the text is
shuffled once more.

Limits: a seed is extended by at most ``CONTEXT`` bytes to a side. On the right
the next shared chunk ends no later than that; on the left a repeat goes on
further only through as many bytes without a cut. Passages that share no chunk
with their kept occurrence, or only chunks first seen elsewhere, are not found.

Cases: null and empty texts have no chunks and stay as they are; texts without
runs stay byte for byte; repeated rows lose all but their first (short ones
below ``MIN_RUN`` stay whole); an empty table gives no rows. A text that is
cut out entirely becomes empty, its row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesight.llm.common import BROADCAST_ROWS, columns, fresh, join_by_counts, stage, with_rid
from citesight.llm.hashing import bounded, mix

GEAR_BITS, CUT_BITS = 16, 5
MIN_CHUNK, MAX_CHUNK = 12, 256
MIN_RUN = 112
#: Least words or bytes of a verified repeat around a shared chunk; bytes read on each side of it.
MIN_WORDS, MIN_REPEAT, CONTEXT = 50, 250, 512
#: Bytes of a long text that are hashed at a time.
BLOCK = 1 << 20
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(64 - GEAR_BITS)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: the sum of the last GEAR_BITS table values, each shifted by its age."""
    h = _GEAR[data]
    step = 1
    while step < GEAR_BITS:
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    found = []
    for at in range(0, n, BLOCK):
        lead = min(at, GEAR_BITS)
        h = gear(data[at - lead:at + BLOCK])[lead:]
        found.append(np.flatnonzero(h >> np.uint16(GEAR_BITS - CUT_BITS) == 0) + at + 1)
    cuts = np.concatenate([np.zeros(0, np.int64), *found])
    cuts = cuts[cuts < n]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80].tolist()
    ends, last = [], 0
    for c in [*cuts, n]:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if c - last >= MIN_CHUNK or c == n:
            ends.append(c)
            last = c
    return ends if n else []


def surroundings(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """A byte of hash of the bytes before and one of those after each chunk; 0 where the text ends sooner."""
    digest_of, n, out = xxhash.xxh3_64_intdigest, len(raw), []
    least = min(2 * MIN_WORDS - 1, MIN_REPEAT)
    for a, b in zip(starts, ends):
        k = max(least - (b - a) + 1, 0) // 2
        left = digest_of(raw[a - k:a]) % 255 + 1 if k <= a else 0
        right = digest_of(raw[b:b + k]) % 255 + 1 if b + k <= n else 0
        out.append(left << 8 | right)
    return np.array(out, np.int32)


def alike(x, y):
    """Whether two surroundings agree on a side."""
    left, right = (x >> 8) & 255, x & 255
    return ((left != 0) & (left == (y >> 8) & 255)) | ((right != 0) & (right == y & 255))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest_of = xxhash.xxh3_64_intdigest
    for batch in bounded(batches):
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode()
            if not raw:
                continue
            ends = chunk_ends(np.frombuffer(raw, np.uint8))
            starts = [0, *ends[:-1]]
            digests = np.array([digest_of(raw[a:b]) for a, b in zip(starts, ends)], np.uint64).view(np.int64)
            around = surroundings(raw, starts, ends)
            _, index, inverse = np.unique(digests, return_index=True, return_inverse=True)
            again = np.ones(len(ends), bool)
            again[index] = False
            first, at = index[inverse], np.array(starts, np.int64)
            far = ~(again & alike(around, around[first]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), rid)), pa.array(at), pa.array(np.array(ends, np.int64)),
                 pa.array(digests), pa.array(again), pa.array(around), pa.array(at[first], mask=far)],
                ["rid", "start", "stop", "digest", "again", "around", "own"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of a scan task in batches of some size."""
    held, rows = [], 0
    for b in _chunk_rows(batches):
        held.append(b)
        rows += b.num_rows
        if rows >= 1 << 16:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def repeats(rows: DataFrame, min_run: int = MIN_RUN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(rid, cuts, own, seeds) of every row (rid, text) with chunks that occurred before: the runs to cut, and
    the chunks outside them with the place in the same text, or the bytes around the place in another, to compare."""
    chunks = stage(rows.select("rid", "text").mapInArrow(
        _packed, "rid long, start long, stop long, digest long, again boolean, around int, own long"), "chunks")
    fresh_ones = chunks.where(~F.col("again")).select("digest", "rid", "start", "stop", "around")
    place = F.shiftleft("start", 16).bitwiseOR(F.col("around"))
    shared = stage(fresh_ones.groupBy("digest").agg(
        F.min("rid").alias("first"), F.min_by(place, "rid").alias("place"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1), "shared-chunks")
    later = join_by_counts(fresh_ones, shared, "digest", "n", "inner").where(F.col("rid") != F.col("first"))
    near = alike_columns(F.col("around"), F.col("place"))
    found = later.select("rid", "start", "stop", F.when(near, F.col("digest")).alias("digest"),
                         F.lit(None).cast("long").alias("own")).unionByName(
        chunks.where("again").select("rid", "start", "stop", F.lit(None).cast("long").alias("digest"), "own"))
    parts = found.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "digest", "own"))).alias("parts"))
    judged = stage(parts.mapInArrow(_judge(min_run), "rid long, cuts array<struct<a:long,b:long>>, "
                                    "seeds array<struct<start:long,stop:long,digest:long,own:long>>"), "judged-runs")
    seeds = judged.select("rid", F.explode("seeds").alias("s")).select("rid", "s.*").where("digest is not null")
    wanted = stage(seeds.groupBy("digest").agg(F.count(F.lit(1)).alias("n"),
                                               F.first(F.col("stop") - F.col("start")).alias("size"))
                   .join(shared.select("digest", "first", "place"), "digest")
                   .select("digest", "n", "size", F.col("first").alias("rid"),
                           F.shiftright("place", 16).alias("at")), "seed-places")
    places = wanted.groupBy("rid").agg(F.collect_list(F.struct("digest", "n", "at", "size")).alias("wanted"))
    places = F.broadcast(places) if wanted.count() <= broadcast_rows else places
    contexts = stage(rows.select("rid", "text").join(places, "rid").select("text", "wanted").mapInArrow(
        _contexts, "digest long, n long, before binary, chunk binary, after binary"), "seed-contexts")
    met = join_by_counts(seeds.select("rid", "start", "stop", "digest"), contexts, "digest", "n", "inner")
    met = met.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "before", "chunk", "after")).alias("seeds"))
    own = F.transform(F.filter("seeds", lambda s: s["own"].isNotNull()),
                      lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["own"].alias("own")))
    return judged.select("rid", "cuts", own.alias("own")).join(met, "rid", "left")


def alike_columns(x, y):
    """``alike`` for integer columns."""
    def sides(c):
        return F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)
    (a, b), (c, d) = sides(x), sides(y)
    return ((a != 0) & (a == c)) | ((b != 0) & (b == d))


def runs(parts, min_run: int = MIN_RUN) -> tuple[list[tuple[int, int]], list[int]]:
    """Adjacent repeats joined: those of two or more chunks and ``min_run`` bytes, and the numbers of the other chunks."""
    out, weak, held, b = [], [], [], 0

    def done():
        if len(held) > 1 and b - parts[held[0]][0] >= min_run:
            out.append((parts[held[0]][0], b))
        else:
            weak.extend(held)

    for i, (start, stop) in enumerate(parts):
        if held and start != b:
            done()
            held = []
        held.append(i)
        b = stop
    done()
    return out, weak


def _judge(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        seed = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "stop", "digest", "own")]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # some rows at a time: a long text has many parts
                some = batch.slice(at, 64)
                cuts, seeds = [], []
                for parts in some.column("parts").to_pylist():
                    cut, weak = runs([(p["start"], p["stop"]) for p in parts], min_run)
                    cuts.append([{"a": a, "b": b} for a, b in cut])
                    seeds.append([p for p in (parts[i] for i in weak)
                                  if p["digest"] is not None or p["own"] is not None])
                yield pa.RecordBatch.from_arrays([some.column("rid"), pa.array(cuts, span), pa.array(seeds, seed)],
                                                 ["rid", "cuts", "seeds"])
    return run


def sides(raw: bytes, start: int, stop: int) -> dict[str, bytes]:
    return {"before": raw[max(start - CONTEXT, 0):start], "chunk": raw[start:stop], "after": raw[stop:stop + CONTEXT]}


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted chunk."""
    schema = pa.schema([("digest", pa.int64()), ("n", pa.int64()), ("before", pa.binary()),
                        ("chunk", pa.binary()), ("after", pa.binary())])
    for batch in bounded(batches):
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode()
            for i in range(0, len(wanted), 4096):
                yield pa.RecordBatch.from_pylist(
                    [{"digest": w["digest"], "n": w["n"]} | sides(raw, w["at"], w["at"] + w["size"])
                     for w in wanted[i:i + 4096]], schema)


def extended(raw: bytes, start: int, stop: int, kept: dict[str, bytes], room: int) -> tuple[int, int]:
    """The chunk with the bytes at its sides, ``room`` in all, that are as around the kept occurrence, in whole
    characters; empty where the chunks differ."""
    if raw[start:stop] != kept["chunk"]:
        return start, start
    a, b = start, stop
    for x in reversed(kept["before"]):
        if a == 0 or raw[a - 1] != x or start - a == room:
            break
        a -= 1
    for x in kept["after"]:
        if b == len(raw) or raw[b] != x or start - a + b - stop == room:
            break
        b += 1
    while a < start and raw[a] & 0xC0 == 0x80:
        a += 1
    while stop < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def verified(raw: bytes, own: list[dict], seeds: list[dict]) -> list[tuple[int, int]]:
    """Seeds extended, those of ``MIN_WORDS`` words or ``MIN_REPEAT`` bytes."""
    out = [extended(raw, s["start"], s["stop"], s, 2 * CONTEXT) for s in seeds]
    for s in own:  # the two occurrences must not overlap: one of them stays
        end = s["own"] + s["stop"] - s["start"]
        out.append(extended(raw, s["start"], s["stop"], sides(raw, s["own"], end), s["start"] - end))
    return [(a, b) for a, b in out if b - a >= MIN_REPEAT or len(raw[a:b].split()) >= MIN_WORDS]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(keep: list[str], added: tuple[str, ...], found_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts, sizes, removed, spans = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(found_name).to_pylist()):
                raw, cut = (text or "").encode(), []
                if found:
                    more = verified(raw, found["own"], found["seeds"] or [])
                    cut = merged([*((c["a"], c["b"]) for c in found["cuts"]), *more])
                gone = sum(b - a for a, b in cut)
                if cut:
                    left = [0, *[b for _, b in cut]]
                    text = b"".join(raw[a:b] for a, b in zip(left, [*[a for a, _ in cut], len(raw)])).decode()
                texts.append(text)
                sizes.append(len(raw))
                removed.append(gone)
                spans.append(len(cut))
            made = {"text": pa.array(texts, pa.string()), added[0]: pa.array(sizes, pa.int64()),
                    added[1]: pa.array(removed, pa.int64()), added[2]: pa.array(spans, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in [*keep, *added]],
                                             [*keep, *added])
    return run


def deduplicate(docs: DataFrame, min_run: int = MIN_RUN, added: tuple[str, str, str] | None = None,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; ``added`` names columns for the bytes
    that a text had, the bytes removed and the runs removed."""
    names = added or tuple(fresh(docs, c) for c in ("n_bytes", "n_removed", "n_spans"))
    # plain names beside the text: an Arrow function takes no dotted ones
    inner = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    rows = with_rid(inner)
    found = repeats(rows.select("rid", "text"), min_run, broadcast_rows)
    met = rows.join(found.select("rid", F.struct("cuts", "own", "seeds").alias("found")), "rid", "left").drop("rid")
    schema = T.StructType([*inner.schema.fields, *[T.StructField(n, T.LongType()) for n in ("n0", "n1", "n2")]])
    return met.mapInArrow(_cut(inner.columns, ("n0", "n1", "n2"), "found"), schema).toDF(*docs.columns, *names)


def keep_first(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with repeated passages cut out, ``n_chars`` brought up to date where it exists."""
    out = deduplicate(docs, min_run).select(*columns(docs.columns))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out
