"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

A document is its token ids and a closing id. One longer than ``CAPACITY`` is
cut into full pieces, of which the first may be shorter; full pieces are
sequences of their own. The others are packed by falling length: with
``N[g]`` the number of open sequences that have ``g`` tokens left, a piece
goes to the open sequence where the sum of ``N[g]**2`` ends up smallest, which
keeps the gaps varied and so keeps a fitting gap for what follows. A new
sequence is opened only when no open one has room.

The rule looks at one piece after another but only at counts per gap, so
pieces are dealt by a row hash into groups of about ``GROUP_ROWS`` documents,
each packed by its own task; a group leaves a handful of open sequences
behind, whatever its size. Only lengths and checksums are shuffled, never
tokens or texts.

Tokens: a byte-level BPE works inside pre-tokens (words with their leading
blank, digits, signs, white space). Their borders are found for a whole batch
of texts at once, equal ones are recognised by a 64-bit hash, and each
distinct one is encoded once per worker. Texts with characters outside the
tabled range, or with the tokenizer's special strings, go through the
tokenizer whole.

Cases: null and empty texts are the closing id alone; repeated rows are
packed each; an empty table gives no rows. Ties between equal sums fall to
the smallest gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesight.llm.common import stage, with_rid
from citesight.llm.hashing import bounded, mix, slice_hashes

CAPACITY, CLOSING_ID, GROUP_ROWS = 1024, 2, 32_768
#: Distinct pre-tokens a worker remembers before it starts afresh.
MEMORY = 3 << 17
#: Characters below are tabled; texts with others go through the tokenizer whole.
TABLED = 0x2100
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)


def _classes() -> np.ndarray:
    """Class of each tabled character; unassigned ones are unknown."""
    chars = "".join(map(chr, range(TABLED)))
    out = np.full(TABLED, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}"), (UNKNOWN, r"\p{Cn}")):
        out[[m.start() for m in regex.finditer(pattern, chars)]] = kind
    return out


def _byte_signs() -> dict[int, int]:
    """Printable form of each byte in a byte-level vocabulary: itself if printable, else the next sign from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def pretoken_starts(cps: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; ``heads`` are the first characters of the texts."""
    n = len(cps)
    head = np.zeros(n + 1, bool)
    head[heads] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white-space character before a word stands alone, or joins the word if it is a blank
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~head[1:n]) + 1
    start[after - 1] = True
    start[after[cps[after - 1] == 32]] = False
    quotes = np.flatnonzero(start & (cps == 39))
    if len(quotes):
        padded = np.concatenate([cps, [0, 0, 0]])
        inside = ~np.concatenate([head, [True, True]])
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & inside[quotes + 1]
        double = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        double &= inside[quotes + 1] & inside[quotes + 2] & ~single
        for q, size in ((quotes[single], 1), (quotes[double], 2)):
            start[q + 1] = False
            follow = q + 1 + size
            follow = follow[follow < n]
            start[follow[kind[follow] == LETTER]] = True
    return start


class Encoder:
    """Token ids of texts, by remembered pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.signs, self.kinds = _byte_signs(), _classes()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.size, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _word(self, word: str) -> list[int]:
        shown = word.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.whole.model.tokenize(shown)]

    def _look_up(self, keys: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        if len(self.slots) > MEMORY:
            self.forget()
        slots = [self.slots.get(k, -1) for k in keys.tolist()]
        new = [i for i, s in enumerate(slots) if s < 0]
        if new:
            ids = [self._word(text[starts[first[i]]:ends[first[i]]]) for i in new]
            base = len(self.size)
            for j, i in enumerate(new):
                slots[i] = self.slots[int(keys[i])] = base + j
            size = np.array([len(x) for x in ids], np.int64)
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.array([t for x in ids for t in x], np.uint32)])
        return np.array(slots, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        text = "".join(texts)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=heads[1:])
        kind = self.kinds[np.minimum(cps, TABLED - 1)]
        odd = np.flatnonzero((cps >= TABLED) | (kind == UNKNOWN))
        slow = set((np.searchsorted(heads, odd, "right") - 1).tolist())
        slow.update(i for i, t in enumerate(texts) if any(s in t for s in self.special))
        for i in slow:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        if len(slow) < len(texts) and len(cps):
            starts = np.flatnonzero(pretoken_starts(cps, kind, heads[:-1][heads[:-1] < len(cps)]))
            ends = np.append(starts[1:], len(cps))
            keys = mix(slice_hashes(mix(cps.astype(np.uint64) + np.uint64(1)), starts, ends) + (ends - starts).astype(np.uint64))
            keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            slot = self._look_up(keys, first, starts, ends, text)[inverse]
            size = self.size[slot]
            to = np.cumsum(size)
            ids = self.pool[np.repeat(self.at[slot] - (to - size), size) + np.arange(to[-1])]
            bounds = np.concatenate([[0], to])[np.searchsorted(starts, heads)]
            for i in range(len(texts)):
                if out[i] is None:
                    out[i] = ids[bounds[i]:bounds[i + 1]]
        return [x if x is not None else np.zeros(0, np.uint32) for x in out]


def token_rows(path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID):
    """Arrow function: rid, doc_id, n (ids with the closing one) and the checksum of each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in bounded(batches):
            sizes, sums = [], []
            for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.append(ids, np.uint32(closing_id)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                raw = memoryview(ids.tobytes())
                sizes.append(len(ids))
                sums.append([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.list_(pa.int64()))], ["rid", "doc_id", "n", "sums"])
    return run


def sum_of_squares(sizes, capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, taken in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by tokens left
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = [], [], 0
    far = np.int64(1) << 62
    for size in sizes:
        left = count[size:capacity]
        # change of the sum: the gap it leaves loses one, the gap it comes to gains one
        change = 1 - 2 * left
        change[1:] += 2 * count[1:capacity - size] + 1
        change[left == 0] = far
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and left[best]:
            gap = size + best
            seq = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, seq, made = capacity, made, made + 1
        where.append(seq)
        offset.append(capacity - gap)
        if gap > size:
            waiting[gap - size].append(seq)
            count[gap - size] += 1
    return where, offset


def _pack_group(capacity: int):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.assign(first=(t["n"] - 1) % capacity + 1).sort_values(
            ["first", "rid"], ascending=[False, True]).reset_index(drop=True)
        pieces = t["sums"].map(len).to_numpy()
        where, offset = sum_of_squares(t["first"].tolist(), capacity)
        row = np.repeat(np.arange(len(t)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = t["first"].to_numpy()[row]
        later = piece > 0
        own = max(where, default=-1) + np.cumsum(later)  # full pieces follow the packed sequences
        sequence = np.where(later, own, np.array(where, np.int64)[row])
        return pd.DataFrame({
            "doc_id": t["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32),
            "start": np.where(later, first + (piece - 1) * capacity, 0),
            "length": np.where(later, capacity, first),
            "ids_crc32": np.concatenate([np.zeros(0, np.int64), *t["sums"]]).astype(np.int64),
            "sequence_id": (t["part"].to_numpy()[row].astype(np.int64) << 40) | sequence,
            "offset": np.where(later, 0, np.array(offset, np.int64)[row])})
    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    # ids travel as strings: pandas would turn whole numbers with a null into floats
    rows = with_rid(docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("string"))
    made = stage(rows.select("rid", "doc_id", "text").mapInArrow(token_rows(path, capacity, closing_id),
                                 "rid long, doc_id string, n long, sums array<long>"), "tokens")
    parts = max(1, -(-made.count() // group_rows))
    made = made.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)))
    packed = made.groupBy("part").applyInPandas(
        _pack_group(capacity), "doc_id string, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
