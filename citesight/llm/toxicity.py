"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are its words, word pairs and pairs that skip a word,
lower-cased and hashed to ``2**BITS`` places, words to the lower half and
pairs, which are many and rare, to the upper half with value ``PAIR_VALUE``
instead of 1; a feature counts once per text.
FTRL-proximal keeps a gradient sum and a squared-gradient sum per place, which
gives each its own learning rate, and its L1 term leaves a weight at exactly
zero until the evidence for it exceeds ``L1``. The model is therefore a short
list of non-zero weights (at most ``2**BITS``, whatever the input), which is
collected and broadcast to the scoring tasks.

Training takes labels with a document only: at most ``sample_rows`` of them,
those of smallest id hash, so their number does not grow with the table. Their features
are made where the texts lie; one task then streams the bounded sample through
the learner ``PASSES`` times, in the order of the hash (Spark sorts the passes,
and spills, so the task holds the model alone). Strong L1 makes the model
cautious, so its bias is calibrated: in the first pass every row is scored
before it is learned, and from the scores of its second half the cut with the
best recall less false positive rate is moved to score 0.5. With fewer than
``LEAST`` rows of a kind there the bias stays. Scoring is one pass over all
whole texts, in slices of bounded size; only ids are shuffled, to find the
labels with a document.

Cases: null and empty texts have no features and score the bias; a document
labelled twice takes its larger label; labels without a document or without a
value are not used; without any labelled row every score is 0; repeated rows
each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesight.llm.common import columns, fresh, plain
from citesight.llm.hashing import bounded, joined, mix, slice_hashes
from citesight.session import ship_package

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
PAIR_VALUE = 0.3
PASSES = 5
#: Toxic and clean rows that calibration needs.
LEAST = 20
#: At most so many labelled rows train the model.
SAMPLE_ROWS = 16_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
PAIRS = 1 << (BITS - 1)
_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every word, pair and skip pair, repeats included."""
    data, at = joined([t.lower().encode() for t in texts])
    word = np.concatenate([[False], _WORD[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    h = slice_hashes(_CODE[data], starts, ends)
    doc = np.searchsorted(at, starts, "right") - 1
    docs, hashes = [doc], [h]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        docs.append(doc[gap:][same])
        hashes.append((mix(h[:-gap] + salt) + h[gap:])[same] if len(same) else h[:0])
    places = (mix(np.concatenate(hashes)) >> np.uint64(65 - BITS)).astype(np.int64)
    places[len(h):] += PAIRS
    return np.concatenate(docs), places


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        doc, place = features([t or "" for t in batch.column("text").to_pylist()])
        keys = np.unique((doc << BITS) | place)
        ends = np.searchsorted(keys >> BITS, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("turn"), batch.column("toxic"),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys & ((1 << BITS) - 1), pa.int32()))],
            ["turn", "toxic", "places"])


def values(places: np.ndarray) -> np.ndarray:
    return np.where((places >= PAIRS) & (places < 1 << BITS), PAIR_VALUE, 1.0)


class Ftrl:
    """Per-coordinate FTRL-proximal for features that are present with their value, or absent."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, y: int) -> float:
        """Learn one row; its log odds as they were before."""
        w = self.weights(at)
        odds = float(w @ value)
        g = (1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30))) - y) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return odds


def calibration(odds: np.ndarray, toxic: np.ndarray, least: int = LEAST) -> float:
    """The log odds from which calling a row toxic gains most (recall less false positive rate).

    Midway to the next lower score; among equal gains the highest cut. 0 without enough rows."""
    bad, good = np.sort(odds[toxic == 1]), np.sort(odds[toxic != 1])
    if min(len(bad), len(good)) < least:
        return 0.0
    cuts = np.unique(odds)
    gain = (1 - np.searchsorted(bad, cuts) / len(bad)) - (1 - np.searchsorted(good, cuts) / len(good))
    best = len(cuts) - 1 - int(np.argmax(gain[::-1]))
    return float(cuts[best] + cuts[max(best - 1, 0)]) / 2


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, bias, before = Ftrl((1 << BITS) + 1), 1 << BITS, []
    for batch in batches:
        lists = batch.column("places")
        places, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        for a, b, toxic, nr in zip([0, *ends], ends, batch.column("toxic").to_pylist(), batch.column("pass").to_pylist()):
            at = np.append(places[a:b], bias)
            odds = model.learn(at, values(at), toxic)
            if nr == 0:
                before.append((odds, toxic))  # at most the sample
    if before:
        late = np.array(before[len(before) // 2:])
        w = model.weights(np.arange(bias + 1))
        w[bias] -= calibration(late[:, 0], late[:, 1])
        held = np.union1d(np.flatnonzero(w), [bias])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(w[held])], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, passes: int = PASSES) -> pd.DataFrame:
    """(place, weight) of the non-zero weights, the bias at place ``2**BITS``; empty without labels."""
    ship_package(docs.sparkSession)
    sample = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .join(docs.select("doc_id"), "doc_id", "left_semi")
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("turn", "toxic", "text")
    made = rows.mapInArrow(_feature_rows, "turn long, toxic int, places array<int>")
    again = made.repartition(1).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return (again.sortWithinPartitions("pass", "turn", "places")
            .mapInArrow(_learn, "place long, weight double").toPandas())


def score(docs: DataFrame, model: pd.DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` plus ``name``, the score of every row."""
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast((model["place"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)))

    cols = list(dict.fromkeys([*keep, "text"]))
    rows, text = plain(docs.select(*columns(cols))), f"c{cols.index('text')}"
    kept = rows.columns[:len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight = weights.value
        dense = np.zeros((1 << BITS) + 1)
        dense[place] = weight * values(place)
        for batch in bounded(batches, text):
            doc, at = features([t or "" for t in batch.column(text).to_pylist()])
            live = np.flatnonzero(dense[at])
            once = np.unique((doc[live] << BITS) | at[live])
            total = np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], batch.num_rows) + dense[1 << BITS]
            scores = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))) if len(place) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores)], [*kept, "score"])

    schema = T.StructType([*rows.schema.fields[:len(keep)], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*keep, name)


def held_out(doc_id) -> F.Column:
    """True for the fifth of the ids that never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels.where(~held_out("doc_id")), sample_rows)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents scored below 0.5, with all their columns."""
    model = train(docs, labels.where(~held_out("doc_id")), sample_rows)
    name = fresh(docs, "score")
    return score(docs, model, docs.columns, name).where(F.col(name) < 0.5).select(*columns(docs.columns))
