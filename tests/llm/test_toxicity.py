from zlib import crc32

import math

import numpy as np
import pytest
from data import CLASHING, ODD, docs_of, empty_docs, rows_of

from citesight.llm import toxicity as X


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, ("you utter nitwit " if i % 9 == 0 else "fine day ") + f"some text number {i} " * 5) for i in range(900)]
    labels = [(i, 1 if i % 9 == 0 else 0) for i in range(900)]
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_on_the_generated_table(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = X.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = out.where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(good) * len(bad))
    # three thousand odd training rows; four languages, each with its own words to learn
    assert auc > 0.97
    assert sum(r.predicted for r in rows if r.toxic) >= 0.9 * len(bad)
    assert sum(r.predicted for r in rows if not r.toxic) < 0.01 * len(good)


def test_odd_rows_and_ids(spark, labelled):
    rows, labels = labelled
    out = X.toxicity(docs_of(spark, rows + ODD, CLASHING), labels)
    assert out.count() == len(rows) + len(ODD)
    for r in out.collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_teach_nothing(spark, labelled):
    rows, labels = labelled
    docs = docs_of(spark, rows)
    flipped = labels.withColumn("toxic", X.F.when(X.held_out("doc_id"), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    assert rows_of(X.toxicity(docs, labels)) == rows_of(X.toxicity(docs, flipped))


def test_sample_is_bounded_and_keeps_columns(spark, labelled):
    rows, labels = labelled
    docs = docs_of(spark, rows + ODD, CLASHING)
    small = X.train(docs, labels, sample_rows=50)
    assert X.train(docs, labels, sample_rows=0).empty and not small.equals(X.train(docs, labels))
    kept = X.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("text like '%nitwit%'").count() == 0
    assert kept.count() == len(rows) + len(ODD) - 100


def test_labels_without_a_document_take_no_place_in_the_sample(spark, labelled):
    rows, labels = labelled
    docs = docs_of(spark, rows)
    absent = spark.range(10_000, 60_000).select(X.F.col("id").alias("doc_id"), X.F.lit(0).alias("toxic"))
    got, want = (X.train(docs, t, sample_rows=50) for t in (labels.unionByName(absent), labels))
    assert len(want) > 1 and got.equals(want)


def test_no_labels_and_empty(spark, labelled):
    none = labelled[1].where("false")
    assert {r.score for r in X.toxicity(docs_of(spark, ODD), none).collect()} == {0.0}
    assert X.toxicity(empty_docs(spark), none).count() == 0
    assert X.keep_clean(docs_of(spark, ODD), none).count() == len(ODD)


M64 = (1 << 64) - 1


def mixed(x):
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 32
    x = x * 0xC2B2AE3D27D4EB4F & M64
    return x ^ x >> 29


def places_of(text):
    """Features of one text by loops over its bytes, in Python integers."""
    base, words, word = 0x9E3779B97F4A7C15 | 1, [], b""
    for c in text.lower().encode() + b" ":
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            words.append(sum(mixed(x + 1) * pow(base, j, 1 << 64) for j, x in enumerate(word)) & M64)
            word = b""
    shift, half = 65 - X.BITS, 1 << (X.BITS - 1)
    out = {mixed(h) >> shift for h in words}
    for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        for a, b in zip(words, words[gap:]):
            out.add((mixed((mixed(a + salt & M64) + b) & M64) >> shift) + half)
    return out


def textbook(rows, passes):
    """FTRL-proximal by dictionaries, one coordinate at a time; (weights, log odds before learning in pass 0)."""
    z, n, first = {}, {}, []

    def weight(i):
        if abs(z.get(i, 0.0)) <= X.L1:
            return 0.0
        return -(z[i] - math.copysign(X.L1, z[i])) / ((X.BETA + math.sqrt(n[i])) / X.ALPHA + X.L2)

    def value(i):
        return X.PAIR_VALUE if X.PAIRS <= i < 1 << X.BITS else 1.0
    for nr in range(passes):
        for at, y in rows:
            at = sorted(at) + [1 << X.BITS]
            w = {i: weight(i) for i in at}
            odds = sum(w[i] * value(i) for i in at)
            if nr == 0:
                first.append((odds, y))
            p = 1 / (1 + math.exp(-max(-30, min(30, odds))))
            for i in at:
                g, old = (p - y) * value(i), n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / X.ALPHA * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}, first


def test_features_by_loops():
    for t in ("", "one", "Two words", "a-b c's Été ÜBER x9 \x00 a-b", "re re re re"):
        assert set(X.features([t])[1].tolist()) == places_of(t)


def test_scores_equal_a_textbook_learner(spark, labelled):
    rows, labels = labelled
    docs = docs_of(spark, rows[:300])
    texts, marks = dict(rows[:300]), {r.doc_id: r.toxic for r in labels.collect() if r.doc_id < 300}
    order = [r.doc_id for r in docs.orderBy(X.F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    w, first = textbook([(places_of(texts[i]), marks[i]) for i in order], X.PASSES)
    late = np.array(first[len(first) // 2:])
    shift = X.calibration(late[:, 0], late[:, 1], least=5)
    model = X.train(docs, labels)
    assert set(model["place"]) == set(w) | {1 << X.BITS} and len(w) > 3
    got = {r.doc_id: r.score for r in X.score(docs, model, ["doc_id"]).collect()}
    bad = sum(marks[i] for i in order[len(order) // 2:])
    shift = shift if bad >= X.LEAST else 0.0
    for i, t in texts.items():
        odds = sum(w.get(p, 0.0) * (X.PAIR_VALUE if p >= X.PAIRS else 1.0) for p in places_of(t)) + w.get(1 << X.BITS, 0.0) - shift
        assert abs(got[i] - 1 / (1 + math.exp(-odds))) < 1e-9


def test_calibration_cuts_between_the_kinds():
    odds = np.array([-5.0] * 30 + [-2.0] * 30 + [-3.0])
    toxic = np.array([0] * 30 + [1] * 30 + [0])
    assert X.calibration(odds, toxic) == -2.5 and X.calibration(odds[:40], toxic[:40]) == 0.0
