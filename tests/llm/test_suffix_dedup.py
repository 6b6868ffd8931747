import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from data import CLASHING, ODD, SF, docs_of, empty_docs, rows_of

from citesight.llm import suffix_dedup as S


def brute(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(t[i:i + length]).digest() for t in raw for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[hashlib.md5(t[i:i + length]).digest()] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixed_texts(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(1500)) for _ in range(3)]
    out = []
    for i in range(n):
        b, at = rng.choice(base), rng.randint(0, 900)
        edge = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 150)))
        out.append((i, edge + b[at:at + rng.randint(150, 600)] + edge[::-1]))
    return out + [(90, "a" * 700), (91, "xyz" * 200), (92, "q" * 199), (93, base[0]), (93, base[0])]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_overlapping_copies(spark, hot):
    rows = mixed_texts(5)
    assert rows_of(S.deduplicate(docs_of(spark, rows), hot)) == brute(rows)


def test_generated_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(S.deduplicate(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_and_empty(spark):
    assert rows_of(S.deduplicate(docs_of(spark, ODD, CLASHING))) == brute(ODD)
    assert S.deduplicate(empty_docs(spark)).count() == 0


def test_blocks_of_a_long_text_join_up(spark, monkeypatch):
    rows = mixed_texts(8)
    frame = [r for b in S._anchor_rows([_batch(rows)]) for r in b.to_pylist()]
    monkeypatch.setattr(S, "BLOCK", 64)
    cut = [r for b in S._anchor_rows([_batch(rows)]) for r in b.to_pylist()]

    def starts(found):
        return Counter((r["rid"], p, r["place"]) for r in found
                       for p in range(r["place"] - r["back"], r["place"] - r["reach"] + 1))
    assert starts(cut) == starts(frame)


def _batch(rows):
    import pyarrow as pa
    return pa.RecordBatch.from_pydict({"rid": pa.array(range(len(rows))), "text": pa.array([t for _, t in rows])})


def test_sort_and_collisions(monkeypatch):
    rng = random.Random(2)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(240, 300))) for _ in range(60)]
    contexts += [c[:230] + b"zz" * 20 for c in contexts[:20]]
    back, reach = np.full(80, 30), np.full(80, 0)
    s = S.Suffixes(contexts, back)
    suffixes = [c[30:] for c in contexts]
    assert [suffixes[i] for i in s.order()] == sorted(suffixes)
    want = S.repeated_offsets(contexts, back, reach, np.ones(80, int))
    monkeypatch.setattr(S, "mix", lambda x: x * np.uint64(0))  # all left sides collide
    monkeypatch.setattr(S.Suffixes, "hashes", lambda self, a, n: S.slice_hashes(
        S._CODE[self.data], a, a + n) if np.ndim(n) else np.zeros(len(a), np.uint64))
    assert S.repeated_offsets(contexts, back, reach, np.ones(80, int)) == want
