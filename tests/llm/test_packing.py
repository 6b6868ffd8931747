import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from data import CLASHING, ODD, SF, docs_of, empty_docs
from tokenizers import Tokenizer

from citesight.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["it's we're I'll 's 'sabc don't'll  x  \n\n y\t z !!'s '' ''re 'r 've've", "<|endoftext|> a", "日本語 text",
          "  lead", " \n", "a  ", "émü ñ’s “x”", "'", "'s", " 's", "1a2 3'm 'mm", "\u0378 \u0301 \x1c"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(whole):
    rng = random.Random(4)
    texts = TRICKY + ["".join(rng.choice("'stmdrevl aé1 \n\t!-\u00a0") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = P.Encoder(PATH).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def brute_sum_of_squares(sizes, capacity):
    gaps, where, offset = [], [], []
    for s in sizes:
        def total(change):
            n = defaultdict(int)
            for g in change:
                n[g] += 1
            return sum(c * c for g, c in n.items() if 0 < g < capacity)
        options = [(total(gaps[:i] + [g - s] + gaps[i + 1:]), g, i) for i, g in enumerate(gaps) if g >= s]
        if not options:
            gaps.append(capacity)
        i = min(options)[2] if options else len(gaps) - 1
        where.append(i)
        offset.append(capacity - gaps[i])
        gaps[i] -= s
    return [capacity - g for g in gaps], sorted(zip(offset, sizes))


def test_sum_of_squares_rule():
    rng = random.Random(7)
    for _ in range(20):
        sizes = [rng.randint(1, 20) for _ in range(60)]
        where, offset = P.sum_of_squares(sizes, 20)
        full = defaultdict(int)
        for w, o, s in zip(where, offset, sizes):
            assert o == full[w]
            full[w] += s
        fills, placed = brute_sum_of_squares(sizes, 20)
        assert sorted(full.values()) == sorted(fills) and sorted(zip(offset, sizes)) == placed


def check(df, whole, group_rows=P.GROUP_ROWS):
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = []
    for d, t in texts:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(repr(d), i, a, b - a, crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = P.pack(df, PATH, group_rows=group_rows).collect()
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    return len(seqs), -(-sum(r.length for r in rows) // 1024)


def test_generated_table(spark, whole):
    made, least = check(spark.read.parquet(f"{SF}/documents.parquet"), whole)
    assert made <= 1.01 * least + 2


def test_groups_and_odd_rows(spark, whole):
    check(docs_of(spark, ODD + [(50 + i, t) for i, t in enumerate(TRICKY)], CLASHING), whole, group_rows=5)
    assert P.pack(empty_docs(spark), PATH).count() == 0
