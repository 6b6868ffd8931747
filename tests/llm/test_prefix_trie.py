import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from data import rows_of

from citesight.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract by dictionaries: one row per distinct prefix."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode() if node else b"")
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, convs=60, words=("a", "b", "", "é")):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(convs) for t in range(rng.randint(1, 9))]
    return rows


def test_odd_rows(spark):
    rows = chats(1) + [(7, None, None, None), (7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "user", "a tie"),
                       (None, 0, "user", "lost"), (1003, 5, None, "x" * 50_000), (2**40, 1, "user", "far"), (2**40 + 1, 1, "user", "far")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("depth", "place", "top", "weight", "a.b"):
        df = df.withColumn(c, df.conv_id)
    assert rows_of(T.prefix_trie(df)) == brute(rows)


def test_rounds_segments_and_hot_conversations_give_the_same(spark):
    rows = chats(2, 40) + [(500, t, "user", str(t)) for t in range(120)] + [(c, 0, "user", "hot") for c in range(1000, 1080)]
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA), bound=6, segment=3, min_rows=10)
    assert rows_of(got) == brute(rows)


def test_one_long_chain(spark):
    rows = [(5, t, "user", "same") for t in range(70)]
    assert rows_of(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), bound=8)) == brute(rows)


def test_empty(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_centroid_decomposition_of_random_forests(seed):
    rng = np.random.default_rng(seed)
    n = 300
    parent = np.array([-1 if i == 0 or rng.random() < 0.02 else rng.integers(max(0, i - 1 - seed * 40), i) for i in range(n)])
    depth = np.zeros(n, int)
    for i in range(n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    own, values = rng.integers(1, 9, n), rng.integers(-5, 9, (n, 2))
    weight, sums = own.copy(), values.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            weight[parent[i]] += weight[i]
            sums[parent[i]] += sums[i]
    f = T.Forest(depth, parent)
    assert (T.decompose(f, weight[f.order], values[f.order]) == sums[f.order]).all()
