import random
from collections import defaultdict

import xxhash
from data import CLASHING, ODD, SF, docs_of, empty_docs, rows_of

from citesight.llm import simhash as S


def print_of(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def group(fps):
    """Root of each distinct fingerprint, by comparing all pairs."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute(rows):
    fps = [print_of(t) for _, t in rows]
    root = group(fps)
    ids = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        ids[root[f]].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, f"{f:016x}", least[root[f]]) for (i, _), f in zip(rows, fps)), key=repr)


def test_generated_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(S.near_duplicates(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    assert rows_of(S.near_duplicates(docs_of(spark, ODD, CLASHING))) == brute(ODD)
    kept = S.keep_one(docs_of(spark, ODD, CLASHING))
    assert kept.columns == docs_of(spark, ODD, CLASHING).columns
    heads = sorted({r[2] for r in brute(ODD)}, key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == heads
    assert S.near_duplicates(empty_docs(spark)).count() == 0


def test_links_against_all_pairs(spark):
    rng = random.Random(11)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            f = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    links = S.links(frame)
    assert {tuple(r) for r in links.collect()} == want
    roots = {r.fp: r.root for r in S.components(links).collect()}
    brute_roots = group([f & (2**64 - 1) for f in signed])
    ours = defaultdict(set)
    for f in signed:
        ours[roots.get(f, f)].add(f & (2**64 - 1))
    theirs = defaultdict(set)
    for f, r in brute_roots.items():
        theirs[r].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (150, 41 + 200)]
    frame = spark.createDataFrame(edges, "u long, v long")
    roots = {r.fp: r.root for r in S.components(frame).collect()}
    assert {roots[i] for i in range(1, 41)} == {0}
    assert {roots[100 + i] for i in range(1, 60)} == {100} and roots[201] == 200 and roots[241] == 100
