import random
from collections import defaultdict
from zlib import crc32

from data import CLASHING, ODD, SF, docs_of, empty_docs

from citesight.llm import sharding as S


def least_loaded(sizes, shards):
    """Textbook LPT: each size in falling order to the shard with the least load, found by looking at all."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[min(range(shards), key=lambda s: (loads[s], s))] += size
    return loads


def check(df, shards):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = S.shard(df, shards).collect()
    assert len(out) == len(rows)
    want = sorted((repr(i), len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in out) == want
    slots, together = defaultdict(list), defaultdict(set)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        together[(r["size"], r.text_crc32)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in together.values())
    loads, groups = [0] * shards, defaultdict(int)
    for r in out:
        loads[r.shard] += r["size"]
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    assert loads == least_loaded(groups.values(), shards)  # shard by shard, not only in total


def test_is_lpt_on_the_generated_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), 24)


def test_is_lpt_with_many_groups_of_few_sizes(spark):
    check(docs_of(spark, [(i, f"{i:04d} " * (i % 50 // 7)) for i in range(5000)]), 7)


def test_odd_and_empty(spark):
    check(docs_of(spark, ODD, CLASHING), 24)
    assert S.shard(empty_docs(spark)).count() == 0


def test_dealing_out_many_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        loads = [rng.choice([0, rng.randint(0, 500)]) for _ in range(rng.randint(1, 6))]
        size, count = rng.randint(1, 90), rng.randint(0, 200)
        want, got = list(loads), list(loads)
        for _ in range(count):
            want[min(range(len(want)), key=lambda s: (want[s], s))] += size
        taken = S.deal(got, size, count)
        assert got == want and sum(taken) == count
