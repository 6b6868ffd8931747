import hashlib
import re

import pytest
from data import CLASHING, ODD, SF, docs_of, empty_docs, rows_of

from citesight.llm import decontaminate as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[a:a + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                ids = wins.get(tuple(w[a:a + k]))
                if ids:
                    hit |= set(range(a, a + k))
                    got |= {str(i) for i in ids if i is not None}
        ids = ",".join(sorted(got))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(0, "Same text"), (1, " ".join(f"t{i}" for i in range(30))), (12, " ".join(f"t{i}" for i in range(5, 20))),
         (3, None), (4, "--"), (None, "found"), (5, "again and again " * 9), (5, " ".join(f"T{i}" for i in range(14)))]
TEXTS = ODD + [(20, "Pre " + " ".join(f"t{i}" for i in range(3, 25)) + " post"), (21, " ".join(f"t{i}" for i in range(12))),
               (22, "x, same -- TEXT; same text"), (22, "x, same -- TEXT; same text")]


@pytest.mark.parametrize("bound", [1000, 5])
def test_against_brute_force(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(docs_of(spark, TEXTS, CLASHING), items, broadcast_rows=bound)
    assert rows_of(got) == brute(TEXTS, ITEMS)


def test_blocks_by_bytes_and_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_PER_PART", 2)
    many = ITEMS + [(100 + i, " ".join(f"t{k}" for k in range(6, 22 - i % 3))) for i in range(9)] + [(200, "same TEXT")]
    items = spark.createDataFrame(many, "item_id long, text string")
    wins = D.windows(items)
    assert wins.groupBy("mark", "back", "win").count().where("count > 1").count() > 0
    want = brute(TEXTS, many)
    for size in (D.BROADCAST_BYTES, 4000):
        assert rows_of(D.contamination(docs_of(spark, TEXTS, CLASHING), items, broadcast_bytes=size)) == want


def test_whole_small_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert rows_of(D.contamination(docs, items)) == want


def test_keeps_clean_rows_and_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, TEXTS, CLASHING)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    bad = [(d, t) for (d, t), r in zip(TEXTS, [brute([x], ITEMS)[0] for x in TEXTS]) if not r[5]]
    assert rows_of(kept, "doc_id", "text") == sorted(bad, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(empty_docs(spark), none).count() == 0
    assert not any(r.contaminated for r in D.contamination(docs_of(spark, ODD), none).collect())
