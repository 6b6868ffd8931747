import random

import numpy as np
import xxhash
from data import CLASHING, ODD, PASSAGE, SF, docs_of, empty_docs

from citesight.llm import chunk_dedup as C


def ends_of(raw):
    """Chunk ends, byte by byte."""
    ends, last = [], 0
    marks = []
    h = 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(C._GEAR[b])) & 0xFFFF
        if h >> 11 == 0 and i + 1 < len(raw) and raw[i + 1] & 0xC0 != 0x80:
            marks.append(i + 1)
    for c in [*marks, len(raw)]:
        while c - last > C.MAX_CHUNK:
            last += C.MAX_CHUNK
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if raw and (c - last >= C.MIN_CHUNK or c == len(raw)):
            ends.append(c)
            last = c
    return ends


def brute(texts):
    """Texts without their repeated runs, in the given order."""
    seen, out = {}, []
    for t in texts:
        raw = (t or "").encode()
        again, at = [], 0
        for e in ends_of(raw):
            d = xxhash.xxh3_64_intdigest(raw[at:e])
            again.append((at, e, d in seen))
            seen[d] = True
            at = e
        kept, run = b"", []
        for a, e, rep in [*again, (len(raw), len(raw), False)]:
            if rep:
                run.append((a, e))
                continue
            if run and not (len(run) > 1 and run[-1][1] - run[0][0] >= C.MIN_RUN):
                kept += raw[run[0][0]:run[-1][1]]
            run = []
            kept += raw[a:e]
        out.append(kept.decode() if t is not None else None)
    return out


def check(df):
    rows = df.coalesce(1)
    texts = [r.text for r in rows.select("text").collect()]
    got = C.deduplicate(rows, added=("bytes_", "removed_", "spans_")).collect()
    assert sorted(map(repr, (r.text for r in got))) == sorted(map(repr, brute(texts)))
    assert sum(r.bytes_ for r in got) == sum(len((t or "").encode()) for t in texts)
    assert all(r.removed_ == r.bytes_ - len((r.text or "").encode()) for r in got)


def test_chunks_against_the_rolling_definition():
    rng = random.Random(1)
    for n in (0, 1, 50, 3000):
        raw = "".join(rng.choice("abcdé ñ日") for _ in range(n)).encode()
        assert C.chunk_ends(np.frombuffer(raw, np.uint8)) == ends_of(raw)


def test_blocks_do_not_move_cuts(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8) & 0x7F
    want = C.chunk_ends(data)
    monkeypatch.setattr(C, "BLOCK", 100)
    assert C.chunk_ends(data) == want


def test_generated_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_and_empty(spark):
    check(docs_of(spark, ODD, CLASHING))
    docs = docs_of(spark, ODD, CLASHING)
    kept = C.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert C.deduplicate(empty_docs(spark)).count() == 0


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    clean = [(i, prose(150)) for i in range(50)]
    passage = prose(55)
    holding = [(100 + i, prose(40) + " " + passage + " " + prose(40)) for i in range(30)]
    got = {r.doc_id: r.text for r in C.keep_first(docs_of(spark, clean + holding)).collect()}
    assert all(got[i] == t for i, t in clean)
    assert sum(passage in got[i] for i, _ in holding) == 1
    lost = [len(t) - len(got[i]) for i, t in holding]
    assert sorted(lost)[1] > 0.5 * len(passage) and PASSAGE


def short_prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 5))) for _ in range(n))


def pairs_of(rng, n, words):
    """Passages of so many words, each in two documents with different neighbours."""
    passages = [short_prose(rng, words) for _ in range(n)]
    rows = [(2 * i + k, f"{short_prose(rng, 30)} {p} {short_prose(rng, 30)}") for i, p in enumerate(passages) for k in (0, 1)]
    return passages, rows


def test_passages_of_fifty_short_words_go(spark):
    passages, rows = pairs_of(random.Random(5), 150, 55)
    texts = dict(rows)
    docs = docs_of(spark, rows).coalesce(1)
    got = {r.doc_id: r for r in C.deduplicate(docs, added=("bytes_", "removed_", "spans_")).collect()}
    for i, p in enumerate(passages):
        lost = [got[2 * i + k].removed_ for k in (0, 1)]
        assert min(lost) == 0 and max(lost) <= len(p.encode()) + 2 * 8  # neighbours may agree by a letter or a space
        ends = [set(zip([0, *e], e)) for e in map(ends_of, (texts[2 * i].encode(), texts[2 * i + 1].encode()))]
        chunks = [{texts[2 * i + k].encode()[a:b] for a, b in ends[k]} for k in (0, 1)]
        assert max(lost) > 0 or not chunks[0] & chunks[1]
    assert sum(got[2 * i].removed_ + got[2 * i + 1].removed_ == 0 for i in range(len(passages))) <= 2
    # places of kept occurrences shuffled instead of broadcast
    again = C.deduplicate(docs, added=("bytes_", "removed_", "spans_"), broadcast_rows=0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.values()))


def test_passages_inside_one_text_go_and_phrases_stay(spark):
    rng = random.Random(6)
    rows, phrases, sizes = [], [], []
    for i in range(60):
        p = short_prose(rng, 55)
        sizes.append(len(p.encode()))
        rows.append((i, " ".join([short_prose(rng, 30), p, short_prose(rng, 30), p, short_prose(rng, 30)])))
    for i in range(60):
        p = short_prose(rng, 20)
        phrases += [(100 + 2 * i + k, f"{short_prose(rng, 30)} {p} {short_prose(rng, 30)}") for k in (0, 1)]
    got = {r.doc_id: r for r in C.deduplicate(docs_of(spark, rows + phrases), added=("bytes_", "removed_", "spans_")).collect()}
    for (i, t), n in zip(rows, sizes):
        raw, ends = t.encode(), ends_of(t.encode())
        chunks = [raw[x:y] for x, y in zip([0, *ends], ends)]
        assert got[i].removed_ <= n + 16 and (got[i].removed_ > 0 or len(set(chunks)) == len(chunks))
    assert all(got[i].text == t for i, t in phrases)
