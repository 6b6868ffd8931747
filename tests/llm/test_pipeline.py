import corpus_pipeline as P
import test_chunk_dedup
import test_decontaminate
import test_packing
import test_simhash
from data import CLASHING, ODD, SF, docs_of, empty_docs, rows_of
from tokenizers import Tokenizer

from citesight.llm import toxicity
from citesight.llm.common import stage


def check_stages(spark, docs):
    """Every stage on what its predecessor kept, against brute force on the same rows."""
    docs = stage(docs, "test")
    cols = docs.columns
    steps = dict(P.STAGES)
    assert list(steps) == ["toxicity", "simhash", "chunk_dedup", "decontaminate", "packing"]

    def step(name):
        out = stage(steps[name](spark, docs, SF), "test")
        assert name == "packing" or out.columns == cols
        return out

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = step("toxicity")
    marks = toxicity.toxicity(docs, labels).where("predicted = 0").select("doc_id").collect()
    assert sorted(map(repr, marks)) == sorted(map(repr, clean.select("doc_id").collect()))

    docs = clean
    single = step("simhash")
    groups = test_simhash.brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(repr(r.doc_id) for r in single.collect()) == sorted({repr(g[2]) for g in groups})

    docs = stage(single.coalesce(1), "test")
    cut = step("chunk_dedup")
    assert sorted(map(repr, (r.text for r in cut.collect()))) == sorted(
        map(repr, test_chunk_dedup.brute([r.text for r in docs.collect()])))

    docs = cut
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = step("decontaminate")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = [(d, t) for d, t in rows if not test_decontaminate.brute([(d, t)], items)[0][5]]
    assert rows_of(kept, "doc_id", "text") == sorted(want, key=repr)

    docs = kept
    packed = step("packing")
    whole = Tokenizer.from_file(test_packing.PATH)
    texts = [r.text or "" for r in docs.collect()]
    tokens = sum(len(e.ids) + 1 for e in whole.encode_batch(texts, add_special_tokens=False))
    assert sum(r.length for r in packed.collect()) == tokens


def test_generated_table(spark):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    check_stages(spark, docs_of(spark, ODD, CLASHING))


def test_run_and_empty(spark):
    assert P.run(spark, SF).count() > 100 and P.ORACLE_SQL is None
    docs = empty_docs(spark)
    for _, step in P.STAGES:
        docs = stage(step(spark, docs, SF), "test")
    assert docs.count() == 0
