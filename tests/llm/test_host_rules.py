import math
import re
from collections import Counter

from data import CLASHING, ODD, SF, docs_of, empty_docs, rows_of

from citesight.llm import host_rules as H


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {p for i, g in enumerate(grams) if many[g] > 1 for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep,
            n < 50 or 100 * rep > 50 * n)


def judged(hosts, n):
    """Hosts (docs, failed) whose shrunk rate is an outlier, one rule."""
    rates = {s: f / d for s, (d, f) in hosts.items()}
    mean = sum(rates.values()) / len(rates)
    var = sum((r - mean) ** 2 for r in rates.values()) / len(rates)
    k = max(mean * (1 - mean) / var - 1, 0) if var > 0 else H.EQUAL_HOSTS_STRENGTH
    cut = round(min(mean + H.OUTLIER * math.sqrt(mean * (1 - mean) / (k + 1)), H.MAX_RATE), 9)
    return {s for s, (d, f) in hosts.items() if round((f + mean * k) / (d + k), 9) > cut}


def brute(rows):
    base = [counts(t) for _, t, _ in rows]
    docs = Counter(s for *_, s in rows)
    bad = set()
    for fails in ([b[0] < 50 for b in base], [100 * b[4] > 50 * b[0] for b in base]):
        failed = Counter(s for (*_, s), f in zip(rows, fails) if f)
        bad |= judged({s: (docs[s], failed[s]) for s in docs}, len(docs))
    return sorted(((i, *b, not b[5] and s not in bad) for (i, _, s), b in zip(rows, base)), key=repr)


def check(df):
    assert rows_of(H.host_rules(df)) == brute([tuple(r) for r in df.select("doc_id", "text", "source").collect()])


def test_generated_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    more = [(30 + i, "a b c " * i + "\nline # one\nline # one\n<x>|\n") for i in range(40)]
    more += [(90 + i, " ".join(f"u{i}v{k}" for k in range(80))) for i in range(30)]
    check(docs_of(spark, ODD + more, CLASHING))


def test_one_host_and_empty(spark):
    check(docs_of(spark, [(i, " ".join(f"u{k}" for k in range(60 if i % 5 else 3))) for i in range(20)])
          .withColumn("source", H.F.lit("one")))
    assert H.host_rules(empty_docs(spark)).count() == 0


def test_planted_bad_host_is_rejected_and_others_kept(spark):
    good, short = " ".join(f"u{k}" for k in range(60)), "too short"
    rows = [(i, short if i % 10 == 0 else good, f"h{i // 100}") for i in range(1500)]
    rows += [(5000 + i, short if i % 5 < 2 else good, "spam") for i in range(100)]  # 40 %, below max_rate
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = H.host_rules(df).join(df, "doc_id").collect()
    assert all(r.kept == (not r.base_failed and r.source != "spam") for r in out)
    assert sum(r.kept for r in out) == 1350
    rates = {r.host: r for r in H.host_rates(H.text_counts(df.withColumn("host", df.source), ["host"]).selectExpr(
        "host", "n_words < 50 as fails_short", "false as fails_repeats")).collect()}
    assert rates["spam"].rejected and rates["spam"].failed_short == 40 and not rates["h3"].rejected


def test_words_of_windows_are_compared(spark, monkeypatch):
    # with a hash that makes all windows equal, neighbours still count by their words
    text = " ".join(f"w{k}" for k in range(40)) + " a b c a b c"
    monkeypatch.setattr(H.F, "xxhash64", lambda *a: H.F.lit(7).cast("long"))
    got = H.text_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert got.n_repeat_words <= 6
