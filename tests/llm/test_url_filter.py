import re

from data import SF, rows_of

from citesight.llm import url_filter as U


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(h, p):
    fits = [(r, v) for rh, rp, v in U.RULES for r in [rh + rp] if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


ODD = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM"), (5, "http://a.example.com/en/x?y://z#q"),
       (6, "http://www.example.com/en/"), (7, "http://x.www.example.com/en/1"), (8, "ftp://net/es/"), (8, "ftp://net/es/"),
       (9, "http://planet/es/"), (10, "http://h.net?/es/"), (None, "http://q.org/é/日本"), (11, "://"),
       (12, "http://long.org/" + "a" * 50_000)]


def test_hosts_paths_and_rules(spark):
    got = U.url_filter(spark.createDataFrame([(i, u, 1) for i, u in ODD], "page_id long, url string, rule int"))
    want = sorted(((i, *parts(u), rule(*parts(u))[0]) for i, u in ODD), key=repr)
    assert rows_of(got, "page_id", "host", "path", "rule") == want
    for r in got.collect():
        assert r.verdict == (rule(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block")


def test_model_separates_what_the_rules_teach(spark):
    rows = [(i, f"http://a{i % 7}.com/en/{i}") for i in range(200)] + [(1000 + i, f"http://b{i % 5}.net/fr/{i}") for i in range(200)]
    rows += [(5000, "http://z.org/en/17"), (5001, "http://b3.org/fr/23")]
    got = {r.page_id: r for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000].rule is None and got[5000].verdict == "allow"
    assert got[5001].rule is None and got[5001].verdict == "block"


def test_no_examples_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in U.url_filter(pages).collect()] == ["allow", "allow"]
    assert U.url_filter(pages.where("false")).count() == 0
    assert U.url_filter(spark.read.parquet(f"{SF}/pages.parquet")).where("verdict is null").count() == 0
