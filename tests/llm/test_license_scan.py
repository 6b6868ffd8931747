import random
import re

import pytest
from data import CLASHING, ODD, SF, docs_of, empty_docs, rows_of

from citesight.llm import license_scan as L
from citesight.llm import queries


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def brute(text):
    """Base columns, and labels of texts without tags, by trying every phrase at every word."""
    w = words_of(text)
    base = {label: places(w, p) for p, label in L.BASE.items()}
    at = sorted(x for v in base.values() for x in v)
    names = {label for label, v in base.items() if v}
    more = {label: L.P_BASE for label in names}
    for p, label in L.NOTICES.items():
        if places(w, p):
            more[label] = L.P_NOTICE
    miss = 1.0
    for x in sorted(more):
        miss *= 1 - more[x]
    return (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(names)), ",".join(sorted(more)),
            round(1 - miss, 9))


def test_query_equals_brute_force_over_the_whole_table(spark):
    got = rows_of(queries.op12(spark, SF).drop("n_tags", "permissive"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == sorted(((d.doc_id, *brute(d.text)) for d in docs), key=repr)
    assert any(r[2] for r in got)


def test_odd_texts(spark):
    rows = ODD + [(20, "MIT License mit LICENSE"), (20, "MIT License mit LICENSE"), (21, "the MIT, License"), (22, "mit licenses"),
                  (23, "permit license"), (24, "x " * 30_000 + "General\nPublic--License"), (25, "İ MIT License"), (26, "mit\x00license"),
                  (27, "Licensed under the Apache License, Version 2.0."), (28, "Licensed under CC BY-NC 4.0."), (29, "mitélicense")]
    got = rows_of(L.license_scan(docs_of(spark, rows, CLASHING + ("labels", "n_base", "a.b"))).drop("n_tags", "permissive"))
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert L.license_scan(empty_docs(spark)).count() == 0


def parse(toks):
    """Independent recursive descent over a complete, well-formed expression."""
    def either():
        v = both()
        while toks and toks[0] == "or":
            toks.pop(0)
            r = both()
            v = (v[0] | r[0], v[1] or r[1])
        return v

    def both():
        v = one()
        while toks and toks[0] == "and":
            toks.pop(0)
            r = one()
            v = (v[0] | r[0], v[1] and r[1])
        return v

    def one():
        t = toks.pop(0)
        if t == "(":
            v = either()
            assert toks.pop(0) == ")"
            return v
        if toks[:1] == ["with"]:
            toks.pop(0)
            return frozenset([f"{t} with {toks.pop(0)}"]), t.removesuffix("+") in L.PERMISSIVE
        return frozenset([t]), t.removesuffix("+") in L.PERMISSIVE
    return either()


def expression(rng, deep):
    if deep == 0 or rng.random() < 0.3:
        x = rng.choice(["mit", "gpl-2.0+", "apache-2.0", "gpl-3.0-only", "licenseref-own", "isc"])
        return [x, "with", "classpath-exception-2.0"] if rng.random() < 0.2 else [x]
    inner = [*expression(rng, deep - 1), rng.choice(["and", "or"]), *expression(rng, deep - 1)]
    return ["(", *inner, ")"] if rng.random() < 0.5 else inner


def test_shunting_yard_against_recursive_descent():
    rng = random.Random(4)
    for _ in range(500):
        e = expression(rng, rng.randint(0, 5))
        assert L.evaluate(iter(e)) == parse(list(e))


@pytest.mark.parametrize("line, labels, free", [
    ("// SPDX-License-Identifier: MIT", "mit", True),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0-only) and ISC.\nnext", "gpl-2.0-only,isc,mit", True),
    ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */", "gpl-2.0+ with classpath-exception-2.0", False),
    ("SPDX-License-Identifier: MIT and this is prose", "mit", True),
    ("SPDX-License-Identifier: MIT AND\nGPL-3.0-only", "mit", True),
    ("SPDX-License-Identifier: (MIT OR ISC", "", None),
    ("SPDX-License-Identifier: nonsense", "", None),
    ("SPDX-License-Identifier: () MIT", "", None),
    ("SPDX-License-Identifier:", "", None),
])
def test_tags(line, labels, free):
    got = L.scan(line)
    assert got[5] == labels and got[7] == 1 and got[8] is free
    assert (got[6] > 0.9) == bool(labels)
