"""License scan: Aho-Corasick over tags and notice phrases, shunting-yard over license expressions.

Two automata read each text once. One runs over the text's words joined by
single blanks and finds phrases as whole words (overlapping ones too): the
base phrases and longer notices that name a license more closely. The other
runs over the lower-cased text and finds identifier tags; what follows a tag
on its line is read as a license expression.

An expression is taken as far as it goes: license ids (of the list below,
with an optional ``+``, or ``licenseref-...``), ``with`` and an exception id,
``and``, ``or`` (binding in this order) and parentheses; the first word that
cannot continue it ends it, and an operator left over is dropped. The
shunting-yard algorithm evaluates operators as they leave its stack, to the
ids named and whether one can comply with permissive ids alone (``or``: either
side, ``and``: both). An expression without an id or with a parenthesis left
open is malformed and adds nothing but its place in ``n_tags``.

Score: each label counts by its strongest evidence (base phrase 0.6, notice
0.8, tag 0.95) as an independent chance; the score is the chance that one of
them holds, 0 without labels.

Lower-casing touches A-Z only; words are runs of digits, letters a-z and
anything beyond ASCII. Cases: null and empty texts have no words, no labels
and score 0; repeated rows give a row each; texts are read whole, a task holds
slices of bounded bytes or one longer text; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from citesight.llm.hashing import bounded
from citesight.session import ship_package

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases, in words, and the license that each names.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc0 1 0": "cc0-1.0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}
TAGS = ("spdx-license-identifier:", "license-identifier:", "licence-identifier:")
#: License ids that expressions may name, and whether each is permissive.
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit",
              "unlicense", "zlib")
RECIPROCAL = ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "cc-by-nc-4.0", "cc-by-sa-4.0", "epl-2.0", "gpl-2.0",
              "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1",
              "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "mpl-2.0")
BINDS = {"or": 1, "and": 2, "with": 3}
P_BASE, P_NOTICE, P_TAG = 0.6, 0.8, 0.95

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:\-]*)")

Value = tuple[frozenset, bool]


def license_id(token: str) -> bool:
    plain = token.removesuffix("+")
    return plain in PERMISSIVE or plain in RECIPROCAL or plain.startswith("licenseref-")


def tokens(text: str, at: int) -> Iterator[str]:
    """Parentheses and words of one line from ``at`` on."""
    while m := TOKEN.match(text, at):
        yield m[1].rstrip(".:") if m[1] not in "()" else m[1]
        at = m.end()


def evaluate(words: Iterator[str]) -> Value | None:
    """Ids and permissiveness of the longest expression that ``words`` begin with; None if malformed."""
    values: list[Value] = []
    ops: list[str] = []

    def reduce() -> None:
        op, (right, free_r), (left, free_l) = ops.pop(), values.pop(), values.pop()
        if op == "with":
            values.append((frozenset(f"{x} with {y}" for x in left for y in right), free_l))
        else:
            values.append((left | right, (free_l or free_r) if op == "or" else (free_l and free_r)))

    operand = True  # what may come next
    for w in words:
        after_with = operand and bool(ops) and ops[-1] == "with"
        if operand and after_with and re.search("exception", w):
            values.append((frozenset([w]), True))
            operand = False
        elif operand and not after_with and license_id(w):
            values.append((frozenset([w]), w.removesuffix("+") in PERMISSIVE))
            operand, single = False, True
        elif operand and not after_with and w == "(":
            ops.append(w)
        elif not operand and w == ")" and "(" in ops:
            while ops[-1] != "(":
                reduce()
            ops.pop()
            single = False
        elif not operand and w in BINDS and (w != "with" or (single and not (ops and ops[-1] == "with"))):
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[w]:
                reduce()
            ops.append(w)
            operand, single = True, False
        else:
            break
    if operand and ops and ops[-1] != "(":
        ops.pop()
    while ops and ops[-1] != "(":
        reduce()
    return values[0] if len(values) == 1 and not ops else None


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES]:
        words.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, permissive) of one text."""
    by_words, by_tags = automata()
    low = text.translate(LOWER)
    words = WORD.findall(low)
    starts, labels = [], {}
    stream = f" {' '.join(words)} "
    for end, phrase in by_words.iter(stream):
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)  # of the blank before it
            labels[BASE[phrase]] = max(labels.get(BASE[phrase], 0), P_BASE)
        if phrase in NOTICES:
            labels[NOTICES[phrase]] = max(labels.get(NOTICES[phrase], 0), P_NOTICE)
    base = sorted({BASE[p] for p in BASE if BASE[p] in labels and f" {p} " in stream}) if starts else []
    free, places = None, sorted({end + 1 for end, _ in by_tags.iter(low)})
    for at in places:
        if found := evaluate(tokens(low, at)):
            labels |= dict.fromkeys(found[0], P_TAG)
            free = found[1] if free is None else free and found[1]
    miss = 1.0
    for name in sorted(labels):
        miss *= 1.0 - labels[name]
    ends = [stream.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    return (len(words), len(starts), *ends, ",".join(base), ",".join(sorted(labels)), round(1.0 - miss, 9), len(places), free)


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, permissive) per document."""
    ship_package(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"], *[StructField(n, t) for n, t in (
        ("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()),
        ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType()), ("n_tags", LongType()),
        ("permissive", BooleanType()))]])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = [scan(t or "") for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)
