import random

from data import SF

from citesight.llm import chat as C
from citesight.llm import queries


def ev(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string")


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [(1, 0, "message", "a", "user", "Hi"), (1, 5, "edit", "a", "user", "Hello"), (1, 6, "delta", "a", None, "!"),
            (1, 1, "message", "b", "assistant", None), (1, 2, "delta", "b", None, "wr"), (1, 3, "delta", "b", None, "ong"),
            (1, 4, "regenerate", "b", None, None), (1, 7, "delta", "b", None, "rig"), (1, 8, "delta", "b", None, "ht"),
            (2, 9, "delta", "z", "tool", "lone"), (2, 9, "delta", "z", "tool", "lone"), (None, 0, "message", "n", None, "x")]
    got = sorted((repr(r.conv_id), r.seq, r.role, r.text) for r in C.fold(ev(spark, rows)).collect())
    assert got == [("1", 0, "user", "Hello!"), ("1", 1, "assistant", "right"), ("2", 9, "tool", "lonelone"), ("None", 0, None, "x")]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(6)
    bits = ["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "im_end|>", "im_start|>", "\n", "n", "é", "user", "<|im_end|>\n"]
    rows = [(c, s, "message", f"m{s}", rng.choice(["user", "assistant", "as\nsis\\n", "<|im_start|>", ""]),
             "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for c in range(60) for s in range(5)]
    done = C.read_back(C.chat(ev(spark, rows))).collect()
    for r in done:
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[4], x[5]) for x in own]
        assert r.loss == "".join(x[5] for x in own if x[4] == "assistant")
        assert r.formatted.count("<|") == 2 * len(own)


def test_long_and_empty(spark):
    long = "<|x " * 50_000
    done = C.read_back(C.chat(ev(spark, [(1, 0, "message", "m", "assistant", long)]))).first()
    assert done.turns[0].text == long == done.loss
    assert C.chat(ev(spark, [(1, 0, "message", "m", "u", "")]).where("false")).count() == 0


def test_query_adds_the_planted_conversation(spark):
    out = {r.conv_id: r for r in queries.op10(spark, SF).collect()}
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len("</s>[INST] ok [/INST]")
