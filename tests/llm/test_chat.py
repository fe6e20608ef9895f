"""Chat formatting: round trips of texts full of control strings, the loss mask, and rows out of the ordinary."""

import random

import pytest
from pyspark.sql import functions as F

from duoscope.llm import chat


def test_round_trip_and_mask(spark):
    rng = random.Random(1)
    parts = ["\\", "#", "<", "### ", "</turn>", "\n", ": ", "é", "😀", "a", " ", "### Assistant: "]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys:tem#", "\\"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    done = chat.format_conversations(df)
    got = {r.conv_id: r for r in done.select("*", chat.read_back(F.col("formatted"), F.col("loss")).alias("r")).collect()}
    for c in range(30):
        mine = sorted(r for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in got[c].r.turns] == [(r[2], r[3]) for r in mine]
        assert got[c].r.trained == "".join(r[3] for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and len(got[c].loss) == sum(r[2] == "assistant" for r in mine)


def test_rows_out_of_the_ordinary(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (2, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].formatted == "### : x </turn>\n### user:  </turn>\n### user:  </turn>\n" and got[1].loss == []
    assert got[None].formatted == "### assistant: y </turn>\n" and [(s.start, s.stop) for s in got[None].loss] == [(15, 16)]
    assert [(s.start, s.stop) for s in got[2].loss] == [(15, 15)]
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_other_text_is_refused():
    with pytest.raises(ValueError, match="code point 0"):
        chat.parse("hello")
