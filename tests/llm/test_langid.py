"""Language identification: held-out accuracy, what each kind of evidence decides, and rows out of the ordinary."""

import random

import pytest
from pyspark.sql import functions as F

from duoscope.llm import langid

SYLLABLES = {"aa": ["the", "ing", "and", "sh"], "bb": ["eau", "oux", "ment", "é"], "cc": ["sch", "ung", "ü", "heit"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = "aabbcc"[i % 3 * 2 :][:2]
        declared = lang if i < 240 and i % 20 else rng.choice(["aa", "bb", "cc", None])
        rows.append((i, lang, text(rng, lang), declared, f"h{i % 3}"))
    rows += [(900, None, "12 34", "aa", "h0"), (901, None, None, None, None), (902, "bb", "x", "bb", "h1"), (903, None, "", "zz", "new")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, true string, text string, lang string, host string, n int")
    got = langid.identify(df, F.col("text"), declared=F.col("lang"), host=F.col("host"))
    return {r.id: r for r in got.collect()}


def test_held_out_accuracy(found):
    held_out = [r for i, r in found.items() if 240 <= i < 300]
    assert sum(r.language.lang == r.true for r in held_out) >= 0.98 * len(held_out)


def test_clean_rows_stay_and_empty_ones_go(found):
    assert all(found[i].language.keep for i in range(300))
    assert not any(found[i].language.keep for i in (900, 901, 903)) and found[901].language.text_lang is None


def test_a_short_text_follows_declaration_and_host(found):
    assert found[902].language.lang == "bb" and found[902].n == 0


def test_nothing_declared_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None)], "id long, text string, lang string")
    r = langid.identify(df, F.col("text"), declared=F.col("lang")).collect()[0]
    assert r.language.lang is None and not r.language.keep
    assert langid.identify(df.limit(0), F.col("text"), declared=F.col("lang")).collect() == []


def test_one_language_and_a_shuffled_host_table(spark, monkeypatch):
    monkeypatch.setattr(langid, "HOSTS", 0)
    df = spark.createDataFrame([(1, "some text", "aa", "h", "h.net", "net"), (1, "some text", "aa", "h", "h.net", "net")], "id long, text string, lang string, host string, domain string, suffix string")
    got = langid.identify(df, F.col("text"), F.col("lang"), F.col("host"), F.col("domain"), F.col("suffix")).collect()
    assert [(r.language.lang, r.language.posterior) for r in got] == [("aa", 1.0)] * 2


def test_more_than_64_languages_and_declarations_of_one_language(spark):
    rng = random.Random(2)
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopq"]
    own = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(4)] for n in names}
    rows = [(n, " ".join(rng.choice(own[n]) for _ in range(30)), d) for i, n in enumerate(names) for d in [n, n.upper(), f"{n}-US"][: 1 + 2 * (i < 69)]]
    df = spark.createDataFrame(rows, "true string, text string, lang string")
    got = langid.identify(df, F.col("text"), declared=F.col("lang")).collect()
    assert len(names) == 70 and [(r.language.lang, r.language.keep) for r in got] == [(r.true, True) for r in got]


def test_the_count_of_every_suffix_is_used(spark):
    rng = random.Random(3)
    rows = [(0, text(rng, lang), lang, f"{lang}{i // 3}") for i in range(1800) for lang in ("aa", "bb")]
    # without words of its own, a text follows its suffix, be it one of the rarest
    rows += [(1, text(rng, "bb"), "bb", "zz")] * 2 + [(2, "qqq", None, "zz")]
    df = spark.createDataFrame(rows, "id int, text string, lang string, suffix string")
    got = langid.identify(df, F.col("text"), declared=F.col("lang"), suffix=F.col("suffix")).where("id = 2").collect()[0]
    assert got.language.lang == "bb"


def test_a_share_is_right_at_any_count():
    for count in (1, 1999, 2000, 2001, 3 * 10**9, 10**13):
        share = langid.share_of(2000, count)
        assert 0 < share <= 1 << 62 and abs(share / (1 << 62) * count - min(count, 2000)) < 1
