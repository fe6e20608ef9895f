"""Terms in texts: letters of other alphabets, numbers that two forms share, and how long a pattern takes."""

import time

import pytest
from pyspark.sql import functions as F

from duoscope.functions import lexicon as lx


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_safe_wording_is_searched_for_before_what_denies_it(spark):
    """The look-behind once ran at every place of a text; now only where "safe" stands."""
    rows = spark.range(64, numPartitions=1).select(F.concat(F.repeat(F.lit("nor was it, "), 4000), F.lit("safe.")).alias("t"))
    began = time.monotonic()
    assert {r.x for r in rows.select(lx.says_safe(F.col("t")).alias("x")).collect()} == {None}
    assert time.monotonic() - began < 6
    assert one(spark, "it is not at all safe; yet safely used", lx.says_safe) == "safely"


def test_numbers_of_two_forms_may_share_a_word(spark):
    assert one(spark, "after 4 co-reports: 1,250 among", lambda t: lx.counts(t, *lx.CO_REPORTS)) == [4, 1250]


@pytest.mark.parametrize("text, column, found", [
    ("phéno severity", lx.severity_words, []),  # "no severity", as where \w is ASCII only
    ("éminor", lx.severity_words, ["minor"]),
    ("ésafe", lx.says_safe, "safe"),
    ("x_minor minors", lx.severity_words, []),
])
def test_bounds_of_words_are_those_of_ascii(spark, text, column, found):
    assert one(spark, text, column) == found
