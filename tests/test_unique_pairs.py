"""Pairs of a request's distinct names are different already: they are not told apart once more in memory."""

import re

from duoscope.operators import pairs
from duoscope.plans import QUERIES


def test_planned_pairs_are_not_aggregated(spark):
    done = QUERIES["no_data_partition"](spark, "/root/testdata/sf0.001")
    plan = re.sub(r"#\d+L?", "", done._jdf.queryExecution().executedPlan().toString())
    assert "keys=[request" in plan and "keys=[request, a, b" not in plan
    assert done.count() == done.select("request").distinct().count()


def test_pairs_planned_twice_are_told_apart(spark):
    planned = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "a", "c")], "request long, a string, b string")
    recs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert sorted(map(tuple, pairs.partition(planned, recs).collect())) == [(1, "a", "b", True), (1, "a", "c", False)]
    assert pairs.partition(planned.distinct(), recs, unique=True).count() == 2
