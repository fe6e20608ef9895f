"""Pairs of many requests: how they are dealt over tasks, and records that are selected once for all requests."""

from pyspark.sql import functions as F

from duoscope.operators import pairs


def test_requests_are_dealt_by_what_their_pairs_take(spark):
    """Spark joins small partitions before the pairs are made, which take many times the room of the names."""
    names = spark.range(3000).select((F.col("id") % 300).alias("request"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    made = pairs.of_names(pairs.name_sets(names, tasks=24))
    used = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(used) == 24 and sum(r["count"] for r in used) == 300 * 45


def test_records_meet_a_pair_once_for_each_request(spark):
    asked = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (2, "a", "c")], "request long, a string, b string")
    records = spark.createDataFrame([("a", "b", "x", 3), ("a", "b", "y", 5), ("d", "e", "z", 1)], "a string, b string, event string, n long")
    rows = lambda df: sorted((r.request, r.b, r.event or "", r.n or 0) for r in df.collect())
    both = [(1, "b", "x", 3), (1, "b", "y", 5), (2, "b", "x", 3), (2, "b", "y", 5)]
    assert rows(pairs.lookup(asked, records)) == both
    assert rows(pairs.lookup(asked, records, "left")) == both + [(2, "c", "", 0)]
    seen = pairs.review(asked, records, F.lit(True), [F.desc("n")], shown=1).orderBy("request", "b").collect()
    assert [(r.request, r.b, r.event, r.position, r.hidden, r["last"], r.head) for r in seen] == [(1, "b", "y", 1, 1, True, True), (2, "b", "y", 1, 1, True, True), (2, "c", None, 1, 0, False, True)]
