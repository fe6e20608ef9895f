"""Steps that are taken for a share of the requests at a time."""

from pyspark.sql import functions as F

from duoscope.plans import reports
from duoscope.plans.registry import Tables
from duoscope.sources import scratch


def test_tables_of_a_turn_are_deleted_when_its_rows_are_written(spark):
    before = list(scratch.OPEN)
    alive = []

    def work(i):
        alive.append([path for _, path, _ in scratch.OPEN if "/units-" in path])
        units = scratch.kept(spark.range(10).withColumn("turn", F.lit(i)), "units")
        return units.groupBy("turn").count()

    done = scratch.in_turns(3, work, "sums")
    assert alive == [[], [], []]
    assert sorted((r.turn, r["count"]) for r in done.collect()) == [(0, 10), (1, 10), (2, 10)]
    assert len([e for e in scratch.OPEN if e not in before]) == 3  # the rows themselves
    scratch.release()


def test_every_request_has_one_turn(spark, monkeypatch):
    monkeypatch.setattr(reports, "TURN_LINES", 2000)  # of 6,000
    t, turns = Tables(spark, "/root/testdata/sf0.001"), []

    def work(names, shown):
        turns.append(1)
        return names.select("request").distinct().join(shown.groupBy("request").agg(F.countDistinct("a", "b").alias("pairs")), "request", "left")

    rows = reports.by_turns(t, work, "rows").collect()
    asked = {r.request: len(r.names) for r in reports.asked_sets(t).collect()}
    assert len(turns) > 1 and len(rows) == len(asked)
    assert {r.request: r.pairs or 0 for r in rows} == {k: n * (n - 1) // 2 for k, n in asked.items()}
    scratch.release()
