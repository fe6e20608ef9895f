"""Lines of a pair are the same in every report that has the pair: they are made and read once."""

import re

from pyspark.sql import functions as F

from duoscope.operators import document, report
from duoscope.plans import reports, trajectories
from duoscope.plans.registry import Tables
from duoscope.sources import scratch

RECORDS = [("a", "b", "AF", 3, 7, "CURATED", "Major"), ("a", "b", "RF", 9, 9, "SIGNAL", "Unknown"), ("a", "b", "NF", 5, 5, "SIGNAL", "Unknown"), ("a", "b", "NO", 2, 1, "SIGNAL", "Unknown")]
KIND = "a string, b string, event string, reports long, lines long, source string, severity string"


def test_citations_of_a_pair_are_those_of_its_lines(spark):
    recs = spark.createDataFrame(RECORDS, KIND)
    texts = {r.section: r.text.split("\n") for r in reports.pair_texts(recs).collect()}
    assert sorted(texts) == [1, 5] and len(texts[1]) == 1 and [x.split("**: ")[1].split(" [")[0] for x in texts[5]] == ["RF: 9 co-reports", "NF: 5 co-reports", "+1 more not shown"]
    ids = {r.event: r.id for r in recs.select("event", report.record_id().alias("id")).collect()}
    assert sorted((r.source, r.record) for r in reports.pair_citations(recs).collect()) == sorted([("CURATED", ids["AF"]), ("SIGNAL", ids["RF"]), ("SIGNAL", ids["NF"])])


def test_citations_of_requests(spark):
    asked = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (2, "a", "c"), (3, "a [X:y1]", "c"), (4, "a [none]", "c")], "request long, a string, b string")
    read = spark.createDataFrame([("a", "b", "SIGNAL", 2, "s1"), ("a", "b", "CURATED", 1, "c1")], "a string, b string, source string, n long, least string")
    rows = sorted(tuple(r) for r in reports.cited(asked, read).collect())
    assert rows == [(1, "CURATED", 1, "c1"), (1, "SIGNAL", 2, "s1"), (2, "CURATED", 1, "c1"), (2, "SIGNAL", 2, "s1"), (3, "X", 1, "y1")]


def test_lines_of_a_section_are_counted_in_short_texts(spark):
    made = spark.createDataFrame([("p", "## Major findings\n- **a + b**: x [CURATED:1]\n\n- **a + c**: y"), ("q", "## No curated data\n- a + b")], "report string, text string")
    assert sorted(map(tuple, reports.sections_read(made).collect())) == [("p", "major", 2), ("q", "no_data", 1)]


def test_pieces_of_some_parts_only(spark):
    found = spark.createDataFrame([(1, "a", "b", None, None, None, None, None, 1, 0, False, True)], "request long, a string, b string, source string, severity string, event string, reports long, x string, position int, hidden long, last boolean, head boolean")
    names = spark.createDataFrame([(1, "a"), (1, "b")], "request long, name string")
    none = spark.createDataFrame([], f"request bigint, entries {document.ENTRY}, notices {document.NOTICE}")
    rows = document.pieces(document.document(report.gather(names, found), none), document.PAIRED).collect()
    assert [(r.part, r.a, r.b) for r in rows] == [("no_data", "a", "b")]


def test_items_are_written_without_the_rest_of_the_report(spark):
    rows = spark.range(1).select(F.expr("array(named_struct('a', 'x', 'b', 'y', 'place', 1, 'source', 'CURATED', 'severity', 'Major', 'event', 'AF', 'reports', 2L, 'record_id', 'i', 'head', true))").alias("items"))
    assert rows.select(F.to_json(report.cited_items()).alias("j")).first().j == '[{"a":"x","b":"y","place":1,"source":"CURATED","severity":"Major","event":"AF","reports":2,"record_id":"i"}]'


def test_pairs_of_runs_are_not_dealt_by_a_name(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trajectories.checked(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        scratch.release()
    assert not re.search(r"hashpartitioning\((?:run|request)#\d+L?, [ab]#\d+, \d+\)", plan)
