"""Whole reports as data: pieces of a small report, requests of one side only, placeholders, lookups that fail, covering parts."""

import pytest
from pyspark.sql import functions as F

from duoscope.functions.lexicon import placeholder
from duoscope.operators import document, pairs, report

RECORDS = "a string, b string, event string, reports long, source string, severity string"


def made(spark, records, names, entries):
    named = spark.createDataFrame(names, "request long, name string")
    found = pairs.review(pairs.plan(named), spark.createDataFrame(records, RECORDS), F.col("source") == "SIGNAL", [F.desc("reports"), F.col("event")], shown=2)
    lines = report.entry_lines(spark.createDataFrame(entries, "request long, place long, query string, method string, canonical string, kind string, note string"))
    return document.document(report.gather(named, found), document.entry_lists(lines, report.entry_notices(lines))), found, named


RECORD = [
    ("aa", "bb", "bleeding", 9, "CURATED", "Minor"), ("aa", "bb", "Drug  Interaction", 8, "CURATED", "Major"), ("aa", "bb", "rash", 7, "SIGNAL", None),
    ("aa", "bb", "itch", 6, "SIGNAL", None), ("aa", "bb", "cough", 5, "SIGNAL", None), ("aa", "cc", "fever", 4, "CURATED", "Unknown"),
]
NAMES = [(1, "aa"), (1, "bb"), (1, "cc"), (2, "aa"), (2, "bb"), (4, "zz")]
ENTRIES = [(1, 1, " AA ", "exact", "aa", None, None), (1, 2, "brand", "exact", "aa", "RXNORM:BN", None), (1, 3, "bbb", "fuzzy", "bb", None, None), (1, 4, "cc", "exact", "cc", None, None), (1, 5, "what", "none", None, None, None), (1, 6, "combo", "combination", None, None, "several"), (2, 1, "aa", "exact", "aa", None, None), (2, 2, "bb", "exact", "bb", None, None), (3, 1, None, "none", None, None, "")]


def test_document(spark):
    docs, found, named = made(spark, RECORD, NAMES, ENTRIES)
    rows = {r.request: r.document for r in docs.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    one = rows[1]
    assert [(f.severity, f.event) for f in one.findings] == [("Major", None), ("Minor", "bleeding")]
    assert [(f.a, f.b, f.severity, f.event) for f in one.ungraded] == [("aa", "cc", "not graded", "fever")]
    assert [(s.event, s.reports) for s in one.signals] == [("rash", 7), ("itch", 6)]
    assert [(h.a, h.b, h["count"], h.after, h.line) for h in one.hidden] == [("aa", "bb", 1, 2, "**aa + bb**: +1 more not shown")]
    assert [(n.a, n.b) for n in one.no_data] == [("bb", "cc")] and one.covered is None
    assert [(u.input, u.reason) for u in one.unresolved] == [("what", None), ("combo", "several")]
    assert [e.status for e in one.entries] == ["recognized", "recognized", "spelling_match", "recognized", "unresolved", "combination"]
    assert [(n.drug, n.inputs) for n in one.notices] == [("aa", ["AA", "brand"])]
    s = one.summary
    assert (s.names, s.pairs, s.graded.Major, s.graded.Moderate, s.graded.Minor, s.ungraded, s.signals, s.hidden, s.unresolved, s.no_data) == (3, 3, 1, 0, 1, 1, 2, 1, 2, 1)
    assert rows[2].covered == document.COVERED and not rows[2].unresolved
    assert rows[3].summary.names == 0 and [u.input for u in rows[3].unresolved] == [""] and not rows[3].findings  # entries only
    assert rows[4].entries == [] and rows[4].summary.pairs == 0 and rows[4].covered == document.COVERED  # names only
    # every line of the data stands in the text
    text = {r.request: r.text.split("\n") for r in report.render(report.gather(named, found)).collect()}
    for request in (1, 2):
        for x in [*rows[request].findings, *rows[request].ungraded, *rows[request].signals, *rows[request].hidden, *rows[request].no_data]:
            assert "- " + x.line in text[request]
    assert any(line.endswith("severity Major [CURATED:" + one.findings[0].record_id + "]") for line in text[1])


def test_every_pair_has_one_cell_and_the_parts_cover_the_plan(spark):
    docs, found, named = made(spark, RECORD, NAMES, ENTRIES)
    cells = document.cell_links(document.pieces(docs)).collect()
    assert {(c.request, c.a, c.b): (c.status, c.part, c.place) for c in cells} == {
        (1, "aa", "bb"): ("Major", "findings", 0), (1, "aa", "cc"): ("not graded", "ungraded", 0), (1, "bb", "cc"): ("no curated data", "no_data", 0), (2, "aa", "bb"): ("Major", "findings", 0),
    }
    planned = pairs.plan(named)
    parts = pairs.partition(planned, spark.createDataFrame(RECORD, RECORDS))
    known, gaps = parts.where("has_records").drop("has_records"), parts.where("NOT has_records").drop("has_records")
    assert known.intersect(gaps).count() == 0 and known.unionAll(gaps).exceptAll(planned).count() == planned.exceptAll(known.unionAll(gaps)).count() == 0
    assert len(cells) == planned.count()


def test_empty_tables(spark):
    docs, _, _ = made(spark, [], [], [])
    assert docs.collect() == [] and document.cell_links(document.pieces(docs)).collect() == []


@pytest.mark.parametrize(("event", "wanted"), [(None, True), ("", True), (" Adverse  Events ", True), ("interaction", True), ("interaction of note", False), ("rash", False)])
def test_placeholder(spark, event, wanted):
    assert spark.createDataFrame([(event,)], "e string").select(placeholder(F.col("e"))).first()[0] is wanted


def test_lookups(spark):
    gaps = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (1, "c", "d"), (1, "a", "b"), (2, "a", "c"), (3, "b", "c"), (4, "x", "y")], "request long, a string, b string")
    found = spark.createDataFrame([("a", "b", "rash: 3 reports", 1, 1, None), ("a", "c", "", 0, 0, "timeout"), ("b", "c", "", 0, 1, None), ("c", "d", "itch: 1 report", 1, 0, None)], "a string, b string, lines string, surfaced long, suppressed long, error string")
    looked = document.looked_up(gaps, found, 3)
    assert sorted((r.request, r.a, r.b, r.surfaced, r.suppressed, r.failed) for r in looked.collect()) == [
        (1, "a", "b", 1, 1, False), (1, "a", "c", 0, 0, True), (1, "b", "c", 0, 1, False), (1, "c", "d", 0, 0, True), (2, "a", "c", 0, 0, True), (3, "b", "c", 0, 1, False), (4, "x", "y", 0, 0, False),
    ]
    done = {r.request: (r.pairs, r.surfaced, r.suppressed, r.failed, r.text, r.note) for r in document.spontaneous(looked).collect()}
    assert done == {
        1: (1, 1, 2, 2, "- **a + b**: rash: 3 reports", "2 co-reported events suppressed. 2 pairs not looked up; nothing is known of them."),
        2: (0, 0, 0, 1, "", "1 pair not looked up; nothing is known of it."),
        3: (0, 0, 1, 0, "", "1 co-reported event suppressed."),
    }
    assert all(r.failed is not None for r in document.looked_up(gaps, found.drop("error"), 9).collect())
