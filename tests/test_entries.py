"""How entries of a report were read, in words."""

from duoscope.operators import report

KINDS = "request long, place int, query string, method string, canonical string, kind string, note string"


def test_lines_and_notices(spark):
    rows = [
        (1, 0, " Aa ", "exact", "aa", "RXNORM:IN", None), (1, 1, "Brandy", "exact", "aa", "RXNORM:BN", None), (1, 2, "odd", "exact", "bb", None, None), (1, 3, "aaa", "fuzzy", "aa", None, None),
        (1, 4, "duo", "combination", None, None, "two; enter them"), (1, 5, "ins", "ambiguous", None, None, None), (1, 6, "zz", "unresolved", None, None, None), (1, 7, None, "unresolved", None, None, "empty input"), (1, 8, "q", "unresolved", "", None, ""),
        (2, 0, "x", "exact", "cc", "MTHSPL:SU", None), (2, 1, "CC", "exact", "cc", None, None), (3, 0, "zz", "unresolved", None, None, None), (3, 1, "zz", "unresolved", None, None, None),
    ]
    lines = report.entry_lines(spark.createDataFrame(rows, KINDS))
    got = {(r.request, r.place): (r.status, r.how, r.line) for r in lines.collect()}
    assert got[1, 0] == ("recognized", None, "Aa → aa") and got[1, 1] == ("recognized", "brand name", "Brandy → aa (brand name)") and got[1, 2] == ("recognized", "alias", "odd → bb (alias)")
    assert got[1, 3] == ("spelling_match", None, "aaa → aa (spelling match: check this)") and got[1, 4] == ("combination", None, "duo → not analysed: two; enter them") and got[1, 5] == ("ambiguous", None, "ins → not analysed: ")
    assert got[1, 6] == ("unresolved", None, "zz → " + report.UNKNOWN) and got[1, 7] == ("unresolved", None, " → not recognized: empty input") and got[1, 8][2] == "q → " + report.UNKNOWN
    notices = {(r.request, r.canonical): r.text for r in report.entry_notices(lines).collect()}
    assert notices == {
        (1, "aa"): "**Same drug entered more than once:** Aa, Brandy and aaa all mean aa (possible duplicate therapy). It is analysed once.",
        (2, "cc"): "**Same drug entered more than once:** x and CC both mean cc (possible duplicate therapy). It is analysed once.",
    }
    assert report.entry_notices(lines.where("false")).count() == 0
