"""Faults for reports: a table of edits, each with the line it can be made at and the finding it must lead to.

lines() gives a report's lines as an array on its row; sites() the places at which a fault can be made, one row each;
injected() the text with that one fault. A checker that is right finds what `EXPECTED` says and nothing else, but for
what follows from a dropped line: a pair without a cited record is omitted too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import HEADINGS, TITLE, count_line, finalize, item_lines


@dataclass(frozen=True)
class Fault:
    """at: whether a line can have it (null: the report as a whole has); edit: what stands in the line's place."""

    code: str | None
    at: Callable[[Column], Column] | None
    edit: Callable[[Column], Column] | None = None


def _curated(x: Column) -> Column:
    return x["kind"].eqNullSafe("item") & (x["source"] == "CURATED")


def _signal(x: Column) -> Column:
    return x["kind"].eqNullSafe("item") & (x["source"] == "SIGNAL")


def _kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _before_citation(words: str) -> Callable[[Column], Column]:
    return lambda x: F.array(F.regexp_replace(x["line"], r" \[[^\[\]]*\]$", words + "$0"))


def _text(change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.array(change(x["line"]))


def _dropped(x: Column) -> Column:
    return F.array().cast("array<string>")


FLIPPED = "Minor"
FAULTS: dict[str, Fault] = {
    "clean": Fault(None, None),
    "mechanism": Fault("UNSUPPORTED_MECHANISM", _curated, _before_citation(" via CYP3A4 inhibition")),
    "severity": Fault("SEVERITY_MISMATCH", _curated, lambda x: F.array(F.regexp_replace(x["line"], "severity (Major|Moderate|Minor|not graded);", F.concat(F.lit("severity "), F.when(x["severity"] == "Major", FLIPPED).otherwise("Major"), F.lit(";"))))),
    "event": Fault("EVENT_MISATTRIBUTION", _curated, lambda x: F.array(F.replace(x["line"], F.concat(F.lit("; "), x["event"], F.lit(" [")), F.lit("; rhabdomyolysis [")))),
    "population": Fault("UNSUPPORTED_POPULATION", _curated, _before_citation(", particularly in elderly patients")),
    "uncited": Fault("UNCITED_CLAIM", _curated, lambda x: F.array(x["line"], F.regexp_replace(x["line"], r" \[[^\[\]]*\]$", ""))),
    "reports_as_curated": Fault("FAERS_AS_CURATED", _curated, lambda x: F.array(x["line"], F.concat(F.lit("- **"), x["a"], F.lit(" + "), x["b"], F.lit("**: "), x["event"], F.lit(": 7 reports [FAERS:f"), x["record_id"], F.lit("]")))),
    "phantom": Fault("PHANTOM_CITATION", lambda x: _curated(x) | _signal(x), _text(lambda t: F.concat(t, F.lit(" [CURATED:x0]")))),
    "misattributed": Fault("MISATTRIBUTED_CITATION", lambda x: _signal(x) & ((x["a"] != x["other"]["a"]) | (x["b"] != x["other"]["b"])), lambda x: F.array(F.concat(x["line"], F.lit(" [SIGNAL:"), x["other"]["record_id"], F.lit("]")))),
    "number": Fault("NUMERIC_MISMATCH", _signal, lambda x: F.array(F.regexp_replace(x["line"], r"\d+ co-reports", F.concat((x["reports"] + 1).cast("string"), F.lit(" co-reports"))))),
    "graded_signal": Fault("SEVERITY_ON_STATISTICAL_SIGNAL", _signal, _before_citation("; a serious risk")),
    "hidden_dropped": Fault("MISSING_HIDDEN_COUNT", _kind("more"), _dropped),
    "hidden_wrong": Fault("MISSING_HIDDEN_COUNT", _kind("more"), lambda x: F.array(F.regexp_replace(x["line"], r"\+\d+ more", F.concat(F.lit("+"), (x["hidden"] + 1).cast("string"), F.lit(" more"))))),
    "omitted_pair": Fault("OMITTED_INTERACTION", lambda x: _curated(x) | _signal(x)),
    "omitted_major": Fault("OMITTED_MAJOR", lambda x: _curated(x) & (x["severity"] == "Major")),
    "called_safe": Fault("CONFLATED_ABSENCE", _kind("gap"), _text(lambda t: F.concat(t, F.lit(" can be taken together")))),
    "gap_dropped": Fault("MISSING_NO_DATA_DECLARATION", _kind("gap"), _dropped),
    "unresolved_dropped": Fault("MISSING_UNRESOLVED_DECLARATION", None),
    "disclaimer_dropped": Fault("MISSING_DISCLAIMER", None),
}
EXPECTED = {name: f.code for name, f in FAULTS.items()}


def lines(gathered: DataFrame) -> DataFrame:
    """gathered reports (report.gather()) with an array of their lines: kind (item, more or gap), what the line is about and
    its text, and other, the last signal of the report, which a citation can be swapped for."""
    signals = F.filter("items", lambda i: i["source"] == "SIGNAL")
    other = F.try_element_at(signals, F.lit(-1))
    kinds = lambda i, k: F.when(k > 0, "more").when(i["source"].isNull(), "gap").otherwise("item")
    of = lambda i: F.transform(item_lines(i), lambda t, k: F.struct(i["section"].alias("section"), i["a"].alias("a"), i["b"].alias("b"), i["source"].alias("source"), i["severity"].alias("severity"), i["event"].alias("event"), i["reports"].alias("reports"), i["hidden"].alias("hidden"), i["record_id"].alias("record_id"), F.struct(F.col("_other")["a"].alias("a"), F.col("_other")["b"].alias("b"), F.col("_other")["record_id"].alias("record_id")).alias("other"), kinds(i, k).alias("kind"), t.alias("line")))
    rows = gathered.withColumn("_other", other)
    made = F.flatten(F.transform("items", of))
    kind = rows.select(made.alias("x")).schema["x"].dataType
    return rows.withColumn("lines", F.coalesce(made, F.array().cast(kind))).withColumn("top", count_line()).drop("items", "_other")


def sites(rows: DataFrame) -> DataFrame:
    """One row for each place at which a report's fault (column fault) can be made: site, the number of the line from 0, or
    -1 for the report as a whole. To make every fault everywhere, explode the names of FAULTS into that column first."""
    places = lambda test: F.filter(F.transform("lines", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    found = F.coalesce(*[F.when(F.col("fault") == name, places(f.at) if f.at else F.array(F.lit(-1))) for name, f in FAULTS.items()])
    return rows.withColumn("site", F.explode(found))


def injected(rows: DataFrame, more: Column) -> DataFrame:
    """request, fault, site and the text with the fault at that site; without a site the text as it should be.

    more: lines after the findings (an array of text) that "unresolved_dropped" leaves out."""
    at = F.get("lines", F.greatest("site", F.lit(0)))
    is_ = lambda name: F.coalesce(F.col("fault") == name, F.lit(False)) & F.col("site").isNotNull()
    same = lambda x: (x["a"] == F.col("_at")["a"]) & (x["b"] == F.col("_at")["b"]) & x["source"].isNotNull()
    rows = rows.withColumn("_at", at)
    gone = lambda x: (is_("omitted_pair") & same(x)) | (is_("omitted_major") & same(x) & _curated(x) & (x["severity"] == "Major"))
    edited = lambda x: F.coalesce(*[F.when(F.col("fault") == name, f.edit(x)) for name, f in FAULTS.items() if f.edit], F.array(x["line"]))
    texts = lambda x, i: F.when(F.coalesce(gone(x), F.lit(False)), _dropped(x)).when(F.col("site").isNotNull() & (i == F.col("site")), edited(x)).otherwise(F.array(x["line"]))
    body = F.flatten(F.transform("lines", lambda x, i: F.transform(texts(x, i), lambda t: F.struct(x["section"].alias("section"), t.alias("line")))))
    rows = rows.withColumn("_body", body)
    heading = lambda s: F.coalesce(*[F.when(s == k, v) for k, v in HEADINGS.items()])
    opens = lambda x, k: (k == 0) | (F.try_element_at("_body", F.greatest(k, F.lit(1)))["section"] != x["section"])
    none = F.array().cast("array<string>")
    body = F.flatten(F.transform("_body", lambda x, k: F.concat(F.when(opens(x, k), F.array(heading(x["section"]))).otherwise(none), F.array(x["line"]))))
    text = F.array_join(F.concat(F.array(F.lit(TITLE), F.lit(HEADINGS[0]), F.col("top")), body, F.when(is_("unresolved_dropped"), none).otherwise(more)), "\n")
    return rows.select("request", "fault", "site", F.when(is_("disclaimer_dropped"), text).otherwise(finalize(text)).alias("text"))
