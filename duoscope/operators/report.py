"""Reports as rows: summaries, the grid of pairs, entries as they were read, and text joined from ordered lines.

What is shown of a request comes in one grouping of pairs.review() by request (gather()); counts, text and JSON are made
from that row. A request has a few names, so a report is a few hundred items at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import placeholder
from ..functions.text import clean, severity_rank, squeeze

TITLE = "# Interaction report"
HEADINGS = {0: "## Summary", 1: "## Major findings", 2: "## Moderate findings", 3: "## Minor findings", 4: "## Listed without a severity grade", 5: "## Statistical reporting signals (not graded)", 6: "## No curated data"}
DISCLAIMER = "Disclaimer: a report of records, not medical advice. A pair without a record is not known to be safe."


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, word).otherwise(word + "s"))


def record_id(a: str = "a", b: str = "b", event: str = "event") -> Column:
    """Ten hex digits from the pair and its event."""
    return F.substring(F.sha1(F.concat_ws("|", a, b, event)), 1, 10)


def printed() -> Column:
    """The event, or null where it says too little to be printed."""
    return F.when(~placeholder(F.col("event")), F.col("event"))


def items_of(reviewed: DataFrame) -> Column:
    """The item of each row of pairs.review(); items sort as they stand in a report."""
    made = lambda name, c: F.col(name) if name in reviewed.columns else c.alias(name)
    section = F.when(F.col("source").isNull(), 6).when(F.col("source") == "CURATED", severity_rank(F.col("severity")) + 1).otherwise(5)
    place = F.when(F.col("source").isNotNull(), F.col("position").cast("int")).otherwise(0)
    return F.struct(section.alias("section"), "a", "b", place.alias("place"), "source", "severity", "event", "reports", F.col("hidden").cast("bigint").alias("hidden"), "last", made("record_id", record_id()), made("printed", printed()), "head")


def gather(names: DataFrame, reviewed: DataFrame) -> DataFrame:
    """request, names (how many) and items in the order of the report. names: (request, name); reviewed: as pairs.review()
    gives it, with source, severity, event and reports; record_id, printed and head are made here where it lacks them. A request without
    pairs has null items."""
    if "head" not in reviewed.columns:
        reviewed = reviewed.withColumn("head", F.row_number().over(Window.partitionBy("request", "a", "b").orderBy(F.col("source") == "SIGNAL", "position")) == 1)
    items = reviewed.groupBy("request").agg(F.sort_array(F.collect_list(items_of(reviewed))).alias("items"))
    n = names.groupBy("request").agg(F.countDistinct("name").alias("names"))
    return n.join(items, "request", "left")


def tally(items: str = "items") -> dict[str, Column]:
    """Counts of a gathered row: pairs, items of each grade, signals, hidden records, pairs without data."""
    count = lambda section: F.coalesce(F.size(F.filter(items, lambda i: i["section"] == section)), F.lit(0)).cast("bigint")
    graded = {g.lower(): count(k) for k, g in enumerate(("Major", "Moderate", "Minor", "Unknown"), 1)}
    pairs = F.coalesce(F.size(F.filter(items, lambda i: i["head"])), F.lit(0)).cast("bigint")
    hidden = F.coalesce(F.aggregate(F.filter(items, lambda i: i["last"]), F.lit(0).cast("bigint"), lambda n, i: n + i["hidden"]), F.lit(0).cast("bigint"))
    return {"pairs": pairs, **graded, "signals": count(5), "hidden": hidden, "no_data": count(6)}


def summary(gathered: DataFrame) -> DataFrame:
    """Counts of each request."""
    return gathered.select("request", "names", *[c.alias(n) for n, c in tally().items()])


def grid(names: DataFrame, reviewed: DataFrame) -> DataFrame:
    """request, row > col (places of the pair's names), a, b and status: the most severe grade of the pair, "signals only"
    or "no curated data". names: (request, name, place)."""
    rank = F.when(F.col("source") == "CURATED", severity_rank(F.col("severity"))).when(F.col("source").isNotNull(), 4)
    best = reviewed.groupBy("request", "a", "b").agg(F.min(rank).alias("rank"))
    status = F.coalesce(F.try_element_at(F.array(*map(F.lit, ("Major", "Moderate", "Minor", "not graded", "signals only"))), F.col("rank") + 1), F.lit("no curated data"))
    places = names.groupBy("request").agg(F.map_from_entries(F.collect_set(F.struct("name", "place"))).alias("_at"))
    both = best.join(places, "request").withColumns({"_x": F.try_element_at("_at", F.col("a")), "_y": F.try_element_at("_at", F.col("b"))}).where("_x IS NOT NULL AND _y IS NOT NULL")
    return both.select("request", F.greatest("_x", "_y").alias("row"), F.least("_x", "_y").alias("col"), "a", "b", status.alias("status"))


def entries(resolved: DataFrame) -> DataFrame:
    """How every entry (request, place, query, method, canonical, closest) was read: status, line, first (the entry that
    stands for its name) and entered (how many entries of the request mean the same)."""
    status = F.when(F.col("method") == "fuzzy", "spelling_match").when(F.col("canonical").isNotNull(), "recognized").when(F.col("method").isin("combination", "ambiguous"), F.col("method")).otherwise("unresolved")
    same = Window.partitionBy("request", "canonical")
    known = F.col("canonical").isNotNull()
    line = (
        F.when(F.col("status") == "spelling_match", F.concat("query", F.lit(" -> "), "canonical", F.lit(" (spelling match: check this)")))
        .when(F.col("status") == "recognized", F.concat(F.col("query"), F.lit(" -> "), F.col("canonical"), F.when(clean(F.col("query")) == F.col("canonical"), "").otherwise(" (alias)")))
        .when(F.col("status") == "unresolved", F.concat("query", F.lit(" -> not recognized")))
        .otherwise(F.concat(F.col("query"), F.lit(" -> not analysed: "), F.coalesce("closest", "status")))
    )
    return resolved.withColumn("status", status).withColumns({"line": line, "first": known & (F.row_number().over(same.orderBy("place")) == 1), "entered": F.when(known, F.count(F.lit(1)).over(same))})


# What is said of an alias by its kind, of an entry that nothing knows, and of one entered twice; the lines must agree.
HOW = {
    "RXNORM:BN": "brand name",
    "DRUGSATFDA:BRAND": "brand name, Drugs@FDA",
    "DRUGBANK": "synonym, DrugBank",
    "RXNORM:PIN": "RxNorm ingredient",
    "RXNORM:MIN": "RxNorm ingredient",
    "MTHSPL:SU": "FDA substance name",
    "RXNORM:SY": "synonym",
    "RXNORM:TMSY": "synonym",
    "REVIEWED_ALIAS": "international or older name",
    "RXNORM:IN": "same active moiety",
    "SALT_GROUP": "same active moiety",
    "REVIEWED_BRAND_OVERRIDE": "brand name, reviewed",
}
UNKNOWN = "not found: check the spelling or enter the generic name; discontinued brands and non-US names may not be recognized"
TWICE = ("**Same drug entered more than once:** ", " (possible duplicate therapy). It is analysed once.")


def entry_lines(resolved: DataFrame) -> DataFrame:
    """resolved (request, place, query, method, canonical, kind of the alias, note) with status, how (what sort of alias it was; null
    where the entry is the name itself, or is no known name) and line, as a report's top shows it.

    A spelling match is always to be checked. Combinations and ambiguous entries are not analysed, for the reason in the note;
    of others without a name the note is shown, else what to do. A null query is empty.
    """
    c, given = F.col, F.trim(F.coalesce("query", F.lit("")))
    known = c("canonical").isNotNull() & (c("canonical") != "")
    status = F.when(known, F.when(c("method") == "fuzzy", "spelling_match").otherwise("recognized")).when(c("method").isin("combination", "ambiguous"), c("method")).otherwise("unresolved")
    labels = F.create_map(*[F.lit(x) for kv in HOW.items() for x in kv])
    itself = squeeze(clean(given)) == F.lower("canonical")
    how = F.when((c("status") == "recognized") & ~itself, F.coalesce(F.try_element_at(labels, F.coalesce("kind", F.lit(""))), F.lit("alias")))
    note = F.coalesce(F.nullif("note", F.lit("")), F.lit(UNKNOWN))
    said = (
        F.when(c("status") == "spelling_match", F.concat("canonical", F.lit(" (spelling match: check this)")))
        .when(c("status") == "recognized", F.concat("canonical", F.coalesce(F.concat(F.lit(" ("), "how", F.lit(")")), F.lit(""))))
        .when(c("status") != "unresolved", F.concat(F.lit("not analysed: "), F.coalesce("note", F.lit(""))))
        .otherwise(F.when(note.startswith("not found"), note).otherwise(F.concat(F.lit("not recognized: "), note)))
    )
    return resolved.withColumn("status", status).withColumn("how", how).withColumn("line", F.concat(given, F.lit(" \u2192 "), said))


def entry_notices(lines: DataFrame) -> DataFrame:
    """request, canonical, inputs and text for each name that several entries of a request mean, the entries by place, then by text."""
    known = lines.where("status IN ('recognized', 'spelling_match')")
    inputs = F.transform(F.array_sort(F.collect_list(F.struct("place", F.trim("query").alias("q")))), lambda x: x["q"])
    found = known.groupBy("request", "canonical").agg(inputs.alias("inputs")).where("size(inputs) > 1")
    two, last = F.size("inputs") == 2, F.element_at("inputs", -1)
    listed = F.concat(F.array_join(F.slice("inputs", F.lit(1), F.size("inputs") - 1), ", "), F.lit(" and "), last)
    return found.withColumn("text", F.concat(F.lit(TWICE[0]), listed, F.when(two, " both mean ").otherwise(" all mean "), "canonical", F.lit(TWICE[1])))


def count_line() -> Column:
    """The counts of a gathered row as one sentence."""
    n = tally()
    graded = F.concat_ws(", ", *[F.concat(F.lit(g + " "), n[g.lower()].cast("string")) for g in ("Major", "Moderate", "Minor")])
    return F.concat(plural(F.col("names"), "name"), F.lit(" in "), plural(n["pairs"], "pair"), F.lit(": "), graded, F.lit(", "), plural(n["signals"], "signal"), F.lit(", "), n["hidden"].cast("string"), F.lit(" hidden, "), n["no_data"].cast("string"), F.lit(" without data."))


def item_lines(i: Column) -> Column:
    """The line of an item, without an event that is a placeholder, and after the last shown record of a pair that of the hidden ones."""
    pair = F.concat(F.lit("- **"), i["a"], F.lit(" + "), i["b"], F.lit("**: "))
    body = F.when(i["source"] == "CURATED", F.concat(F.lit("severity "), F.when(i["severity"] == "Unknown", "not graded").otherwise(i["severity"]), F.coalesce(F.concat(F.lit("; "), i["printed"]), F.lit("")))).otherwise(F.concat(i["event"], F.lit(": "), i["reports"].cast("string"), F.lit(" co-reports")))
    cite = F.concat(F.lit(" ["), i["source"], F.lit(":"), i["record_id"], F.lit("]"))
    line = F.when(i["source"].isNull(), F.concat(F.lit("- "), i["a"], F.lit(" + "), i["b"])).otherwise(F.concat(pair, body, cite))
    more = F.when(i["last"], F.concat(pair, F.lit("+"), i["hidden"].cast("string"), F.lit(" more not shown")))
    return F.array_compact(F.array(line, more))


def render(gathered: DataFrame) -> DataFrame:
    """request and text of a gathered report."""
    heading = lambda s: F.coalesce(*[F.when(s == k, v) for k, v in HEADINGS.items()])
    opens = lambda i, k: (k == 0) | (F.try_element_at("items", F.greatest(k, F.lit(1)))["section"] != i["section"])
    body = F.flatten(F.transform("items", lambda i, k: F.concat(F.when(opens(i, k), F.array(heading(i["section"]))).otherwise(F.array().cast("array<string>")), item_lines(i))))
    top = F.array(F.lit(TITLE), F.lit(HEADINGS[0]), count_line())
    return gathered.select("request", F.array_join(F.concat(top, F.coalesce(body, F.array().cast("array<string>"))), "\n").alias("text"))


def finalize(text: Column, footer: str = DISCLAIMER) -> Column:
    """text with the footer once, at its end; doing it twice changes nothing. Null is empty."""
    bare = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(footer), F.lit("")), r"\s+$", "")
    return F.concat(bare, F.lit("\n\n" + footer))


def strip_section(text: Column, heading: str) -> Column:
    """text without a section, up to the next heading of its level."""
    return F.regexp_replace(text, r"(?m)^\Q" + heading + r"\E[ \t]*\n(?:(?!## ).*(?:\n|\z))*?(?=^## |\z)", "")


def cited_items() -> Column:
    """The items of a gathered report that stand for a record, in order."""
    kept = ("a", "b", "place", "source", "severity", "event", "reports", "record_id")
    return F.transform(F.filter("items", lambda i: i["source"].isNotNull()), lambda i: F.struct(*[i[c].alias(c) for c in kept]))


def structure(gathered: DataFrame) -> DataFrame:
    """request and the report as one JSON document: counts, items with citations in order, pairs without data."""
    gaps = F.transform(F.filter("items", lambda i: i["source"].isNull()), lambda i: F.struct(i["a"].alias("a"), i["b"].alias("b")))
    counts = F.struct("names", *[c.alias(n) for n, c in tally().items()])
    return gathered.select("request", F.to_json(F.struct(F.lit(2).alias("version"), counts.alias("summary"), cited_items().alias("items"), gaps.alias("no_data"))).alias("report"))


EVIDENCE = {"curated": "=== CURATED RECORDS ===", "signals": "=== SIGNALS (NOT GRADED) ===", "effects": "=== SIDE EFFECTS ===", "gaps": "=== PAIRS WITHOUT DATA ==="}


def evidence_lines(i: Column) -> Column:
    """The lines of an item in the evidence for a prompt: of a record with its citation, after the last shown one of a pair that of the
    hidden ones; of a pair without records its names."""
    pair = F.concat(i["a"], F.lit(" + "), i["b"])
    cite = F.concat(F.lit("- ["), i["source"], F.lit(":"), i["record_id"], F.lit("] "), pair)
    graded = F.concat(cite, F.lit(": severity="), F.when(i["severity"] == "Unknown", "not graded").otherwise(i["severity"]), F.lit(", event="), i["event"])
    signal = F.concat(cite, F.lit(": event="), i["event"], F.lit(", co-reports="), i["reports"].cast("string"))
    hidden = F.when((i["section"] == 5) & i["last"], F.concat(F.lit("- "), pair, F.lit(": "), i["hidden"].cast("string"), F.lit(" more not shown")))
    line = F.when(i["section"] == 6, F.concat(F.lit("- "), pair)).when(i["section"] == 5, signal).otherwise(graded)
    return F.array_compact(F.array(line, hidden))


def evidence_text(curated: Column, signals: Column, effects: Column, gaps: Column) -> Column:
    """The parts of the evidence, arrays of lines, with their headings; the first part always stands."""
    none = F.array().cast("array<string>")
    parts = {"curated": curated, "signals": signals, "effects": effects, "gaps": gaps}
    return F.array_join(F.concat(*[F.when((F.size(x) > 0) | F.lit(k == "curated"), F.concat(F.array(F.lit(EVIDENCE[k])), F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("(none)"))))).otherwise(none) for k, x in parts.items()]), "\n")


def said_lines(effects: DataFrame) -> DataFrame:
    """request and the lines of its names' side effects. effects: (request, name, effects)."""
    return effects.groupBy("request").agg(F.sort_array(F.collect_list(F.concat(F.lit("- "), "name", F.lit(": "), "effects"))).alias("_effects"))


def evidence_block(gathered: DataFrame, effects: DataFrame) -> DataFrame:
    """request and the evidence as plain text for a prompt: curated records, signals, side effects, pairs without data.

    effects: (request, name, effects), the last a text; a request without any, or without pairs, leaves those parts out.
    """
    none = F.array().cast("array<string>")
    of = lambda test: F.coalesce(F.flatten(F.transform(F.filter("items", test), evidence_lines)), none)
    text = evidence_text(of(lambda i: i["section"] < 5), of(lambda i: i["section"] == 5), F.coalesce("_effects", none), of(lambda i: i["section"] == 6))
    return gathered.join(said_lines(effects), "request", "left").select("request", text.alias("text"))


def evidence_of_pairs(requests: DataFrame, told: DataFrame, effects: DataFrame) -> DataFrame:
    """The same from the text of each pair: what a pair's records say is the same in every request, so it is made among the records.

    requests: request, one row each; told: (request, a, b, section, text) for each pair of a request and each section that it is in,
    with section 6 for a pair without records.
    """
    none = F.array().cast("array<string>")
    items = told.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("section", "a", "b", "text"))).alias("_t"))
    of = lambda test: F.coalesce(F.transform(F.filter("_t", test), lambda i: i["text"]), none)
    text = evidence_text(of(lambda i: i["section"] < 5), of(lambda i: i["section"] == 5), F.coalesce("_effects", none), of(lambda i: i["section"] == 6))
    return requests.join(items, "request", "left").join(said_lines(effects), "request", "left").select("request", text.alias("text"))


def signal_block(assessed: DataFrame) -> DataFrame:
    """For each pair of assessed counts (signals.assess()) the lines of its surfaced events, most reports first, and how many
    events were suppressed; a pair has as many lines as events were surfaced."""
    line = F.concat("event", F.lit(": "), plural(F.col("n_abe"), "report"))
    kept = F.collect_list(F.when(F.col("surfaced"), F.struct((-F.col("n_abe")).alias("k"), "event", line.alias("line"))))
    return assessed.groupBy("a", "b").agg(F.array_join(F.transform(F.sort_array(kept), lambda x: x["line"]), "; ").alias("lines"), F.count_if("surfaced").alias("surfaced"), F.count_if(~F.col("surfaced")).alias("suppressed"))
