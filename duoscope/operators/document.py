"""The whole report as one nested row a request, and the same as rows: how entries were read, notices, counts, findings,
listings without a grade, signals, what is hidden, and what is not covered.

Every piece carries the line it becomes in the text, made by the same columns that render() uses, so text and data agree.
A request has a few names, so a document is a few hundred pieces at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import count_line, item_lines, plural, tally

GRADED = ("Major", "Moderate", "Minor")
COVERED = "All entries were recognized, and each pair has a record in the loaded data."
ENTRY = "array<struct<place:bigint,input:string,status:string,read_as:string,how:string,note:string,line:string>>"
NOTICE = "array<struct<drug:string,inputs:array<string>,text:string>>"
#: Lists of a document whose pieces are about a pair, in the order in which a cell of the grid looks for its pair.
PAIRED = ("findings", "ungraded", "signals", "no_data")


def entry_lists(lines: DataFrame, notices: DataFrame) -> DataFrame:
    """request, entries and notices, in order, of report.entry_lines() and report.entry_notices()."""
    item = F.struct(F.col("place").cast("bigint").alias("place"), F.trim(F.coalesce("query", F.lit(""))).alias("input"), "status", F.col("canonical").alias("read_as"), "how", F.when(F.col("canonical").isNull(), F.nullif("note", F.lit(""))).alias("note"), "line")
    read = lines.groupBy("request").agg(F.sort_array(F.collect_list(item)).cast(ENTRY).alias("entries"))
    told = notices.groupBy("request").agg(F.sort_array(F.collect_list(F.struct(F.col("canonical").alias("drug"), "inputs", "text"))).cast(NOTICE).alias("notices"))
    return read.join(told, "request", "left")


def document(gathered: DataFrame, entries: DataFrame) -> DataFrame:
    """request and document, a struct. gathered: as report.gather() gives it; entries: as entry_lists() does.

    A request of either table has a row: without entries those lists are empty, without known names all counts are 0. Events too
    general to be printed are null. Unresolved entries are those that were not recognized, with the reason where one is known.
    """
    none = lambda kind: F.array().cast(kind)
    both = gathered.join(entries, "request", "full_outer")
    both = both.withColumns({"names": F.coalesce("names", F.lit(0)).cast("bigint"), "entries": F.coalesce("entries", none(ENTRY)), "notices": F.coalesce("notices", none(NOTICE))})
    both = both.withColumn("items", F.coalesce("items", F.array().cast(gathered.schema["items"].dataType)))
    of = lambda *sections: F.filter("items", lambda i: i["section"].isin(*sections))
    pair = lambda i: (i["a"].alias("a"), i["b"].alias("b"))

    def finding(i: Column) -> Column:
        grade = F.when(i["severity"].isin(*GRADED), i["severity"]).otherwise("not graded")
        return F.struct(*pair(i), grade.alias("severity"), i["source"].alias("source"), i["printed"].alias("event"), i["record_id"].alias("record_id"), F.substring(item_lines(i)[0], 3, 1 << 30).alias("line"))

    def signal(i: Column) -> Column:
        return F.struct(*pair(i), i["source"].alias("source"), i["event"].alias("event"), i["reports"].alias("reports"), i["record_id"].alias("record_id"), F.substring(item_lines(i)[0], 3, 1 << 30).alias("line"))

    def hidden(i: Column, k: Column) -> Column:
        """What is not shown of a pair, after so many signals."""
        return F.when(i["last"], F.struct(*pair(i), i["hidden"].alias("count"), F.substring(item_lines(i)[1], 3, 1 << 30).alias("line"), (k + 1).cast("bigint").alias("after")))

    unread = F.transform(F.filter("entries", lambda e: ~e["status"].isin("recognized", "spelling_match")), lambda e: F.struct(e["input"].alias("input"), e["note"].alias("reason"), F.concat(e["input"], F.coalesce(F.concat(F.lit(": "), e["note"]), F.lit(""))).alias("line")))
    gaps = F.transform(of(6), lambda i: F.struct(*pair(i), F.concat(i["a"], F.lit(" + "), i["b"]).alias("line")))
    n = tally()
    counts = F.struct(F.col("names"), n["pairs"].alias("pairs"), F.struct(*[n[g.lower()].alias(g) for g in GRADED]).alias("graded"), n["unknown"].alias("ungraded"), n["signals"].alias("signals"), n["hidden"].alias("hidden"), F.size(unread).cast("bigint").alias("unresolved"), n["no_data"].alias("no_data"), count_line().alias("text"))
    made = F.struct(
        F.lit(3).alias("version"), F.col("entries"), F.col("notices"), counts.alias("summary"), F.transform(of(1, 2, 3), finding).alias("findings"), F.transform(of(4), finding).alias("ungraded"),
        F.transform(of(5), signal).alias("signals"), F.array_compact(F.transform(of(5), hidden)).alias("hidden"), unread.alias("unresolved"), gaps.alias("no_data"),
        F.when((F.size(unread) == 0) & (F.size(gaps) == 0), COVERED).alias("covered"),
    )
    return both.select("request", made.alias("document"))


def pieces(documents: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """request, part, place (from 0 in its part), a, b, status and line of every piece of the documents, or of the parts that are named."""
    text = F.lit(None).cast("string")

    def part(name: str, pick) -> Column:
        return F.transform(f"document.{name}", lambda x, k: F.struct(F.lit(name).alias("part"), k.cast("bigint").alias("place"), *(c.alias(o) for c, o in zip(pick(x), ("a", "b", "status", "line")))))

    one = lambda name, line: F.array(F.struct(F.lit(name).alias("part"), F.lit(0).cast("bigint").alias("place"), text.alias("a"), text.alias("b"), text.alias("status"), line.alias("line")))
    parts = {
        "entries": part("entries", lambda x: (x["input"], x["read_as"], x["status"], x["line"])),
        "notices": part("notices", lambda x: (x["drug"], text, text, x["text"])),
        "summary": one("summary", F.col("document.summary.text")),
        "findings": part("findings", lambda x: (x["a"], x["b"], x["severity"], x["line"])),
        "ungraded": part("ungraded", lambda x: (x["a"], x["b"], x["severity"], x["line"])),
        "signals": part("signals", lambda x: (x["a"], x["b"], F.lit("signals only"), x["line"])),
        "hidden": part("hidden", lambda x: (x["a"], x["b"], x["after"].cast("string"), x["line"])),
        "unresolved": part("unresolved", lambda x: (x["input"], text, text, x["line"])),
        "no_data": part("no_data", lambda x: (x["a"], x["b"], F.lit("no curated data"), x["line"])),
        "covered": F.filter(one("covered", F.col("document.covered")), lambda x: x["line"].isNotNull()),
    }
    return documents.select("request", F.explode(F.concat(*[p for n, p in parts.items() if only is None or n in only])).alias("p")).select("request", "p.*")


def cell_links(found: DataFrame) -> DataFrame:
    """request, a, b, status, part and place: for every pair of pieces() its most severe status and the piece that has it."""
    rank = F.array_position(F.array(*map(F.lit, PAIRED)), F.col("part"))
    best = found.where(F.col("part").isin(*PAIRED)).groupBy("request", "a", "b").agg(F.min(F.struct(rank.alias("rank"), "place", "status", "part")).alias("x"))
    return best.select("request", "a", "b", "x.status", "x.part", "x.place")


def looked_up(gaps: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """gaps (request, a, b: pairs without a curated record) with lines, surfaced, suppressed and failed.

    found: report.signal_block(), with a column error where lookups can fail. A request has its first `most` pairs by name looked
    up, a pair beyond them and one with an error count as failed; a pair that was looked up without reports has zeros. The window
    is over the pairs of one request.
    """
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    block = found.select("a", "b", "lines", "surfaced", "suppressed", error.alias("error"))
    turn = F.row_number().over(Window.partitionBy("request").orderBy("a", "b"))
    both = gaps.select("request", "a", "b").distinct().withColumn("_beyond", turn > most).join(block, ["a", "b"], "left")
    failed = F.col("_beyond") | F.col("error").isNotNull()
    zero = F.lit(0).cast("bigint")
    counted = {c: F.when(failed, zero).otherwise(F.coalesce(c, zero)) for c in ("surfaced", "suppressed")}
    return both.select("request", "a", "b", F.when(failed, "").otherwise(F.coalesce("lines", F.lit(""))).alias("lines"), *[v.alias(k) for k, v in counted.items()], failed.alias("failed"))


def spontaneous(looked: DataFrame) -> DataFrame:
    """request, pairs (with surfaced events), surfaced, suppressed, failed, text and note; a request with none of these has no row."""
    line = F.concat(F.lit("- **"), "a", F.lit(" + "), "b", F.lit("**: "), "lines")
    kept = F.collect_list(F.when(F.col("surfaced") > 0, F.struct("a", "b", line.alias("line"))))
    done = looked.groupBy("request").agg(F.transform(F.sort_array(kept), lambda x: x["line"]).alias("lines"), F.sum("surfaced").alias("surfaced"), F.sum("suppressed").alias("suppressed"), F.count_if("failed").alias("failed"))
    hid = F.when(F.col("suppressed") > 0, F.concat(plural(F.col("suppressed"), "co-reported event"), F.lit(" suppressed.")))
    lost = F.when(F.col("failed") > 0, F.concat(plural(F.col("failed"), "pair"), F.lit(" not looked up; nothing is known of "), F.when(F.col("failed") == 1, "it.").otherwise("them.")))
    shown = done.where("surfaced > 0 OR suppressed > 0 OR failed > 0")
    return shown.select("request", F.size("lines").cast("bigint").alias("pairs"), "surfaced", "suppressed", "failed", F.array_join("lines", "\n").alias("text"), F.concat_ws(" ", hid, lost).alias("note"))
