"""Claims for a judge, what its answers settle, and audits that don't show its verdicts. The calls themselves are not made here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import verdict_in
from .checker import UNIT, Evidence, cited
from .stats import exact_sample

VERDICTS = ("supported", "unsupported", "contradicted")


def extract_claims(found: DataFrame, e: Evidence) -> DataFrame:
    """The clinical claims among units (checker.read) that cite something: claim_id (report:Lline), report, line, place, text,
    citations as written, records (those in the evidence, as the judge sees them) and missing (citations without a record).

    A citation that a unit repeats counts each time. Claims of one line share their id, as its sentences do; place tells them apart.
    """
    told = found.where(F.col("is_claim") & (F.size("keys") > 0))
    asked = told.select(*UNIT, F.posexplode(F.arrays_zip("cites", "keys")).alias("nth", "c"))
    shown = F.format_string("[%s:%s]", "c.cites.source", "c.cites.record")
    asked = asked.select(*UNIT, "nth", F.col("c.cites.source").alias("source"), shown.alias("citation"), F.col("c.keys").alias("key"))
    record = cited(told, e).where("r IS NOT NULL").select(*UNIT, "key", "r").dropDuplicates([*UNIT, "key"])
    met = asked.join(record, [*UNIT, "key"], "left")
    view = F.struct("citation", "source", F.col("r.kind").alias("kind"), F.col("r.names").alias("names"), F.col("r.event").alias("event"), F.col("r.severity").alias("severity"), F.col("r.prr").alias("prr"), F.nullif("r.mechanism", F.lit("")).alias("mechanism"), F.col("r.reports").alias("reports"))
    each = F.struct("nth", "citation", F.when(F.col("r").isNotNull(), view).alias("view"))
    per = met.groupBy(*UNIT).agg(F.array_sort(F.collect_list(each)).alias("_c"))
    per = per.select(*UNIT, F.col("_c.citation").alias("citations"), F.filter("_c.view", lambda v: v.isNotNull()).alias("records"), F.transform(F.filter("_c", lambda c: c["view"].isNull()), lambda c: c["citation"]).alias("missing"))
    ident = F.format_string("%s:L%s", F.col("report").cast("string"), F.col("line").cast("string"))
    return told.select(*UNIT, F.col("body").alias("text")).join(per, UNIT).select(ident.alias("claim_id"), *UNIT, "text", "citations", "records", "missing")


def settle(claims: DataFrame, answers: DataFrame, key: str = "claim_id") -> DataFrame:
    """key, verdict, rationale and called of each claim (key, records, missing), by the answers (key, answer), one a claim.

    A claim that cites no record but missing ones is unsupported without a call. An answer without a valid verdict, or none,
    is invalid, with its beginning as the rationale. A claim that also cites a missing record is not supported.
    """
    said = answers.select(key, verdict_in(F.col("answer"), VERDICTS).alias("v"), F.substring("answer", 1, 200).alias("head"))  # no long answer is shuffled
    rows = claims.select(key, "records", "missing").join(said, key, "left")
    alone, partly = (F.size("missing") > 0) & (F.size("records") == 0), (F.size("missing") > 0) & (F.col("v.verdict") == "supported")
    listed = F.array_join("missing", ", ")
    verdict = F.when(alone, "unsupported").when(F.col("v").isNull(), "invalid").when(partly, "unsupported").otherwise(F.col("v.verdict"))
    why = F.coalesce("v.rationale", F.lit(""))
    rationale = F.when(alone, F.concat(F.lit("cites no record in the evidence: "), listed)).when(F.col("v").isNull(), F.coalesce("head", F.lit("")))
    rationale = rationale.when(partly, F.concat(why, F.lit(" (also cites "), listed, F.lit(", which is not in the evidence)"))).otherwise(why)
    return rows.select(key, verdict.alias("verdict"), rationale.alias("rationale"), (~alone).alias("called"))


def blind(claims: DataFrame, judgements: DataFrame, seed: str, fraction: float = 0.2, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """An audit of a share of the judged claims, and its key: (audit_id, claim, cited_records, human_verdict, human_notes), the last two
    empty, and (audit_id, the key's columns, judge_verdict). Exactly round(fraction * judged) claims, one at least, whatever the
    partitions; invalid judgements are not among them. claims: key, text, records; judgements: key, verdict."""
    key = key or ["claim_id"]
    taken = exact_sample(judgements.where(F.col("verdict").isin(*VERDICTS)).select(*key, "verdict"), key, seed, fraction=fraction)
    rows = taken.withColumn("audit_id", F.concat(F.lit("A"), F.lpad(F.col("place").cast("string"), F.greatest(F.length(F.col("place").cast("string")), F.lit(3)), F.lit("0"))))
    shown = rows.join(claims, key).select("audit_id", F.col("text").alias("claim"), F.to_json("records").alias("cited_records"), F.lit("").alias("human_verdict"), F.lit("").alias("human_notes"))
    return shown, rows.select("audit_id", *key, F.col("verdict").alias("judge_verdict"))
