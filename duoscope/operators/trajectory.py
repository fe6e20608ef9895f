"""Logs of steps: appended to, folded into one row a run, held against invariants and against the path that was due.

A log is a table of steps (run, seq, node, status, ms, outcome). outcome is set for the steps that ask a generator: pass,
fail (a draft was made and refused), err_t (a passing error), err_nt (an error that must not be tried again). A run has a
few steps, which are gathered into its row; everything else is joins and sums by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rate

# Names of nodes, of the sources of a report, and of invariants.
GENERATE, VALIDATE, TEMPLATE, FINALIZE, SPONTANEOUS = "generate_llm", "validate", "template", "finalize", "faers"
INVARIANTS = (
    "ends_at_finalize", "plan_complete", "partition_holds", "faers_only_when_needed", "llm_attempts_within_budget", "non_transient_never_retried", "no_unvalidated_llm_text",
    "exhausted_fallback_matches_deterministic", "final_report_valid", "every_node_timed", "state_json_serializable",
)


def appended(log: DataFrame, more: DataFrame) -> DataFrame:
    """log with the steps of more that it does not have: a step that is written stays as it is, one that is sent twice is
    there once."""
    new = more.select(log.columns).join(log.select("run", "seq"), ["run", "seq"], "left_anti").dropDuplicates(["run", "seq"])
    return log.unionByName(new)


def folded(log: DataFrame) -> DataFrame:
    """One row a run: nodes and outcomes in order, timed (no step without a time of 0 or more), whole (numbers from 1
    without a gap), total_ms."""
    step = F.struct("seq", "node", "outcome")
    timed = F.col("ms").isNotNull() & ~F.isnan("ms") & (F.col("ms") >= 0)
    rows = log.groupBy("run").agg(F.array_sort(F.collect_list(step)).alias("s"), F.min(F.coalesce(timed, F.lit(False))).alias("timed"), F.sum("ms").alias("total_ms"), (F.max("seq") == F.count(F.lit(1))).alias("_to"), (F.min("seq") == 1).alias("_from"), (F.countDistinct("seq") == F.count(F.lit(1))).alias("_once"))
    asked = F.filter("s", lambda x: x["node"] == GENERATE)
    return rows.select("run", F.transform("s", lambda x: x["node"]).alias("nodes"), F.transform(asked, lambda x: x["outcome"]).alias("outcomes"), "timed", "total_ms", (F.col("_to") & F.col("_from") & F.col("_once")).alias("whole"))


def used(outcomes: Column, most: Column) -> Column:
    """How many of the outcomes a run may take up: up to the first that ends it, and no more than `most`."""
    n = F.least(F.size(outcomes), most)
    ends = F.filter(F.transform(F.slice(outcomes, F.lit(1), F.greatest(n, F.lit(0))), lambda o, i: F.when(o.isin("pass", "err_nt"), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(ends, F.lit(0)), n)


def due(outcomes: Column, eligible: Column, asks: Column, visits: Column, most: Column) -> Column:
    """struct<path, source>: the nodes a run should go through and where its report should come from.

    eligible: two names at least; asks: a generator is asked; visits: spontaneous reports are looked up."""
    n = used(outcomes, most)
    taken = F.slice(outcomes, F.lit(1), F.greatest(n, F.lit(0)))
    passed = F.coalesce(F.try_element_at(taken, F.lit(-1)) == "pass", F.lit(False))
    words = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    before = F.concat(words("normalize", "plan", "retrieve"), F.when(visits, words(SPONTANEOUS)).otherwise(none))
    tries = F.flatten(F.transform(taken, lambda o: F.when(o.isin("pass", "fail"), words(GENERATE, VALIDATE)).otherwise(words(GENERATE))))
    answer = lambda path, source: F.struct(path.alias("path"), (F.lit(source) if isinstance(source, str) else source).alias("source"))
    asked = answer(F.concat(before, tries, F.when(passed, none).otherwise(words(TEMPLATE)), words(FINALIZE)), F.when(~passed, "deterministic_fallback").when(n == 1, "llm").otherwise("llm_retry"))
    return F.when(~eligible, answer(words("normalize", "plan", TEMPLATE, FINALIZE), "deterministic_insufficient_input")).when(~asks, answer(F.concat(before, words(TEMPLATE, FINALIZE)), "deterministic")).otherwise(asked)


def invariants(runs: DataFrame, log: DataFrame, names: DataFrame, planned: DataFrame, retrieved: DataFrame, drafts: DataFrame, findings: DataFrame) -> DataFrame:
    """run and INVARIANTS, a boolean each.

    runs: run, source, report, baseline, faers_enabled, faers_calls, max_attempts, attempts, calls, state (JSON), looked_up
    (whether anything was retrieved); names: run, name; planned: run, a, b; retrieved: run, a, b, has_records; drafts: run,
    text, valid; findings: run, code (of the final report)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = names.select("run", F.lower("name").alias("name")).distinct()
    k = low.groupBy("run").agg(F.count(F.lit(1)).alias("k"))
    # a run's names are gathered, so that everything is dealt by the run
    own = low.groupBy("run").agg(F.collect_set("name").alias("_names"))
    fits = planned.join(own, "run", "left").withColumn("_fit", yes(F.col("a") < F.col("b")) & yes(F.array_contains("_names", F.col("a"))) & yes(F.array_contains("_names", F.col("b"))))
    plan = fits.groupBy("run", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("_fit").alias("fit"))
    plan = plan.groupBy("run").agg(F.sum("n").alias("rows"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("pairs"), F.min("fit").alias("sound"))
    sides = planned.select("run", "a", "b", F.lit(1).alias("_p"), F.lit(None).cast("boolean").alias("has_records")).unionByName(retrieved.select("run", "a", "b", F.lit(None).cast("int").alias("_p"), "has_records"))
    both = sides.groupBy("run", "a", "b").agg(F.max("_p").alias("_p"), F.countDistinct("has_records").alias("kinds"))
    parts = both.groupBy("run").agg(F.min(yes(F.col("_p").isNotNull() & (F.col("kinds") == 1) & F.col("a").isNotNull() & F.col("b").isNotNull())).alias("parted"), F.count("_p").alias("n_planned"))
    gaps = retrieved.where("NOT has_records").select("run").distinct().withColumn("gap", F.lit(True))
    shown = runs.select("run", "report").join(drafts.select("run", F.col("text").alias("report"), "valid"), ["run", "report"]).groupBy("run").agg(F.max("valid").alias("is_valid"), F.max(~F.col("valid")).alias("is_refused"))
    bad = findings.select("run").distinct().withColumn("bad", F.lit(True))
    rows = runs
    for df in (folded(log), k, plan, parts, gaps, shown, bad):
        rows = rows.join(df, "run", "left")
    c, zero = F.col, lambda n: F.coalesce(F.col(n), F.lit(0))
    size = F.coalesce(F.size("nodes"), F.lit(0))
    pairs = (zero("k") * (zero("k") - 1) / 2).cast("bigint")
    needs, visited = c("faers_enabled") & yes(c("gap")), yes(F.array_contains("nodes", SPONTANEOUS))
    tries = F.coalesce(F.size("outcomes"), F.lit(0))
    stopped = F.array_position(F.coalesce("outcomes", F.array().cast("array<string>")), "err_nt")
    drafted = c("source").isin("llm", "llm_retry")
    tests = {
        "ends_at_finalize": yes(F.try_element_at("nodes", F.lit(-1)) == FINALIZE),
        "plan_complete": (zero("rows") == pairs) & (zero("pairs") == pairs) & F.coalesce("sound", F.lit(True)),
        "partition_holds": F.when(c("looked_up"), F.coalesce("parted", F.lit(True))).otherwise(zero("n_planned") == 0),
        "faers_only_when_needed": (visited == needs) & ((zero("faers_calls") > 0) == needs),
        "llm_attempts_within_budget": (zero("attempts") <= c("max_attempts")) & (zero("calls") <= c("max_attempts")) & (tries <= c("max_attempts")),
        "non_transient_never_retried": (stopped == 0) | (stopped == tries),
        "no_unvalidated_llm_text": F.when(drafted, yes(c("is_valid"))).otherwise(~yes(c("is_refused"))),
        "exhausted_fallback_matches_deterministic": (c("source") != "deterministic_fallback") | c("report").eqNullSafe(c("baseline")),
        "final_report_valid": ~yes(c("bad")),
        "every_node_timed": (size > 0) & yes(c("timed")),
        "state_json_serializable": F.try_parse_json("state").isNotNull(),
    }
    return rows.select("run", *[yes(tests[n]).alias(n) for n in INVARIANTS])


def pass_rates(checked: DataFrame) -> DataFrame:
    """invariant, runs, passed and rate."""
    sums = checked.agg(F.count(F.lit(1)).alias("runs"), *[F.count_if(n).alias(n) for n in INVARIANTS])
    rows = sums.unpivot(["runs"], list(INVARIANTS), "invariant", "passed")
    return rows.select("invariant", "runs", "passed", rate(F.col("passed"), F.col("runs")).alias("rate"))


def node_percentiles(log: DataFrame, by: list[str], value: str = "ms", shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles of a value for each group and, with nulls in place of the group, for all rows.

    Values are counted first, so that a group reaches its window as its distinct values; the rank is that of
    round(share * (n - 1)), halves to even. Null values do not count."""
    counted = log.where(F.col(value).isNotNull()).groupingSets([[*by, value], [value]], *by, value).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"))
    group = [*by, "_g"]
    to = F.sum("_n").over(Window.partitionBy(*group).orderBy(value))
    n = F.sum("_n").over(Window.partitionBy(*group))
    ranked = counted.withColumns({"_to": to, "_all": n})
    pick = lambda q: F.min(F.when(F.col("_to") > F.bround(F.lit(q) * (F.col("_all") - 1)), F.col(value)))
    return ranked.groupBy(*group).agg(F.max("_all").alias("n"), *[pick(q).alias(f"p{round(100 * q)}") for q in shares]).drop("_g")
