"""Queries on logs of steps. An open order stands for a run, its lines for what the generator answers; every kind of breach
is planted in one run of thirteen, where the run allows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as op
from ..operators import trajectory as tr
from .pairs import RECORDS, asked_names, planned, records
from .registry import Tables, query

MOST = 3
ANSWERS = ("pass", "fail", "err_t", "err_nt")


def runs(t: Tables):
    """run, breach (0 to 12), names k, gap, outcomes and what is due."""
    r = F.col("request")
    names = asked_names(t)
    parts = op.partition(planned(t), records(t))
    gaps = parts.groupBy("request").agg(F.max(~F.col("has_records")).alias("gap"))
    answer = F.get(F.array(*map(F.lit, ANSWERS)), F.pmod(F.col("l_quantity").cast("int"), F.lit(4)))
    answers = t.lineitem.groupBy(F.col("l_orderkey").alias("request")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", answer.alias("o")))), lambda x: x["o"]).alias("outcomes"))
    rows = names.groupBy("request").agg(F.count(F.lit(1)).alias("k")).join(gaps, "request", "left").join(answers, "request").withColumns({"gap": F.coalesce("gap", F.lit(False)), "breach": F.pmod(r, F.lit(13)).cast("int"), "faers_enabled": r % 2 == 0})
    rows = rows.withColumn("due", tr.due(F.col("outcomes"), F.col("k") > 1, r % 5 != 0, F.col("faers_enabled") & F.col("gap"), F.lit(MOST)))
    return rows.withColumns({"run": r, "taken": F.slice("outcomes", F.lit(1), tr.used(F.col("outcomes"), F.lit(MOST))), "asked": (F.col("k") > 1) & (r % 5 != 0)}), parts


def steps(rows):
    """The log of all runs: the path that was due, but for breaches 0 (no end), 3 (an uncalled-for visit), 5 (tried again) and 8 (no time)."""
    b, none = F.col("breach"), F.array().cast("array<struct<node:string,outcome:string>>")
    tries = F.col("due.path")
    nth = lambda i: F.size(F.filter(F.slice(tries, F.lit(1), i + 1), lambda n: n == tr.GENERATE))
    path = F.transform(tries, lambda n, i: F.struct(n.alias("node"), F.when(n == tr.GENERATE, F.get("taken", nth(i) - 1)).alias("outcome")))
    extra = lambda node, outcome: F.array(F.struct(F.lit(node).alias("node"), F.lit(outcome).cast("string").alias("outcome")))
    path = F.concat(F.when(b == 3, extra(tr.SPONTANEOUS, None)).otherwise(none), F.when(b == 0, F.slice(path, F.lit(1), F.size(path) - 1)).when((b == 5) & F.col("asked"), F.concat(F.slice(path, F.lit(1), F.size(path) - 1), extra(tr.GENERATE, "pass"), extra(tr.FINALIZE, None))).otherwise(path))
    log = rows.select("run", "breach", F.posexplode(path).alias("seq", "s"))
    ms = F.when((F.col("breach") != 8) | (F.col("seq") != 1), F.pmod(F.col("run") * 7 + F.col("seq") * 13, F.lit(100)).cast("double"))
    return log.select("run", (F.col("seq") + 1).alias("seq"), "s.node", F.lit("ok").alias("status"), ms.alias("ms"), "s.outcome")


def checked(t: Tables):
    rows, parts = runs(t)
    b, run = F.col("breach"), F.col("run").cast("string")
    base, last = F.concat(F.lit("base "), run), F.size("taken")
    source = F.col("due.source")
    refused = F.array_position("taken", "fail")
    text = F.when((b == 6) & F.col("asked") & (refused > 0), F.concat(F.lit("draft "), run, F.lit("/"), refused)).when(source.isin("llm", "llm_retry"), F.concat(F.lit("draft "), run, F.lit("/"), last)).when((b == 10) & (source == "deterministic_fallback"), "other").otherwise(base)
    needs = F.col("faers_enabled") & F.col("gap") & (F.col("k") > 1)
    made = rows.select("run", source.alias("source"), text.alias("report"), base.alias("baseline"), "faers_enabled", needs.cast("int").alias("faers_calls"), F.lit(MOST).alias("max_attempts"), F.when(b == 4, MOST + 6).otherwise(F.when(F.col("asked"), last).otherwise(0)).alias("attempts"), F.when(F.col("asked"), last).otherwise(0).alias("calls"), F.when(b == 9, "{broken").otherwise(F.to_json(F.struct("run", "k"))).alias("state"), (F.col("k") > 1).alias("looked_up"))
    key = rows.select(F.col("run").alias("request"), "breach", "k")
    first = parts.groupBy("request").agg(F.min(F.struct("a", "b")).alias("f"))
    pairs = parts.join(key, "request").join(first, "request").withColumn("is_first", F.struct("a", "b") == F.col("f"))
    plan = pairs.where((F.col("breach") != 1) | ~F.col("is_first")).select(F.col("request").alias("run"), "a", "b")
    got = pairs.select(F.col("request").alias("run"), "a", "b", "has_records")
    twice = pairs.where((F.col("breach") == 2) & F.col("is_first")).select(F.col("request").alias("run"), "a", "b", ~F.col("has_records"))
    drafts = rows.where("asked").select("run", F.posexplode("taken").alias("i", "o")).where("o IN ('pass', 'fail')").select("run", F.concat(F.lit("draft "), F.col("run").cast("string"), F.lit("/"), F.col("i") + 1).alias("text"), (F.col("o") == "pass").alias("valid"))
    bad = rows.where("breach = 7").select("run", F.lit("UNCITED_CLAIM").alias("code"))
    names = asked_names(t).select(F.col("request").alias("run"), "name")
    return tr.invariants(made, steps(rows), names, plan, got.unionAll(twice), drafts, bad)


RUNS = f"""{RECORDS},
part AS (SELECT request, a, b, k IS NOT NULL AS has_records FROM planned LEFT JOIN (SELECT DISTINCT a, b, true AS k FROM records) USING (a, b)),
o AS (SELECT l_orderkey AS request, list({list(ANSWERS)}[CAST(l_quantity AS INT) % 4 + 1] ORDER BY l_linenumber, l_quantity)[:{MOST}] AS o FROM lineitem GROUP BY 1),
n AS (SELECT request, count(*) AS k FROM named WHERE status = 'O' GROUP BY 1), g AS (SELECT request, bool_or(NOT has_records) AS gap FROM part GROUP BY 1),
r AS (SELECT n.request AS run, k, coalesce(gap, false) AS gap, o, coalesce(list_filter(range(1, len(o) + 1), lambda i: o[i] IN ('pass', 'err_nt'))[1], len(o)) AS used, n.request % 13 AS breach, k > 1 AND n.request % 5 <> 0 AS asked, n.request % 2 = 0 AS enabled FROM n JOIN o USING (request) LEFT JOIN g USING (request)),
d AS (SELECT *, o[:used] AS taken, o[used] = 'pass' AS passed, list_contains(o[:used], 'fail') AS failed, enabled AND gap AS visits FROM r),
f AS (SELECT *, asked AND NOT passed AS fallback FROM d),
p AS (SELECT *, CASE WHEN k < 2 THEN ['normalize', 'plan', 'template', 'finalize'] ELSE list_concat(['normalize', 'plan', 'retrieve'], CASE WHEN visits THEN ['faers'] ELSE [] END,
  CASE WHEN asked THEN list_concat(flatten(list_transform(taken, lambda x: CASE WHEN x IN ('pass', 'fail') THEN ['generate_llm', 'validate'] ELSE ['generate_llm'] END)), CASE WHEN passed THEN [] ELSE ['template'] END, ['finalize']) ELSE ['template', 'finalize'] END) END AS path FROM f)"""


@query(f"""
WITH {RUNS} SELECT run, breach <> 0 AS ends_at_finalize, NOT (breach = 1 AND k > 1) AS plan_complete, NOT (breach IN (1, 2) AND k > 1) AS partition_holds, NOT (breach = 3 AND NOT visits) AND NOT (breach = 2 AND enabled AND k > 1 AND NOT gap) AS faers_only_when_needed,
  breach <> 4 AND NOT (breach = 5 AND asked AND used = {MOST}) AS llm_attempts_within_budget, NOT (breach = 5 AND asked AND o[used] = 'err_nt') AS non_transient_never_retried, NOT (breach = 6 AND asked AND failed) AS no_unvalidated_llm_text,
  NOT (fallback AND (breach = 10 OR (breach = 6 AND failed))) AS exhausted_fallback_matches_deterministic, breach <> 7 AS final_report_valid, breach <> 8 AS every_node_timed, breach <> 9 AS state_json_serializable FROM f
""")
def trajectory_invariants(t):
    """The eleven invariants of every run. A pair that is retrieved twice, with and without records, makes its run lack a visit too."""
    return checked(t)


@query(f"""
WITH {RUNS} SELECT run, array_to_string(path, ' ') AS path, CASE WHEN k < 2 THEN 'deterministic_insufficient_input' WHEN NOT asked THEN 'deterministic' WHEN NOT passed THEN 'deterministic_fallback' WHEN used = 1 THEN 'llm' ELSE 'llm_retry' END AS source,
  NOT (breach IN (0, 3) OR (breach = 5 AND asked)) AS path_matches FROM p
""")
def trajectory_paths(t):
    """The path and source that were due, and whether the log shows that path."""
    rows, _ = runs(t)
    seen = tr.folded(steps(rows)).select("run", "nodes")
    return rows.join(seen, "run").select("run", F.array_join("due.path", " ").alias("path"), "due.source", (F.col("nodes") == F.col("due.path")).alias("path_matches"))


@query(f"""
WITH {RUNS}, l AS (SELECT run, breach, CASE WHEN breach = 3 THEN list_prepend('faers', path) WHEN breach = 0 THEN path[:-2] WHEN breach = 5 AND asked THEN list_concat(path[:-2], ['generate_llm', 'finalize']) ELSE path END AS path FROM p),
s AS (SELECT run, breach, unnest(path) AS node, unnest(range(1, len(path) + 1)) AS seq FROM l),
m AS (SELECT node, CAST((run * 7 + (seq - 1) * 13) % 100 AS DOUBLE) AS ms FROM s WHERE breach <> 8 OR seq <> 2),
w AS (SELECT node, list(ms ORDER BY ms) AS v FROM m GROUP BY node UNION ALL SELECT NULL, list(ms ORDER BY ms) FROM m)
SELECT node, CAST(len(v) AS BIGINT) AS n, v[CAST(round_even(0.5::DOUBLE * (len(v) - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.95::DOUBLE * (len(v) - 1), 0) AS BIGINT) + 1] AS p95 FROM w
""")
def node_times(t):
    """Median and 95th percentile of each node's time, and of all steps."""
    rows, _ = runs(t)
    return tr.node_percentiles(steps(rows), ["node"])


@query(f"""
WITH {RUNS} SELECT 'non_transient_never_retried' AS invariant, count(*) AS runs, count(*) FILTER (WHERE NOT (breach = 5 AND asked AND o[used] = 'err_nt')) AS passed, round(count(*) FILTER (WHERE NOT (breach = 5 AND asked AND o[used] = 'err_nt')) / count(*)::DOUBLE, 4) AS rate FROM f
UNION ALL SELECT 'plan_complete', count(*), count(*) FILTER (WHERE NOT (breach = 1 AND k > 1)), round(count(*) FILTER (WHERE NOT (breach = 1 AND k > 1)) / count(*)::DOUBLE, 4) FROM f
""")
def invariant_rates(t):
    """How many runs keep two of the invariants, which depend on the runs' own steps and pairs."""
    return tr.pass_rates(checked(t)).where("invariant IN ('non_transient_never_retried', 'plan_complete')")
