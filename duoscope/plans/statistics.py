"""Queries on agreement, ranks, thresholds, holdouts and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rate, tier
from ..operators import pairs, stats
from .pairs import RANK, RECORDS, planned, records
from .registry import Tables, query

GRADES = ["Minor", "Moderate", "Major"]
#: An order's grade from its priority, and its score from its price in tens of thousands.
GRADED = """
graded AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Major' WHEN o_orderpriority = '3-MEDIUM' THEN 'Moderate' ELSE 'Minor' END AS truth, floor(o_totalprice / 10000) AS score FROM orders),
cells AS (SELECT t.g AS truth, p.g AS predicted, coalesce(n, 0) AS n FROM (VALUES ('Minor'), ('Moderate'), ('Major')) t(g) CROSS JOIN (VALUES ('Minor'), ('Moderate'), ('Major')) p(g)
  LEFT JOIN (SELECT truth, CASE WHEN score >= 33 THEN 'Major' WHEN score >= 17 THEN 'Moderate' ELSE 'Minor' END AS predicted, count(*) AS n FROM graded GROUP BY ALL) x ON x.truth = t.g AND x.predicted = p.g)
"""


def graded(t: Tables):
    p = F.col("o_orderpriority")
    truth = F.when(p.isin("1-URGENT", "2-HIGH"), "Major").when(p == "3-MEDIUM", "Moderate").otherwise("Minor")
    return t.orders.select(truth.alias("truth"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"))


def cells(t: Tables):
    return stats.confusion(graded(t).withColumn("predicted", tier(F.col("score"), 17.0, 33.0)), "truth", "predicted", GRADES)


@query(f"WITH {GRADED} SELECT * FROM cells")
def confusion_matrix(t):
    return cells(t)


AGREEMENT = """
m AS (SELECT *, sum(n) OVER (PARTITION BY {k} truth)::DOUBLE AS rt, sum(n) OVER (PARTITION BY {k} predicted)::DOUBLE AS rp, sum(n) OVER ({o})::DOUBLE AS total, list_position(['Minor', 'Moderate', 'Major'], truth) AS i, list_position(['Minor', 'Moderate', 'Major'], predicted) AS j FROM cells),
s AS (SELECT {k} CAST(max(total) AS BIGINT) AS n, sum(CASE WHEN i = j THEN n / total ELSE 0 END) AS accuracy, avg(CASE WHEN i = j AND rt + rp > 0 THEN 2 * n / (rt + rp) END) AS macro_f1, sum((1 - abs(i - j) / 2.0::DOUBLE) * n / total) AS po,
  sum((1 - abs(i - j) / 2.0::DOUBLE) * rt * rp / total / total) AS pe, sum(CASE WHEN i = j THEN rt * rp / total / total ELSE 0 END) AS pc FROM m {g})
"""


@query(f"WITH {GRADED}, {AGREEMENT.format(k='', o='', g='')} SELECT n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round((po - pe) / (1 - pe), 6) AS kappa_linear, round((accuracy - pc) / (1 - pc), 6) AS kappa FROM s")
def agreement_scores(t):
    return stats.agreement(cells(t), GRADES).select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "kappa_linear", "kappa")])


@query("""
WITH e AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0::DOUBLE AS ry FROM e)
SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY event_type
""")
def spearman(t):
    rows = t.events.select("event_type", "value", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return stats.spearman(rows, ["event_type"], "value", "k").select("event_type", F.col("n").cast("bigint").alias("n"), F.round("rho", 6).alias("rho"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY event_type")
def quantile_thresholds(t):
    q = {"low": 0.25, "middle": 0.5, "high": 0.9}
    return t.events.groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(x)), 6).alias(c) for c, x in q.items()])


@query("SELECT event_type, count(*) AS n, max(value) FILTER (WHERE r = p50) AS p50, max(value) FILTER (WHERE r = p95) AS p95 FROM (SELECT event_type, value, row_number() OVER w AS r, round_even(0.5 * (count(*) OVER (PARTITION BY event_type) - 1), 0) + 1 AS p50, round_even(0.95 * (count(*) OVER (PARTITION BY event_type) - 1), 0) + 1 AS p95 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)) GROUP BY event_type")
def nearest_rank(t):
    return stats.nearest_rank(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(f"""
WITH {GRADED.split('cells AS')[0]} th AS (SELECT DISTINCT round(q, 2) AS threshold FROM (SELECT unnest(quantile_cont(score, [i / 20.0::DOUBLE FOR i IN range(1, 20)])) AS q FROM graded)),
h AS (SELECT score, truth, count(*) AS n FROM graded GROUP BY ALL),
cells AS (SELECT a.threshold AS lo, b.threshold AS hi, truth, CASE WHEN score >= b.threshold THEN 'Major' WHEN score >= a.threshold THEN 'Moderate' ELSE 'Minor' END AS predicted, sum(n) AS n FROM th a JOIN th b ON a.threshold < b.threshold CROSS JOIN h GROUP BY ALL),
{AGREEMENT.format(k='lo, hi,', o='PARTITION BY lo, hi', g='GROUP BY lo, hi')} SELECT lo, hi, round((po - pe) / (1 - pe), 6) AS kappa_linear, n FROM s ORDER BY 3 DESC, lo, hi LIMIT 1
""")
def threshold_search(t):
    rows = graded(t)
    candidates = t.spark.createDataFrame([(x,) for x in stats.threshold_candidates(rows, "score", 20)], "threshold double")
    return stats.threshold_search(rows, "score", "truth", candidates, GRADES)


@query(f"""
WITH {RECORDS}, held AS (SELECT DISTINCT a, b FROM records WHERE source = 'CURATED' AND CAST(('0x' || substr(md5('duo' || a || '||' || b), 1, 7)) AS BIGINT) % 100 < 10),
g AS (SELECT a, b, arg_min(severity, {RANK}) AS grade FROM records WHERE source = 'CURATED' GROUP BY a, b), s AS (SELECT DISTINCT a, b, true AS s FROM records WHERE source = 'SIGNAL'),
o AS (SELECT grade, CASE WHEN s THEN 'signal_only' ELSE 'no_data' END AS outcome FROM held JOIN g USING (a, b) LEFT JOIN s USING (a, b))
SELECT x.outcome, y.grade, count(o.grade) AS n FROM (VALUES ('signal_only'), ('no_data'), ('still_curated')) x(outcome) CROSS JOIN (VALUES ('Minor'), ('Moderate'), ('Major'), ('all')) y(grade)
LEFT JOIN o ON o.outcome = x.outcome AND (o.grade = y.grade OR y.grade = 'all') GROUP BY ALL
""")
def holdout_outcomes(t):
    all_records = records(t)
    curated = F.col("source") == "CURATED"
    grades = pairs.best_rows(all_records.where(curated).select("a", "b", "severity", "event"), ["a", "b"], [F.when(F.col("severity") == "Major", 0).when(F.col("severity") == "Moderate", 1).otherwise(2), F.col("event")])
    held = grades.where(stats.in_holdout(F.concat_ws("||", "a", "b"), "duo", 10)).select("a", "b", F.col("severity").alias("grade"))
    left = stats.holdout(all_records, held, curated).groupBy("a", "b").agg(F.max(curated).alias("curated"))
    outcome = F.when(F.col("curated").isNull(), "no_data").when(F.col("curated"), "still_curated").otherwise("signal_only")
    return stats.outcome_grid(held.join(left, ["a", "b"], "left").select(outcome.alias("outcome"), "grade"), "outcome", "grade", ["signal_only", "no_data", "still_curated"], GRADES)


@query("""
WITH t AS (SELECT doc_id, lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1), f AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
x AS (SELECT coalesce(t.lang, f.lang) AS lang, t.doc_id AS td, f.doc_id AS fd FROM t FULL JOIN f ON t.doc_id = f.doc_id AND t.lang = f.lang)
SELECT lang, count(*) FILTER (WHERE td IS NOT NULL AND fd IS NOT NULL) AS hits, count(*) FILTER (WHERE fd IS NULL) AS misses, count(*) FILTER (WHERE td IS NULL) AS surplus,
  round(hits / nullif(hits + misses, 0)::DOUBLE, 6) AS recall, round(hits / nullif(hits + surplus, 0)::DOUBLE, 6) AS precision FROM x GROUP BY lang
""")
def label_recall(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return stats.recall(rows.where("toxic = 1"), rows.where("quality = 0"), ["doc_id", "lang"], ["lang"])


@query("""
WITH x AS (SELECT l_orderkey, count(*) AS claims, count(*) FILTER (WHERE l_returnflag = 'R') AS wrong, count(*) FILTER (WHERE l_linestatus = 'F') AS cited, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R') AS valid FROM lineitem GROUP BY 1)
SELECT count(*) AS n, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(wrong) AS BIGINT) AS wrong, CAST(sum(cited) AS BIGINT) AS cited, CAST(sum(valid) AS BIGINT) AS valid, round(sum(wrong) / sum(claims)::DOUBLE, 6) AS wrong_rate, round(sum(valid) / sum(cited)::DOUBLE, 6) AS validity,
  (SELECT round(avg(valid / cited::DOUBLE), 6) FROM x WHERE cited > 0) AS mean_validity FROM x
""")
def micro_average(t):
    late = F.col("l_linestatus") == "F"
    rows = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("l_returnflag") == "R").alias("wrong"), F.count_if(late).alias("cited"), F.count_if(late & (F.col("l_returnflag") != "R")).alias("valid"))
    mean = rows.agg(F.round(stats.guarded_mean(F.col("valid"), F.col("cited")), 6).alias("mean_validity"))
    return stats.micro_average(rows, ["claims", "wrong", "cited", "valid"], {"wrong_rate": ("wrong", "claims"), "validity": ("valid", "cited")}).crossJoin(mean)  # one row each


@query(f"""
WITH {RECORDS}, x AS (SELECT request, count(source) FILTER (WHERE source = 'CURATED') AS alerts, count(*) FILTER (WHERE severity = 'Major') AS major FROM planned LEFT JOIN records USING (a, b) GROUP BY request)
SELECT count(*) AS requests, CAST(sum(alerts) AS BIGINT) AS total, round(quantile_cont(alerts, 0.5), 6) AS median, max(alerts) AS largest, round(count(*) FILTER (WHERE major > 0) / count(*)::DOUBLE, 6) AS share FROM x
""")
def alert_burden(t):
    per = records(t).groupBy("a", "b").agg(F.count_if(F.col("source") == "CURATED").alias("alerts"), F.count_if(F.col("severity") == "Major").alias("major"))
    found = pairs.lookup(planned(t), per, "left").groupBy("request").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("alerts", "major")])
    return stats.burden(found, "alerts", F.col("major") > 0)


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 6) AS good, round(count(*) FILTER (WHERE toxic = 1) / count(*)::DOUBLE, 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def subset_rollup(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return stats.subset_rates(rows, "lang", ["good", "toxic"])


@query("""
WITH n AS (SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'invalid' END AS verdict, count(*) AS n FROM events GROUP BY 1)
SELECT verdict, n, CASE WHEN verdict <> 'invalid' THEN round(n / (SELECT sum(n) FROM n WHERE verdict <> 'invalid')::DOUBLE, 6) END AS share FROM n
""")
def verdict_shares(t):
    return stats.verdict_shares(t.events, "event_type", ["click", "view", "purchase"])


@query("SELECT o_orderpriority, CASE WHEN s IS NULL OR m IS NULL THEN 'invalid' ELSE 'scored' END AS state, count(*) AS n, round(count(*) FILTER (WHERE s = m) / nullif(count(s), 0)::DOUBLE, 6) AS rate FROM (SELECT o_orderpriority, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS m FROM orders) GROUP BY ALL")
def rubric_scores(t):
    s, m = F.nullif("o_orderstatus", F.lit("P")), F.when(F.col("o_totalprice") > 250000, "F").otherwise("O")
    rows = t.orders.select("o_orderpriority", s.alias("s"), m.alias("m"))
    return rows.groupBy("o_orderpriority", F.when(F.col("s").isNull() | F.col("m").isNull(), "invalid").otherwise("scored").alias("state")).agg(F.count(F.lit(1)).alias("n"), rate(F.count_if(F.col("s") == F.col("m")), F.count("s"), 6).alias("rate"))

