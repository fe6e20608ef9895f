"""Agreement, recall and rank statistics over tables of labels and scores.

Everything is computed from grouped counts: label pairs, score histograms and marginals are far smaller than the rows.
Empty denominators give null. Rows with a null label or score count nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rate, severity_rank
from ..sources.scratch import kept
from .names import dimension


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """truth, predicted and n for every pair of labels, those without rows included; other labels count nowhere."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], "truth string, predicted string")
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _marginals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells with their row and column sums and the total, each within keys."""
    part = lambda *c: Window.partitionBy(*keys, *c)
    return cells.withColumns({"of_truth": F.sum("n").over(part("truth")), "of_predicted": F.sum("n").over(part("predicted")), "total": F.sum("n").over(part())})


def agreement(cells: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """n, accuracy, macro_f1, kappa_linear (weights fall with the distance in labels) and kappa (no weights).

    cells is a confusion grid, one for each value of keys. F1 averages the classes that truth or prediction has; a kappa
    is null where chance alone agrees fully.
    """
    keys = keys or []
    place = lambda c: F.array_position(F.array(*map(F.lit, labels)), F.col(c)).cast("double")
    weight = 1 - F.abs(place("truth") - place("predicted")) / max(len(labels) - 1, 1)
    same = F.col("truth") == F.col("predicted")
    chance = F.col("of_truth").cast("double") * F.col("of_predicted") / F.col("total") / F.col("total")
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    f1 = F.try_divide(F.col("n") * F.lit(2.0), (F.col("of_truth") + F.col("of_predicted")).cast("double"))
    sums = _marginals(cells, keys).where("total > 0").groupBy(*keys).agg(
        F.max("total").alias("n"), F.sum(F.when(same, share).otherwise(0.0)).alias("accuracy"), F.avg(F.when(same & (F.col("of_truth") + F.col("of_predicted") > 0), f1)).alias("macro_f1"),
        F.sum(weight * share).alias("po"), F.sum(weight * chance).alias("pe"), F.sum(F.when(same, chance).otherwise(0.0)).alias("pc"),
    )
    kappa = lambda o, e: F.when(F.abs(1 - F.col(e)) > 1e-12, (F.col(o) - F.col(e)) / (1 - F.col(e)))
    return sums.select(*keys, "n", "accuracy", "macro_f1", kappa("po", "pe").alias("kappa_linear"), kappa("accuracy", "pc").alias("kappa"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, value and the average rank of each distinct value within keys, ties sharing theirs.

    Equal values are counted before they are ordered, so a hot group is ordered by its distinct values.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return n.select(*keys, value, (upto - (F.col("_n") - 1) / 2).alias(out))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n and rho: Pearson's correlation of average ranks; null for under two rows or a side without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("w"))
    ranked = pairs.join(average_ranks(both, keys, x, "rx"), [*keys, x]).join(average_ranks(both, keys, y, "ry"), [*keys, y])
    sums = ranked.groupBy(*keys).agg(*[F.sum(F.col("w") * c).alias(n) for n, c in (("n", F.lit(1)), ("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") * F.col("rx")), ("syy", F.col("ry") * F.col("ry")), ("sxy", F.col("rx") * F.col("ry")))])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return sums.select(*keys, "n", F.when((n > 1) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy)).alias("rho"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and for each share q the value at place round(q (n - 1)) of the ordered ones, halves to even."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    part = Window.partitionBy(*keys)
    runs = n.withColumns({"_to": F.sum("_n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(part)})
    at = lambda q: F.bround(F.lit(q) * (F.col("_all") - 1)) + 1
    return runs.groupBy(*keys).agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_to") >= at(q), F.col(value))).alias(c) for c, q in shares.items()])


def threshold_candidates(df: DataFrame, score: str, steps: int = 60, digits: int = 2) -> list[float]:
    """Distinct rounded quantiles i / steps of a score: at most steps - 1 numbers, brought to the driver."""
    found = df.agg(F.percentile(score, F.array(*[F.lit(i / steps) for i in range(1, steps)])).alias("q")).first()["q"]
    return sorted({round(q, digits) for q in found or []})


def threshold_search(df: DataFrame, score: str, grade: str, candidates: DataFrame, labels: list[str]) -> DataFrame:
    """The pair lo < hi of candidates (threshold) whose tiers agree best with the grades by linear kappa, lowest pair first.

    The rows are first counted by the number of candidates that a score reaches, so each pair meets at most
    (candidates + 1) * grades counts, whatever the input.
    """
    listed = candidates.agg(F.sort_array(F.collect_set("threshold")).alias("_t"))
    level = F.size(F.filter("_t", lambda t: F.col(score) >= t))
    hist = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(listed)).groupBy(level.alias("level"), F.col(grade).alias("truth")).agg(F.count(F.lit(1)).alias("n"))  # one row of candidates
    places = candidates.distinct().withColumn("place", F.row_number().over(Window.orderBy("threshold")))  # a few dozen rows
    lo, hi = (places.select(F.col("threshold").alias(c), F.col("place").alias(f"{c}_at")) for c in ("lo", "hi"))
    grid = lo.join(hi, F.col("lo_at") < F.col("hi_at"))
    tier = F.when(F.col("level") >= F.col("hi_at"), labels[2]).when(F.col("level") >= F.col("lo_at"), labels[1]).otherwise(labels[0])
    cells = F.broadcast(grid).crossJoin(hist).groupBy("lo", "hi", "truth", tier.alias("predicted")).agg(F.sum("n").alias("n"))
    scored = agreement(cells, labels, ["lo", "hi"]).where("kappa_linear IS NOT NULL").withColumn("kappa_linear", F.round("kappa_linear", 6))
    return scored.orderBy(F.desc("kappa_linear"), "lo", "hi").limit(1).select("lo", "hi", "kappa_linear", "n")


def recall(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Hits, misses and surplus of found against truth within by, with recall and precision."""
    t, f = truth.select(*keys).distinct().withColumn("_t", F.lit(1)), found.select(*keys).distinct().withColumn("_f", F.lit(1))
    both = t.join(f, keys, "full").groupBy(*by).agg(F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("hits"), F.count_if(F.col("_f").isNull()).alias("misses"), F.count_if(F.col("_t").isNull()).alias("surplus"))
    return both.withColumns({"recall": rate(F.col("hits"), F.col("hits") + F.col("misses"), 6), "precision": rate(F.col("hits"), F.col("hits") + F.col("surplus"), 6)})


def micro_average(df: DataFrame, counts: list[str], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums of counts and the rates of the sums (not means of rates), with the number of rows."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
    return sums.withColumns({name: rate(F.col(x), F.col(y), 6) for name, (x, y) in rates.items()})


def guarded_mean(part: Column, whole: Column) -> Column:
    """Mean of part / whole over rows whose whole is not 0."""
    return F.avg(F.try_divide(part.cast("double"), whole.cast("double")))


def burden(rows: DataFrame, count: str, flag: Column) -> DataFrame:
    """Totals, mean, median (between the middle two of an even number), largest, and the share of rows with flag."""
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.sum(count).cast("bigint").alias("total"), F.round(F.percentile(count, F.lit(0.5)), 6).alias("median"), F.max(count).alias("largest"), rate(F.count_if(flag), F.count(F.lit(1)), 6).alias("share"))


def in_holdout(key: Column, seed: str, percent: int) -> Column:
    """A sample of keys that depends on the key and the seed alone: every row of a key falls on the same side."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 7), 16, 10).cast("bigint") % 100 < percent


def holdout(records: DataFrame, held: DataFrame, curated: Column) -> DataFrame:
    """records without the curated rows of held pairs (a, b); statistical rows of those pairs stay."""
    return records.where(~curated).unionByName(records.where(curated).join(held.select("a", "b"), ["a", "b"], "left_anti"))


def outcome_grid(df: DataFrame, outcome: str, grade: str, outcomes: list[str], grades: list[str]) -> DataFrame:
    """outcome, grade ("all" for the sum) and n; cells without rows are kept."""
    grid = df.sparkSession.createDataFrame([(o, g) for o in outcomes for g in [*grades, "all"]], "outcome string, grade string")
    n = df.select(F.col(outcome).alias("outcome"), F.explode(F.array(F.col(grade), F.lit("all"))).alias("grade")).groupBy("outcome", "grade").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, ["outcome", "grade"], "left").select("outcome", "grade", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def subset_rates(df: DataFrame, subset: str, flags: list[str]) -> DataFrame:
    """Share of each flag within every subset and over all ("all"), in one pass."""
    made = df.groupingSets([[F.col(subset)], []], F.col(subset)).agg(F.grouping(subset).alias("_g"), F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f"_{f}") for f in flags])
    return made.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(subset)).alias(subset), "n", *[rate(F.col(f"_{f}"), F.col("n"), 6).alias(f) for f in flags])


def verdict_shares(df: DataFrame, verdict: str, valid: list[str]) -> DataFrame:
    """verdict, n and share among valid verdicts; others are counted as invalid, without a share."""
    n = df.select(F.when(F.col(verdict).isin(valid), F.col(verdict)).otherwise("invalid").alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    total = n.where("verdict <> 'invalid'").agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("verdict", "n", F.when(F.col("verdict") != "invalid", rate(F.col("n"), F.col("_t"), 6)).alias("share"))  # one row of totals


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may be missing here and there (null then)."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group and its count; of equally common ones the least. Nulls do not count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def unblind(answers: DataFrame, key: DataFrame, verdicts: list[str]) -> DataFrame:
    """Each answer (id, human) with its judge's verdict from the key (id, judge), and what it counts as: blank (no answer),
    invalid (no such verdict, or an id that the key lacks) or scored."""
    said = F.lower(F.trim(F.coalesce("human", F.lit(""))))
    rows = answers.withColumn("human", said).join(key, "id", "left")
    kind = F.when(F.col("human") == "", "blank").when(~F.col("human").isin(verdicts) | F.col("judge").isNull(), "invalid").otherwise("scored")
    return rows.select("id", "human", "judge", kind.alias("kind"))


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rates of runs (drafts, first_passed, source) of each group: first drafts that passed, failed ones that a retry
    mended, and those that fell back. Runs without a draft are counted but have no part in the rates."""
    eligible = F.col("drafts") > 0
    failed = eligible & ~F.col("first_passed")
    n = {"cases": F.count(F.lit(1)), "eligible": F.count_if(eligible), "p": F.count_if(eligible & F.col("first_passed")), "f": F.count_if(failed), "r": F.count_if(failed & (F.col("source") == "retry")), "b": F.count_if(eligible & (F.col("source") == "fallback"))}
    done = runs.groupBy(*by).agg(*[c.alias(k) for k, c in n.items()])
    return done.select(*by, "cases", "eligible", rate(F.col("p"), F.col("eligible")).alias("first_pass_rate"), rate(F.col("r"), F.col("f")).alias("recovery_rate"), rate(F.col("b"), F.col("eligible")).alias("fallback_rate"))


OUTCOMES = ("DETECTED", "LISTED_UNGRADED", "NO_DATA", "SILENT", "UNRESOLVED")


def reference_outcomes(rows: DataFrame, records: DataFrame, curated: Column) -> DataFrame:
    """rows (a, b, known, declared, ...) with what was found about each pair, and its most severe curated grade.

    UNRESOLVED: a name is not known, or both are the same; DETECTED: a curated record with a grade; LISTED_UNGRADED: other
    records only; NO_DATA: none, and the report says so (declared); SILENT: none, and it does not. Null flags are false.
    """
    rank = F.when(curated & F.col("severity").isin("Major", "Moderate", "Minor"), severity_rank(F.col("severity")))
    best = records.groupBy("a", "b").agg(F.min(rank).alias("_rank"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    found = rows.withColumns({"_a": low, "_b": high}).join(best.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "_rank", F.lit(True).alias("_any")), ["_a", "_b"], "left")
    known = F.coalesce(F.col("known"), F.lit(False)) & F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    outcome = F.when(~known, "UNRESOLVED").when(F.col("_rank").isNotNull(), "DETECTED").when(F.col("_any"), "LISTED_UNGRADED").when(F.col("declared"), "NO_DATA").otherwise("SILENT")
    grade = F.when(known, F.try_element_at(F.array(*map(F.lit, ("Major", "Moderate", "Minor"))), F.col("_rank") + 1))
    return found.withColumns({"outcome": outcome, "grade": grade}).drop("_a", "_b", "_rank", "_any")


def reference_rates(found: DataFrame) -> DataFrame:
    """One row over reference_outcomes() with expected and min_severity: how many pairs that interact were detected, or
    listed at least, and how many of the detected have a grade below the least that the reference states."""
    positive = F.col("expected") == "interaction"
    hit = positive & (F.col("outcome") == "DETECTED")
    under = hit & F.col("min_severity").isin("Major", "Moderate", "Minor") & (severity_rank(F.col("grade")) > severity_rank(F.col("min_severity")))
    n = {"positives": positive, "controls": F.col("expected") == "none", "detected": hit, "listed": positive & (F.col("outcome") == "LISTED_UNGRADED"), "under_triaged": under, "silent": F.col("outcome") == "SILENT"}
    sums = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in n.items()])
    return sums.withColumns({"recall_graded": rate(F.col("detected"), F.col("positives")), "recall_listed": rate(F.col("detected") + F.col("listed"), F.col("positives")), "under_triage_rate": rate(F.col("under_triaged"), F.col("detected"))})


def exact_sample(df: DataFrame, key: list[str], seed: str, by: list[str] | None = None, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """Exactly n rows of each group, or round(fraction * its rows) (half to even, one at least), with their place from 1 on.

    The rows are those with the smallest MD5 of seed and key, so neither partitions nor other groups change them; key should
    tell rows apart (equal ones come in any order). No group is sorted as a whole: its rows are counted by the first four
    digits of the hash, what lies beyond the digits that reach the number goes before any shuffle, and places are ranks
    within equal digits behind the counts before them. Groups may be null; a group with fewer than n rows is taken whole.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    by = by or []
    group = {f"_g{i}": F.col(c) for i, c in enumerate(by)}
    hashed = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    rows = df.withColumns({**group, "_h": hashed}).withColumn("_b", F.substring("_h", 1, 4))
    counted = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group)
    sums = counted.withColumns({"_before": F.coalesce(F.sum("_n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(over)})
    wanted = F.lit(n).cast("bigint") if n is not None else F.greatest(F.lit(1), F.bround(F.lit(float(fraction)) * F.col("_all"))).cast("bigint")
    sums = kept(sums.withColumn("_k", wanted).where("_before < _k").drop("_n", "_all"), "sample")
    last = sums.groupBy(*group, "_k").agg(F.max("_b").alias("_last")).select(*[F.col(g).alias(f"{g}x") for g in group], "_k", "_last")
    same = [F.col(g).eqNullSafe(F.col(f"{g}x")) for g in group]
    near = rows.join(dimension(last), reduce(lambda x, y: x & y, same, F.col("_b") <= F.col("_last"))).drop("_last", *[f"{g}x" for g in group])
    before = sums.select(*[F.col(g).alias(f"{g}x") for g in group], F.col("_b").alias("_bx"), "_before")
    near = near.join(before, reduce(lambda x, y: x & y, same, F.col("_b") == F.col("_bx")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", *key))
    return near.withColumn("place", place.cast("bigint")).where("place <= _k").select(*df.columns, "place")
