"""Disproportionality statistics of a pair and an event, as expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.names import dimension
from ..operators.pairs import of_names

Z = 1.959964


def two_by_two(df: DataFrame) -> DataFrame:
    """Adds n11, n10, n01, n00 from total, n_ab, n_e and n_abe; a negative cell is an error."""
    cells = {"n11": F.col("n_abe"), "n10": F.col("n_ab") - F.col("n_abe"), "n01": F.col("n_e") - F.col("n_abe"), "n00": F.col("total") - F.col("n_ab") - F.col("n_e") + F.col("n_abe")}
    made = df.withColumns(cells)
    bad = F.least(*cells) < 0
    return made.withColumns({c: F.when(bad, F.raise_error(F.concat(F.lit("counts contradict each other: "), F.to_json(F.struct(*cells)))).cast("bigint")).otherwise(F.col(c)) for c in cells})


def prr(a, b, c, d) -> Column:
    """Proportional reporting ratio; null without reports of either kind or with c = 0."""
    return F.when((a + b > 0) & (c + d > 0) & (c > 0), (a / (a + b)) / (c / (c + d)))


def log_ror(a, b, c, d) -> tuple[Column, Column]:
    """Log of the reporting odds ratio and its standard error, null where a cell is 0."""
    full = F.least(a, b, c, d) > 0
    return F.when(full, F.ln((a * d) / (b * c))), F.when(full, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def chi2(a, b, c, d) -> Column:
    """Chi-square with Yates' correction, floored at 0; null where a margin is 0."""
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.when(margins > 0, n * gap * gap / margins)


def assess(df: DataFrame, reports: int = 3, least_prr: float = 2.0, least_chi2: float = 4.0, factor: float = 2.0) -> DataFrame:
    """Adds the statistics, the three rates, all reasons against a signal and surfaced (no reason).

    Takes total, n_a, n_b, n_ab, n_e, n_ae, n_be, n_abe (long). Thresholds are tested on unrounded values; a rate that
    is undefined cannot speak against the pair.
    """
    df = two_by_two(df)
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    log, error = log_ror(a, b, c, d)
    df = df.withColumns({"prr": prr(a, b, c, d), "ror": F.exp(log), "ror_low": F.exp(log - Z * error), "ror_high": F.exp(log + Z * error), "chi2": chi2(a, b, c, d)})
    long = lambda x: F.col(x).cast("double")
    rates = {"pair_rate": F.try_divide(long("n_abe"), long("n_ab")), "rate_a": F.try_divide(long("n_ae") - long("n_abe"), long("n_a") - long("n_ab")), "rate_b": F.try_divide(long("n_be") - long("n_abe"), long("n_b") - long("n_ab"))}
    df = df.withColumns(rates)
    low = lambda x, y: F.coalesce(F.col(x) < y, F.lit(True))
    tests = [
        (F.col("n11") < reports, "few_reports"),
        (low("prr", least_prr), "low_prr"),
        (low("chi2", least_chi2), "low_chi2"),
        (F.coalesce(F.col("ror_low") <= 1, F.lit(True)), "low_ror"),
        (F.coalesce(F.col("pair_rate") < factor * F.col("rate_a"), F.lit(False)), "explained_by_a"),
        (F.coalesce(F.col("pair_rate") < factor * F.col("rate_b"), F.lit(False)), "explained_by_b"),
    ]
    df = df.withColumn("reasons", F.concat_ws(",", *[F.when(t, name) for t, name in tests]))
    return df.withColumn("surfaced", F.col("reasons") == "")


def counts(reports: DataFrame, events: DataFrame) -> DataFrame:
    """The counts that assess() takes, for every pair of names and event that some report has.

    reports: (report, name); events: (report, event); repeated rows and nulls count for nothing. Each report becomes one
    row of its names and events, and one aggregation with partial sums counts pairs, names and events, each with and
    without an event (null: all reports). A report of k names costs k * k rows; requests have a few names. The margins are
    broadcast where their counted size allows it.
    """
    named = reports.where("report IS NOT NULL AND name IS NOT NULL").groupBy("report").agg(F.sort_array(F.collect_set("name")).alias("names"))
    had = events.where("report IS NOT NULL AND event IS NOT NULL").groupBy("report").agg(F.collect_set("event").alias("events"))
    rows = named.join(had, "report", "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>"))).persist()
    of = lambda df, key: df.select(*key, F.explode(F.concat(F.array(F.lit(None).cast("string")), "events")).alias("event")).groupBy(*key, "event").agg(F.count(F.lit(1)).alias("n"))
    pairs = of(of_names(rows.drop("report")), ["a", "b"]).withColumn("n_ab", F.max(F.when(F.col("event").isNull(), F.col("n"))).over(Window.partitionBy("a", "b"))).where("event IS NOT NULL")
    sides = of(rows.select("events", F.explode("names").alias("name")), ["name"]).withColumn("all", F.max(F.when(F.col("event").isNull(), F.col("n"))).over(Window.partitionBy("name"))).where("event IS NOT NULL").persist()
    n_e = had.select(F.explode("events").alias("event")).groupBy("event").agg(F.count(F.lit(1)).alias("n_e"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    side = lambda key: dimension(sides.select(F.col("name").alias(key), "event", F.col("n").alias(f"n_{key}e"), F.col("all").alias(f"n_{key}")))
    return pairs.withColumnRenamed("n", "n_abe").join(dimension(n_e), "event").join(side("a"), ["a", "event"]).join(side("b"), ["b", "event"]).crossJoin(F.broadcast(total))  # one row
