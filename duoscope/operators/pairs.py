"""Unordered pairs: orientation, enumeration, lookup of records, selection, and accounting of what was refused.

Null names make no pair. Ties are broken by the columns named in each function, so results don't depend on the order of
rows or files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import dimension


def orient(df: DataFrame, a: str, b: str, companions: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """df with a < b; columns that belong to a side change places with it. Rows with a = b or a null name go."""
    swap = F.col(a) > F.col(b)
    both = ((a, b), *companions)
    moved = {x: F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in both} | {y: F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in both}
    return df.where(F.col(a) != F.col(b)).withColumns(moved)


def of_names(df: DataFrame, names: str = "names") -> DataFrame:
    """df with a row for each pair a < b of a sorted array of distinct names, in place of the array.

    Each name is put beside the names after it, so a row never holds more than the array it came from.
    """
    rest = [c for c in df.columns if c != names]
    firsts = df.select(*rest, names, F.posexplode(names).alias("_i", "a")).where(F.col("_i") + 1 < F.size(names))
    return firsts.select(*rest, "a", F.explode(F.slice(names, F.col("_i") + 2, F.size(names))).alias("b"))


def name_sets(names: DataFrame, *more: Column, tasks: int | None = None) -> DataFrame:
    """request and names, the sorted distinct names of each request. names: (request, name).

    The pairs of a task's requests take many times the room of their names. tasks says over how many tasks the requests are dealt;
    without it Spark deals by the size of the names alone.
    """
    dealt = names if tasks is None else names.repartition(tasks, "request")
    return dealt.groupBy("request").agg(F.sort_array(F.collect_set("name")).alias("names"), *more)


def plan(names: DataFrame) -> DataFrame:
    """All pairs (request, a, b) of each request's distinct names. names: (request, name).

    The names of a request are gathered once, and a request of k names makes k (k - 1) / 2 rows, which is its answer.
    Requests are short (12 names in the service); oversized() lists those that are not.
    """
    return of_names(name_sets(names.where("request IS NOT NULL AND name IS NOT NULL")))


def oversized(names: DataFrame, most: int = 12) -> DataFrame:
    """Requests of more than `most` distinct names, with their number."""
    return names.groupBy("request").agg(F.countDistinct("name").alias("n_names")).where(F.col("n_names") > most)


def completeness(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each request its names, the pairs they should make, those planned, and whether these are as many."""
    k = names.groupBy("request").agg(F.countDistinct("name").alias("n_names"))
    n = pairs.distinct().groupBy("request").agg(F.count(F.lit(1)).alias("n_pairs"))
    expected = (F.col("n_names") * (F.col("n_names") - 1) / 2).cast("bigint")
    both = k.join(n, "request", "left").select("request", "n_names", expected.alias("n_expected"), F.coalesce("n_pairs", F.lit(0).cast("bigint")).alias("n_pairs"))
    return both.withColumn("complete", F.col("n_expected") == F.col("n_pairs"))


def best_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ascending order values (null first); partial minima are taken before the shuffle,
    so a hot key is no burden. The order must tell different rows apart."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")
    return df.groupBy(*key).agg(first).select(*key, *[F.col("_x")[c].alias(c) for c in rest])


def falling(c: str) -> list[Column]:
    """Order values for a number from large to small, null last."""
    return [F.col(c).isNull(), -F.col(c)]


def top_rows(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "position") -> DataFrame:
    """The first k rows of each key with their places. Spark keeps k rows a key on each side of the shuffle (window
    group limit), so a hot key reaches its task as k rows a partition."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def lookup(pairs: DataFrame, records: DataFrame, how: str = "inner") -> DataFrame:
    """The records (a, b, ...) of each planned pair (request, a, b); how = "left" keeps pairs without any.

    A pair's records are gathered before the join, so it meets a pair once for each request that plans it, and a broadcast (of
    counted pairs) leaves the requests where they are.
    """
    rest = [c for c in records.columns if c not in ("a", "b")]
    per = dimension(records.groupBy("a", "b").agg(F.collect_list(F.struct(*rest)).alias("_r")))
    met = pairs.join(per, ["a", "b"], how)
    each = F.inline_outer("_r") if how == "left" else F.inline("_r")
    return met.select(*pairs.columns, each)


def select_records(found: DataFrame, statistical: Column, order: list[Column], key: tuple[str, ...] = ("request", "a", "b"), shown: int = 3) -> DataFrame:
    """All curated records of a pair and its first `shown` statistical ones, each with its place, and how many are hidden."""
    by_kind = Window.partitionBy(*key, "_s")
    ranked = found.withColumn("_s", statistical).withColumn("position", F.row_number().over(by_kind.orderBy(*order)))
    n = F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(Window.partitionBy(*key))
    return ranked.withColumn("hidden", F.greatest(n - shown, F.lit(0))).where(~F.col("_s") | (F.col("position") <= shown)).drop("_s")


def shown_once(records: DataFrame, statistical: Column, order: list[Column], shown: int = 3) -> DataFrame:
    """The records that select_records() shows of each pair, with last and head as review() gives them."""
    done = select_records(records, F.coalesce(statistical, F.lit(False)), order, key=("a", "b"), shown=shown)
    last = F.coalesce(statistical & (F.col("hidden") > 0) & (F.col("position") == shown), F.lit(False))
    done = done.withColumns({"last": last, "head": F.row_number().over(Window.partitionBy("a", "b").orderBy(statistical, "position")) == 1})
    return done


def review(pairs: DataFrame, records: DataFrame, statistical: Column, order: list[Column], shown: int = 3, unique: bool = False) -> DataFrame:
    """Planned pairs with the records that select_records() shows; a pair without records is one row with
    nulls in their place.

    last marks the row after which a pair's hidden records are to be mentioned, head one row of each pair. What is shown of a pair
    is the same in all requests, so it is selected once, among the records. unique says that no pair is planned twice in a request, as
    plan() gives them; telling pairs apart holds all of a task's in memory.
    """
    done = shown_once(records, statistical, order, shown)
    return lookup(pairs if unique else pairs.distinct(), done, "left").withColumns({"position": F.coalesce("position", F.lit(1)), "hidden": F.coalesce("hidden", F.lit(0)), "last": F.coalesce("last", F.lit(False)), "head": F.coalesce("head", F.lit(True))})


def partition(pairs: DataFrame, records: DataFrame, unique: bool = False) -> DataFrame:
    """Every planned pair and whether any record is about it; each pair is in one part exactly. unique: as in review()."""
    known = dimension(records.select("a", "b").distinct().withColumn("_k", F.lit(True)))
    return (pairs if unique else pairs.distinct()).join(known, ["a", "b"], "left").select("request", "a", "b", F.coalesce("_k", F.lit(False)).alias("has_records"))


def charge(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """df with the name of the first rule that refuses each row (a null condition does not), or null for rows that stay."""
    return df.withColumn(out, F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules]))


def reject_counts(df: DataFrame, rules: list[tuple[str, Column]], pair: list[str], event: str, k: int) -> DataFrame:
    """reason and n: rows refused by each rule in turn, then repeats of a pair and event, then events of a pair beyond
    the best k, then those kept. The last three come from group sizes, so no group is sorted or collected."""
    charged = charge(df, rules)
    early = charged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    events = charged.where("reason IS NULL").groupBy(*pair, event).agg(F.count(F.lit(1)).alias("rows"))
    pairs = events.groupBy(*pair).agg(F.sum(F.col("rows") - 1).alias("duplicate"), F.count(F.lit(1)).alias("events"))
    late = pairs.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in (("duplicate", F.sum("duplicate")), ("top_k", F.sum(F.greatest(F.col("events") - k, F.lit(0)))), ("kept", F.sum(F.least(F.col("events"), F.lit(k)))))])
    return early.union(late.unpivot([], ["duplicate", "top_k", "kept"], "reason", "n")).where("n > 0")


def unmatched(df: DataFrame, name: str, vocabulary: DataFrame) -> DataFrame:
    """Names of df that vocabulary (name) lacks, with the rows they cost, most rows first by rank, then by name.

    A row counts once for each side it is unknown on, if df stacks the sides.
    """
    lost = df.select(F.col(name).alias("name")).join(vocabulary, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("rows_affected"))
    return lost.orderBy(F.desc("rows_affected"), "name")


def degree(pairs: DataFrame) -> DataFrame:
    """Rows of pairs (a, b) that each name is in, on either side."""
    return pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
