"""Ids made from the contents of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(columns: list[Column]) -> Column:
    """Ten hex digits of the SHA-1 of the values, each after U+001F, null as empty."""
    return F.substring(F.sha1(F.concat(*[F.concat(F.lit("\x1f"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns])), 1, 10)


def content_ids(df: DataFrame, prefix: str, name: str = "record_id") -> DataFrame:
    """df with an id over all its columns in the order of their names; the second of equal rows ends in -2, and so on.

    Equal rows are told apart by a number only, so which of them gets it decides nothing.
    """
    columns = sorted(c for c in df.columns if c != name)
    base = df.withColumn("_id", F.concat(F.lit(f"{prefix}-"), digest([F.col(c) for c in columns])))
    n = F.row_number().over(Window.partitionBy("_id").orderBy(*columns))
    return base.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat("_id", F.lit("-"), "_n"))).drop("_id", "_n")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def citation_key(source: Column, ident: Column) -> Column:
    """The source in lower case and the id as it is, both trimmed."""
    return F.concat(F.lower(F.trim(source)), F.lit(":"), F.trim(ident))
