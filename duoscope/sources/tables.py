"""Canonical tables in a folder: Parquet, or CSV of the same name where there is no Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def _csv(path: str) -> str:
    return path.removesuffix(".parquet").removesuffix(".csv") + ".csv"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the table is there in one of its two forms, in any file system that Spark reads."""
    return _there(spark, path) or _there(spark, _csv(path))


def write_table(df: DataFrame, path: str) -> str:
    """Writes a table in place of the one before, as CSV unless the path says Parquet; gives the path written."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
        return path
    df.write.mode("overwrite").option("header", True).csv(_csv(path))
    return _csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The Parquet table, else the CSV beside it; text columns unless a schema is given. An error where neither is."""
    if path.endswith(".parquet") and _there(spark, path):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True) if schema is None else spark.read.option("header", True).schema(schema)
    for at in (_csv(path), path):
        if _there(spark, at):
            return reader.csv(at)
    raise FileNotFoundError(f"neither {path} nor {_csv(path)} exists")


def first_match(spark: SparkSession, folder: str, *patterns: str) -> str | None:
    """The first file, by name, of the first pattern that any file of the folder fits."""
    for pattern in patterns:
        at, fs = _fs(spark, f"{folder}/{pattern}")
        hits = sorted(str(s.getPath()) for s in fs.globStatus(at) or ())
        if hits:
            return hits[0]
    return None
