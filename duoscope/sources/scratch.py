"""Tables between the steps of a job: written once, read by several later steps, deleted when the results are written.

They go to the folder that a cluster shares (spark.checkpoint.dir); where that is unset, as in tests, to the session's
warehouse. A written table cuts the lineage: an executor lost later costs no earlier step.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Folders that have not been deleted yet, with the thread that made each.
OPEN: list[tuple[SparkSession, str, int]] = []


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Has Spark delete the shuffle files of a query that runs in here as it ends. Else they stay until the driver's collector
    finds that nothing refers to them, and those of all steps of a job lie on disk at once."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as read back from a table of its own."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/steps/{name}-{uuid.uuid4().hex}"
    OPEN.append((spark, path, threading.get_ident()))
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_turns(n: int, work: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The rows of work(0) to work(n - 1), made one after the other. The tables that a turn keeps are deleted when its rows have been
    written, so that those of one turn lie on disk at a time."""
    done = []
    for i in range(n):
        before = list(OPEN)
        made = work(i)
        between = [e for e in OPEN if e not in before]
        done.append(kept(made, name))
        drop(between)
    return reduce(DataFrame.unionByName, done)


def drop(entries: list[tuple[SparkSession, str, int]]) -> None:
    """Deletes those of some tables that this thread has kept."""
    for entry in [e for e in entries if e[2] == threading.get_ident()]:
        spark, path, _ = entry
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        OPEN.remove(entry)


def release() -> None:
    """Deletes the tables that this thread has kept; call it once the results that read them have been written."""
    drop(list(OPEN))
