"""The admission stream gives what admit() gives, in whatever order hits arrive; it restarts, and forgets keys."""

import random

import pytest
from pyspark.sql import functions as F

from duoscope.streaming import limiter

SCHEMA = "key string, at double, note string, ts timestamp"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hits(spark, rows):
    return spark.createDataFrame(rows, "key string, at double, note string").withColumn("ts", F.col("at").cast("timestamp"))


def test_stream_equals_table_restarts_and_forgets(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    times = sorted(1_000_000.0 + rng.randint(0, 400) / 2 for _ in range(120))
    rows = [(rng.choice("abc"), at, f"n{i}") for i, at in enumerate(times)]
    near = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))  # out of order by less than the delay
    parts = [near[:40], near[40:80], [*near[80:], (None, 1_000_050.0, "x")], [("end", 1_009_000.0, "late")]]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def drain():
        made = limiter.admit_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), 3, 20.0, delay="10 seconds")
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()

    for part in parts:  # each is a query of its own, started from the checkpoint
        hits(spark, part).coalesce(1).write.mode("append").parquet(source)
        drain()
    got = sorted((r.key, r.at, r.note, r.allowed, r.retry_after) for r in spark.read.parquet(out).collect() if r.key != "end")
    want = sorted((r.key, r.at, r.note, r.allowed, r.retry_after) for r in limiter.admit(hits(spark, rows), 3, 20.0).collect())
    assert got == want and {a for *_, a, _ in got} == {True, False}
    for name in ("waiting", "passed"):
        left = spark.read.format("statestore").option("path", check).option("stateVarName", name).load()
        assert {r.key.key for r in left.collect()} <= {"end"}
