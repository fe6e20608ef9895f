"""Shards against sorting all rows."""

import pytest
from pyspark.sql import functions as F

from duoscope.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def brute(sizes, shards):
    """Shard and place of each of the sorted sizes."""
    total, before, out, seen = sum(sizes), 0, [], {}
    for s in sizes:
        k = shards * before // total
        out.append((k, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
        before += s
    return out


def test_query_equals_sorting(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    want = {(i, s, *p) for (i, _), s, p in zip(rows, sizes, brute(sizes, 16))}
    got = queries.op13_sharding(spark, SF).collect()
    assert {(r.doc_id, r["size"], r.shard, r.slot) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("sizes", [[1] * 500, [1] * 300 + [10_000] + [2] * 99, list(range(1, 400)), [5]])
def test_one_key_of_most_rows(spark, sizes):
    """Equal rows take any of the places of their key: shards and places as a whole are those of sorted rows."""
    df = spark.createDataFrame([(7 if i % 3 else None, s, "x") for i, s in enumerate(sizes)], "id long, n long, cell string").repartition(5)
    got = sharding.shard_by_size(df, F.col("n"), F.col("id"), shards=7).collect()
    assert len(got) == len(sizes)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    most, total = max(sizes), sum(sizes)
    before = 0
    for k in range(7):
        assert abs(before - total * k / 7) <= most
        before += sum(r.n for r in by.get(k, []))
    order = [r.id is not None for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)  # null keys first


def test_tolerance_nulls_names_and_empty(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 else None) for i in range(1000)], "id long, n long")
    got = sharding.shard_by_size(df, F.col("n"), F.col("id"), shards=4, tolerance=0.3)
    sums = [r[1] for r in got.groupBy("shard").agg(F.sum("n")).collect()]
    assert len(sums) == 4 and max(sums) - min(sums) < 0.6 * 900 / 4
    assert sharding.shard_by_size(df.where("id < 0"), F.col("n"), F.col("id")).count() == 0
    zero = sharding.shard_by_size(df.select("id", F.lit(0).alias("n")), F.col("n"), F.col("id"), shards=4)
    assert zero.count() == 1000
    with pytest.raises(ValueError, match="already has"):
        sharding.shard_by_size(df.withColumn("Slot", F.lit(1)), F.col("n"), F.col("id"))
    with pytest.raises(ValueError, match="negative"):
        sharding.shard_by_size(df.select("id", F.lit(-1).alias("n")), F.col("n"), F.col("id"))


def test_shards_are_written(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 7)) for i in range(100)], "id long, text string")
    done = sharding.shard_by_size(df, F.octet_length("text") + 1, F.col("id"), shards=3)
    sharding.write_shards(done, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2]
