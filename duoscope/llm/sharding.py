"""Sharding by a histogram sort: rows in the order of a key, in shards of equal size, with gapless places in them.

A row is in shard k where k <= shards * before / total < k + 1; before is the size of all rows with lesser keys. To find
where shards begin without sorting, the sizes below candidate keys (probes) are counted exactly: keys picked evenly by
their hash are the first probes; then new ones are picked between the two probes around each boundary, until no row is
left between them or the size is as near as `tolerance` asks. All probes together cut the keys into many small cells of
known counts, so a row's place is the count before its cell and its rank in the cell. Rows move once, to their cells: a
shard is many tasks, and no task holds one.

The key is a column of whole numbers, then a hash of the row, then the row's position in the table of keys that is
written first; so rows of one key, even a third of all, lie apart, and rows that are alike in all columns take any of
their places. Null keys come first, null sizes are 0, negative ones an error; where all sizes
are 0, all rows are in the last shard. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, tmp_name

#: Bytes of a key; rows of a cell that are aimed at, cells at most (their keys and counts go to all tasks: under 4 MB); new probes in each gap.
WIDTH, CELL, CELLS, PICKS = 25, 4_000, 65_536, 128


def sort_key(order: Column, digest: Column) -> Column:
    """Bytes that sort as order (null first), then digest, then position."""

    def eight(c: Column) -> Column:
        return F.unhex(F.lpad(F.hex(c), 16, "0"))

    flag = F.when(order.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    number = F.coalesce(order.cast("bigint"), F.lit(0).cast("bigint")).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(flag, eight(number), eight(digest), eight(F.monotonically_increasing_id()))


def as_keys(col: pa.Array) -> np.ndarray:
    """Keys as numpy values that compare byte by byte."""
    _, offs, data = col.buffers()
    first = np.frombuffer(offs, np.int32)[col.offset] if len(col) else 0
    return np.frombuffer(data, f"S{WIDTH}", len(col), first) if len(col) else np.zeros(0, f"S{WIDTH}")


def cell_of(key: Column, probes: list[bytes]) -> Column:
    """Number of probes that are not above the key."""
    edges = np.array(probes, f"S{WIDTH}")

    @arrow_udf("int")
    def cell(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, as_keys(keys), side="right"), pa.int32())

    return cell(key)


def picked(rows: DataFrame, by: list[str], count: int, key: str, salt: int) -> list[bytes]:
    """Up to count keys of each group, each the one of least hash in its share of the hashes."""
    h = F.xxhash64(F.col(key), F.lit(salt))
    best = rows.select(*by, F.pmod(h, F.lit(count)).alias("slot"), F.struct(h.alias("h"), F.col(key).alias("k")).alias("v")).groupBy(*by, "slot").agg(F.min("v").alias("v"))
    return [bytes(r[0]) for r in best.select("v.k").collect()]


def boundaries(keys: DataFrame, key: str, size: str, shards: int, tolerance: float = 0.0) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Probes in order, shard and place of the first row of each cell (one more than probes)."""
    rows, total, least = keys.agg(F.count(F.lit(1)), F.sum(size), F.min(size)).first()
    if not rows:
        return [], np.zeros(1, np.int64), np.zeros(1, np.int64)
    if least < 0:
        raise ValueError("a size is negative")
    aims = [k * total for k in range(1, shards)]
    probes = sorted(picked(keys, [], min(CELLS, max(64 * shards, rows // CELL)), key, 0))
    for turn in range(1, 200):
        counted = {r["cell"]: r for r in keys.select(cell_of(F.col(key), probes).alias("cell"), size).groupBy("cell").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).collect()}
        sizes = [int(counted[c]["size"]) if c in counted else 0 for c in range(len(probes) + 1)]
        ns = [counted[c]["n"] if c in counted else 0 for c in range(len(probes) + 1)]
        below, place = [0], [0]  # size and rows below the cell
        for s, n in zip(sizes, ns):
            below.append(below[-1] + s)
            place.append(place[-1] + n)
        # a boundary is the first key with shards * below >= aim; cell c holds what lies from probe c - 1 up to probe c
        gaps, starts = set(), []
        for aim in aims:
            c = next_cell(below, shards, aim)
            starts.append(c)
            # the probe that opens cell c meets the aim; rows strictly between it and the probe before could come first
            inside = ns[c - 1] - (1 if c > 1 else 0) if c else 0
            if inside > 0 and shards * below[c] - aim > tolerance * total:
                gaps.add(c - 1)
        if not gaps:
            owner = np.zeros(len(probes) + 1, np.int64)
            for c in starts:
                if c <= len(probes):
                    owner[c:] += 1
            first = np.array(place[:-1])
            opening = np.array([place[np.flatnonzero(owner == k)[0]] if (owner == k).any() else 0 for k in range(shards)])
            return probes, owner, first - opening[owner]
        near = keys.select(cell_of(F.col(key), probes).alias("cell"), key).where(F.col("cell").isin(sorted(gaps)))
        probes = sorted({*probes, *picked(near, ["cell"], PICKS, key, turn)})
    raise RuntimeError("boundaries were not found")


def next_cell(below: list[int], shards: int, aim: int) -> int:
    """The first cell whose beginning meets the aim; one past the last where only the end does."""
    lo, hi = 0, len(below) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if shards * below[mid] >= aim:
            hi = mid
        else:
            lo = mid + 1
    return lo


def shard_by_size(df: DataFrame, size: Column, order: Column, shards: int = 16, tolerance: float = 0.0, shard: str = "shard", slot: str = "slot", scratch: Scratch | None = None) -> DataFrame:
    """df with its shard (int) and its place in it (long, from 0).

    order: whole numbers. tolerance: how far a shard's beginning may be off, as a share of all sizes over the number of
    shards; 0 gives the exact boundary, so that each shard is within the size of one row of the others."""
    for name in (shard, slot):
        if name.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"the table already has a column {name}; choose another output name")
    if shards < 1:
        raise ValueError("at least one shard")
    scratch = scratch or Scratch(df.sparkSession, "sharding")
    key, weight, at = tmp_name(df, "_key"), tmp_name(df, "_size"), tmp_name(df, "_at")
    digest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{n.replace('`', '``')}`"))) if t.startswith(("map", "variant")) else F.col(f"`{n.replace('`', '``')}`") for n, t in df.dtypes])
    keyed = scratch.keep(df.select("*", sort_key(order, digest).alias(key), F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")).alias(weight)), "keys")
    probes, owner, first = boundaries(keyed.select(key, weight), key, weight, shards, tolerance)
    edges = np.array(probes, f"S{WIDTH}")

    @arrow_udf("struct<cell: int, shard: int, first: bigint>")
    def place(keys: pa.Array) -> pa.Array:
        cell = np.searchsorted(edges, as_keys(keys), side="right")
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(owner[cell], pa.int32()), pa.array(first[cell], pa.int64())], names=["cell", "shard", "first"])

    placed = keyed.withColumn(at, place(F.col(key)))
    rank = F.row_number().over(Window.partitionBy(F.col(at)["cell"]).orderBy(key))
    return placed.withColumn(slot, F.col(at)["first"] + rank - 1).withColumn(shard, F.col(at)["shard"]).drop(key, weight, at)


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """Writes each shard to a folder of its own, shard=k, in as many files as it has cells' tasks."""
    sharded.write.partitionBy(shard).parquet(path)
