"""Helpers shared by the training-data operators: Arrow text buffers, word boundaries, fingerprints, scratch tables."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import swept

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


FRUGAL: list[bool] = []


def give_back() -> None:
    """Has the memory of freed arrays go back to the system: a Python worker lives on, idle, after its task, and what the
    allocators keep would add up over the steps of a job. The C library's own limit rises with use; here it is fixed."""
    if not FRUGAL:
        FRUGAL.append(True)
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):  # not in every C library
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    pa.default_memory_pool().release_unused()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and the offset of each row in them (one more than rows); null is empty."""
    give_back()
    kind = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(kind)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"" if kind == pa.large_binary() else "", kind))
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def from_bytes(buf: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The reverse of utf8(): an array over one buffer, without a copy of each row."""
    if len(offs) and offs[-1] >= 2**31 - 1:
        raise ValueError("over 2 GB in one Arrow batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    kind = kind or pa.binary()
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1 ... of each segment, one segment after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def slices(offs: np.ndarray, size: int = 1 << 20):
    """First and last row (exclusive) of stretches of rows of some size bytes, one row at least; work on a stretch at a
    time bounds what numpy needs beside the batch."""
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes for which is_word holds; no run crosses a row."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    w = is_word[buf]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = w
    edges = offs[1:-1]
    first, last = w.copy(), w.copy()
    cut = before[:-1].copy()
    cut[edges[edges < n]] = False
    first &= ~cut
    nxt = np.zeros(n, bool)
    nxt[:-1] = w[1:]
    ends = offs[1:] - 1
    nxt[ends[ends >= 0]] = False
    last &= ~nxt
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each buf[start:end]."""
    lens = ends - starts
    h = lens.astype(np.uint64) * GOLD
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    idx, at = np.arange(len(starts)), 0
    while idx.size:
        rest = np.minimum(lens[idx] - at, 8).astype(np.uint64)
        part = eight[starts[idx] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        h[idx] = mix(h[idx] ^ part) + GOLD
        at += 8
        idx = idx[lens[idx] > at]
    return h


def tmp_name(df: DataFrame, stem: str = "_duo") -> str:
    """A column name that df does not have yet, whatever the case of its own."""
    have = {c.lower() for c in df.columns}
    while stem in have:
        stem += "_"
    return stem


def col(name: str) -> Column:
    """A top-level column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def at_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = at_path(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    at, fs = at_path(spark, path)
    if not fs.exists(at):
        return None
    with_stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
    finally:
        with_stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none where there is no such folder."""
    at, fs = at_path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that is not there yet; it is there whole or not at all."""
    at, fs = at_path(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    new, _ = at_path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(new, at):
        raise FileExistsError(path)


class Scratch:
    """Tables between the steps of a job, written as Parquet to the folder that the cluster shares (spark.checkpoint.dir).

    Writing a table cuts the lineage: an executor that is lost later costs no earlier step. Where the setting is
    missing, as in tests, the session's warehouse folder is used. Each table has a name of its own, so a second run never
    reads a first run's rows.
    """

    def __init__(self, spark: SparkSession, what: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.root = spark, f"{base.rstrip('/')}/duoscope/{what}-{uuid.uuid4().hex}"
        self.count, self.owner = 0, threading.get_ident()
        self.kept: dict[str, list[str]] = {}
        OPEN.append(self)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with swept(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.kept.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str, newest: int = 1) -> None:
        """Deletes all tables kept under a name but the newest; call it when nothing will read the others again."""
        paths = self.kept.get(name, [])
        while len(paths) > newest:
            self.delete(paths.pop(0))

    def drop(self) -> None:
        self.delete(self.root)

    def delete(self, path: str) -> None:
        delete(self.spark, path)


OPEN: list[Scratch] = []


def release() -> None:
    """Deletes all scratch tables; call it once the results that read them have been written."""
    while OPEN:
        OPEN.pop().drop()


def same_rows(df: DataFrame, name: str, make: Callable[[], Column]) -> DataFrame:
    """df with one more column, refusing to hide one that it has."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {name}; choose another output name")
    return df.withColumn(name, make())
