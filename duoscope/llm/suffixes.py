"""Removal of long byte strings that stand more than once, by a family of sampled suffix arrays.

Sampling. Every string of `length` bytes holds an anchor: the place of its least `k`-gram by fingerprint, leftmost
first. Equal strings have equal anchors, so only suffixes that begin at anchors are indexed, one in some (length - k) / 2
bytes. A suffix array holds them in the order of the fingerprint of their first k bytes and then of their context, the
text around the anchor that all strings anchored there cover; equal neighbours are one entry with a count. This order
serves as well as the alphabetical one, since only equality of k bytes and more is asked for, and it spreads evenly.

Family. The rows are taken in batches. A batch gets its own array and is merge-scanned against the arrays of all levels:
a k-gram that repeats, in the batch or between it and a level, marks a match. Then the batch becomes a level, and two
levels of one rank merge into one of the next, so n batches leave at most log2(n) + 1 levels. Levels are tables in a
folder with numbered lists of them, of which the newest counts, so a later session can open the family and insert a batch
without building it again. A list names only whole levels and is deleted after the next one has been written, so an
insertion that stops anywhere leaves a list in force; of two insertions at one time the later fails.

Decision. An anchor whose whole context repeats has all its strings repeated. For the other marked anchors the contexts
of one k-gram are brought together, one for each distinct context, and every string in them is compared by
fingerprint; all strings of an anchor overlap in it, so what they cover is one span. A k-gram with very many different
contexts (more than `hot`) is not gathered: its strings are counted by an aggregation over fingerprints.

Fingerprints have 64 bits, are sums over mixed 8-byte pieces, and strings are compared only within one k-gram's
fingerprint, so a false match takes equality of two of them. Texts are UTF-8 bytes, null is empty; matches never cross rows. Repeated rows are occurrences of their own.
Shorter rows than length are never touched. Rows are told apart by id and text; other columns are left out.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import GOLD, Scratch, col, delete, mix, names_in, read_text, slices, spread, utf8, write_new

BASE = np.uint64(0x5851F42D4C957F2D)
#: Bytes that are one symbol of a fingerprint; sums over single bytes are alike for some texts of two letters.
SYMBOL = 8


class Powers:
    """Powers of BASE and of its inverse, as many as a stretch of text needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            steps = np.full(n + 1, BASE)
            steps[0] = 1
            cls.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
            cls.down = np.cumprod(steps, dtype=np.uint64)
        return cls.up, cls.down


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = Powers.of(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    eight = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(SYMBOL, np.uint8)]), strides=(1,))
    np.cumsum(mix(eight + GOLD) * up[: len(buf)], out=sums[1:])
    return sums


def prints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the stretches start:end, of SYMBOL bytes or more; equal ones have equal ones wherever they stand."""
    _, down = Powers.of(len(sums) - 1)
    return mix((sums[end - (SYMBOL - 1)] - sums[start]) * down[start])


def anchors(buf: np.ndarray, offs: np.ndarray, k: int, length: int):
    """Row, place, first and last window of each anchor, its k-gram's and its context's fingerprint.

    The anchor of a window of length bytes is the place of its least k-gram by fingerprint, leftmost first.
    """
    n = len(buf)
    window = length - k + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    sums = prefix_sums(buf)
    at = np.arange(n - k + 1)
    grams = prints(sums, at, at + k)
    bits = np.uint64(max(n, 2).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (grams & ~low) | at.astype(np.uint64)
    width = 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = window - width
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    least = (key & low).astype(np.int64)
    fits = np.zeros(n + 1, np.int64)
    has = np.diff(offs) >= length
    np.add.at(fits, offs[:-1][has], 1)
    np.add.at(fits, offs[1:][has] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(fits[: len(least)]) > 0)
    if not len(start):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    place = least[start]
    row = np.searchsorted(offs, start, side="right") - 1
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    lo, hi = start[fresh], start[np.append(fresh[1:], len(start)) - 1]
    place, row = place[fresh], row[fresh]
    context = mix(prints(sums, lo, hi + length) ^ mix((place - lo).astype(np.uint64) * GOLD + (hi - lo).astype(np.uint64)))
    return row, place, lo, hi, grams[place], context


#: Rows and list items, of some 50 bytes each, of a table that is sent to all executors; a larger one is joined by a shuffle.
SMALL = 1_000_000
#: Bytes of text taken at a time: what numpy makes of them fits a core's cache.
SLICE = 1 << 16


def anchor_rows(batches, k: int, length: int):
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        found = []
        for a, b in slices(offs, SLICE):
            row, place, lo, hi, gram, context = anchors(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k, length)
            base = (offs[a:b] - offs[a])[row]
            found.append((row + a, gram, context, place - base, lo - base, hi - base))
        if found:
            row, gram, context, *ints = (np.concatenate(x) for x in zip(*found))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), *(pa.array(x, pa.int32()) for x in ints)], names=["doc", "key", "gram", "context", "place", "lo", "hi"])


def context_rows(batches, length: int):
    """Of each row with anchors to compare (columns doc, key, text, asked): the bytes of each context."""
    for batch in batches:
        out = [[] for _ in range(8)]
        held = 0
        for doc, key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            raw = (text.as_py() or "").encode()
            for x in asked:
                part = raw[x["lo"] : x["hi"] + length]
                for o, v in zip(out, (x["gram"], x["n"], x["hot"], doc, key, x["lo"], x["hi"], part)):
                    o.append(v)
                held += len(part)
            if held > 8 << 20:
                yield contexts_batch(out)
                out, held = [[] for _ in range(8)], 0
        if out[0]:
            yield contexts_batch(out)


def contexts_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["gram", "n", "hot", "doc", "key", "lo", "hi", "bytes"])


def windows_of(col: pa.Array, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all strings of each context, and the number of the context of each."""
    buf, offs = utf8(col)
    count = (hi - lo + 1).astype(np.int64)
    found = []
    for a, b in slices(offs, SLICE):
        sums = prefix_sums(buf[offs[a] : offs[b]])
        at = spread(offs[a:b] - offs[a], count[a:b])
        found.append(prints(sums, at, at + length))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.repeat(np.arange(len(count)), count)


def span_batch(batch: pa.RecordBatch, repeated: np.ndarray, owner: np.ndarray, length: int) -> pa.RecordBatch:
    """The span of the repeated strings of each context that stands once."""
    lo = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.searchsorted(owner, np.arange(len(lo)))
    place = np.arange(len(owner)) - first[owner]
    hit = np.flatnonzero(repeated)
    who = owner[hit]
    edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    who_, begin = who[edge], place[hit[edge]]
    end = place[hit[np.append(edge[1:], len(who)) - 1]] if len(who) else begin
    rows = pa.array(who_, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(3).take(rows), batch.column(4).take(rows), pa.array(lo[who_] + begin, pa.int32()), pa.array(lo[who_] + end + length, pa.int32())], names=["doc", "key", "start", "end"])


def compare_rows(batches, length: int):
    """Spans of contexts (sorted by gram) that hold a string found in another context of the same gram, or in a repeated one."""

    def judge(batch):
        n = np.minimum(batch.column(1).to_numpy(zero_copy_only=False), 2)
        lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
        tokens, owner = windows_of(batch.column(7), lo, hi, length)
        gram = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        _, same = np.unique(mix(tokens ^ mix(gram[owner])), return_inverse=True)
        repeated = np.bincount(same, weights=n[owner])[same] >= 2 if len(same) else np.zeros(0, bool)
        return span_batch(batch, repeated & (n[owner] == 1), owner, length)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > 4 << 20:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram = whole.column(0).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            if last:
                yield judge(whole.slice(0, last))
            held = [whole.slice(last)]
            size = sum(b.nbytes for b in held) // 2 if not last else 0
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is not None and len(table):
        yield judge(table.to_batches()[0])


class Family:
    """Levels of suffix arrays by rank, at most one of each, in a folder that outlives the session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        lists = [n for n in names_in(spark, self.root) if re.fullmatch(r"levels-\d{9}\.json", n)]
        self.turn = int(max(lists)[7:16]) if lists else 0
        text = read_text(spark, f"{self.root}/{max(lists)}") if lists else None
        self.levels: dict[int, str] = {int(k): v for k, v in json.loads(text).items()} if text else {}

    def level(self, rank: int) -> DataFrame:
        return self.spark.read.schema(ARRAY).parquet(f"{self.root}/{self.levels[rank]}")

    def write(self, array: DataFrame) -> str:
        name = f"level-{uuid.uuid4().hex}"
        array.repartition("gram").sortWithinPartitions("gram", "context").write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return name

    def insert(self, batch: DataFrame) -> DataFrame:
        """Adds anchors (gram, context): sorts them, scans them against every level, merges levels of one rank, and gives
        the grams (written out) that repeat in the batch or stand in it and in a level."""
        name = self.write(batch.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n")))
        array = self.spark.read.schema(ARRAY).parquet(f"{self.root}/{name}")
        grams = array.groupBy("gram").agg(F.sum("n").alias("n"))
        matches = grams.where("n > 1").select("gram")
        for rank in self.levels:
            matches = matches.union(grams.select("gram").join(self.level(rank).select("gram"), "gram", "left_semi"))
        found = f"{self.root}/matches-{uuid.uuid4().hex}"
        matches.distinct().write.option("compression", "zstd").parquet(found)
        levels, rank, merged_in = dict(self.levels), 0, []
        while rank in levels:
            merged_in += [name, levels.pop(rank)]
            both = self.spark.read.schema(ARRAY).parquet(*[f"{self.root}/{x}" for x in merged_in[-2:]])
            name = self.write(both.groupBy("gram", "context").agg(F.sum("n").alias("n")))
            rank += 1
        levels[rank] = name
        write_new(self.spark, f"{self.root}/levels-{self.turn + 1:09}.json", json.dumps(levels))
        self.levels, self.turn = levels, self.turn + 1
        for old in [*merged_in, f"levels-{self.turn - 1:09}.json"]:
            delete(self.spark, f"{self.root}/{old}")
        return self.spark.read.schema("gram bigint").parquet(found)


ARRAY = "gram bigint, context bigint, n bigint"


def spread_small(df: DataFrame, items: str | None = None) -> DataFrame:
    """df, to be sent to all executors where its rows and the items of its lists are few."""
    n = df.agg(F.count(F.lit(1)) + (F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0))).first()[0]
    return F.broadcast(df) if n <= SMALL else df


ANCHORS = "doc bigint, key bigint, gram bigint, context bigint, place int, lo int, hi int"


def anchors_of(rows: DataFrame, k: int, length: int) -> DataFrame:
    return rows.mapInArrow(lambda it: anchor_rows(it, k, length), ANCHORS)


def repeated_spans(rows: DataFrame, k: int = 128, length: int = 400, batches: int = 4, hot: int = 20_000) -> DataFrame:
    """doc, key and spans (start and end in bytes, sorted, apart) of each row (doc, key, text) with a repeated string."""
    scratch = Scratch(rows.sparkSession, "suffixes")
    found = scratch.keep(anchors_of(rows, k, length), "anchors")
    family, matches = Family(rows.sparkSession, f"{scratch.root}/family"), []
    for b in range(batches):
        matches.append(family.insert(found.where(F.pmod("key", F.lit(batches)) == b).select("gram", "context")))
    marked = matches[0]
    for more in matches[1:]:
        marked = marked.union(more)
    marked = scratch.keep(marked.distinct(), "marked")
    near = scratch.keep(found.join(spread_small(marked), "gram", "left_semi"), "near")
    delete(rows.sparkSession, f"{scratch.root}/family")
    scratch.forget("anchors", 0)
    return compared(rows, near, scratch, length, hot)


def repeating_rows(rows: DataFrame, done: DataFrame, k: int = 64, length: int = 200, hot: int = 20_000) -> DataFrame:
    """doc, key and spans of the rows outside done (doc, key) in which a string of length bytes stands that stands
    elsewhere too, in any row.

    The grams of all rows are counted, but only those that stand in a row outside done are looked at further.
    """
    scratch = Scratch(rows.sparkSession, "passages")
    twice = anchors_of(rows, k, length).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    twice = scratch.keep(twice, "twice")
    there = spread_small(done.withColumnsRenamed({"doc": "d", "key": "q"}))
    others = rows.join(there, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")), "left_anti")
    wanted = scratch.keep(anchors_of(others, k, length).select("gram").distinct().join(twice, "gram", "left_semi"), "wanted")
    near = scratch.keep(anchors_of(rows, k, length).join(spread_small(wanted), "gram", "left_semi"), "near")
    spans = compared(rows, near, scratch, length, hot)
    return spans.join(there, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")), "left_anti")


def compared(rows: DataFrame, near: DataFrame, scratch: Scratch, length: int, hot: int) -> DataFrame:
    """The spans of rows, given all anchors whose gram repeats: by whole contexts, then by the strings of the others."""
    one = F.struct("doc", "key", "lo", "hi")
    contexts = scratch.keep(near.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "contexts")
    whole = near.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi").select("doc", "key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    groups = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("gram", (F.col("m") > hot).alias("hot"))
    asked = contexts.join(groups, "gram").select("one.doc", "one.key", F.struct("gram", "n", "hot", "one.lo", "one.hi").alias("x")).groupBy("doc", "key").agg(F.collect_list("x").alias("asked"))
    asked = scratch.keep(asked, "asked")
    texts = rows.join(spread_small(asked.withColumnsRenamed({"doc": "d", "key": "q"}), "asked"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")))
    # rows that are the same in id and text ask the same; one of them answers for all
    parts = texts.select("doc", "key", "text", "asked").mapInArrow(lambda it: context_rows(it, length), "gram bigint, n bigint, hot boolean, doc bigint, key bigint, lo int, hi int, bytes binary")
    parts = scratch.keep(parts.dropDuplicates(["doc", "key", "gram", "lo"]), "parts")
    spans = parts.where("NOT hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda it: compare_rows(it, length), "doc bigint, key bigint, start int, end int")
    spans = spans.union(whole).union(hot_spans(parts.where("hot"), length))
    by = spans.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))).alias("all"))
    return scratch.keep(by.select("doc", "key", merged("all").alias("spans")), "spans")


def hot_spans(parts: DataFrame, length: int) -> DataFrame:
    """As compare_rows(), string by string: counted by gram and fingerprint before the shuffle, then joined back."""

    def strings(batches):
        for batch in batches:
            lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            tokens, owner = windows_of(batch.column(7), lo, hi, length)
            first = np.searchsorted(owner, np.arange(len(lo)))
            rows = pa.array(owner, pa.int64())
            start = lo[owner] + np.arange(len(owner)) - first[owner]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(tokens.view(np.int64)), batch.column(1).take(rows), batch.column(3).take(rows), batch.column(4).take(rows), pa.array(start, pa.int32())], names=["gram", "token", "n", "doc", "key", "start"])

    each = parts.mapInArrow(strings, "gram bigint, token bigint, n bigint, doc bigint, key bigint, start int")
    twice = each.groupBy("gram", "token").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("gram", "token")
    return each.where("n = 1").join(twice, ["gram", "token"], "left_semi").select("doc", "key", "start", (F.col("start") + length).alias("end"))


def merged(spans: Column | str) -> Column:
    """A sorted list of spans with those that touch or overlap made one."""

    @arrow_udf("array<struct<start:int,end:int>>")
    def one(lists: pa.Array) -> pa.Array:
        out = []
        for spans in lists.to_pylist():
            runs: list[list[int]] = []
            for s in spans:
                if runs and s["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["end"])
                else:
                    runs.append([s["start"], s["end"]])
            out.append([{"start": a, "end": b} for a, b in runs])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return one(spans)


def kept_bytes(text: Column, spans: Column) -> Column:
    """The UTF-8 bytes of a text outside the spans, strung together; null text: no bytes."""

    @arrow_udf("binary")
    def kept(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts, lists):
            raw, done, parts = (t.as_py() or "").encode(), 0, []
            for s in spans.as_py() or ():
                parts.append(raw[done : s["start"]])
                done = s["end"]
            out.append(b"".join([*parts, raw[done:]]))
        return pa.array(out, pa.binary())

    return kept(text, spans)


def remove_repeats(
    df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 128, length: int = 400, batches: int = 4, hot: int = 20_000, passage: int | None = None,
) -> DataFrame:
    """One row for each row of df: its id, n_bytes, spans (removed, in bytes) and kept (binary, what is left).

    With passage, also has_passage: whether a string of so many bytes (fewer than length) stands elsewhere too, in this
    row or another; it is decided on the input and removes nothing.
    """
    rows = df.select(col(doc).cast("bigint").alias("doc"), F.coalesce(col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text")).select("doc", "key", "text")
    spans = repeated_spans(rows, k, length, batches, hot)
    extra = []
    if passage is not None:
        shorter = repeating_rows(rows, spans.select("doc", "key"), max(SYMBOL, k * passage // length), passage, hot)
        none = F.array().cast("array<struct<start:int,end:int>>")
        spans = spans.unionByName(shorter.select("doc", "key", none.alias("spans")))
        extra = [F.col("d").isNotNull() | F.col("q").isNotNull()]
    spans = spans.withColumnsRenamed({"doc": "d", "key": "q"})
    both = rows.join(spread_small(spans, "spans"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")), "left")
    extra = [c.alias("has_passage") for c in extra]
    both = both.select(F.col("doc").alias(doc), F.octet_length("text").cast("bigint").alias("n_bytes"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.col("text"), *extra)
    return both.select(doc, "n_bytes", "spans", kept_bytes(F.col("text"), F.col("spans")).alias("kept"), *["has_passage"] * len(extra))
