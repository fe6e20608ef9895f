"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts each text where it is the least within 31 bytes on both sides, so cuts
depend on the bytes around them alone and come back in step after an insertion. Chunks have `least` to `most` bytes; equal
chunks are found by a 128-bit digest and are the seeds of repeats. Where a seed's neighbour is not shared, the repeat is
carried on byte by byte, as far as some other occurrence of the seed goes on alike (REACH bytes at most): the
occurrences of a seed are sorted by the bytes beside them, so only neighbours in that order are compared.

Each digest keeps its first occurrence: the first one in the document with the smallest id. The other occurrences are
removed where they and what they were carried on by make up a run of at least `run` bytes; shorter runs are chance and
stay. Bytes beside a seed are removed where an occurrence that comes before in the same order has them.

Each row has a result of its own. Rows that share an id all keep the chunks that their id is the first to have, whichever
of them holds these; rows without an id are the first only of what no row with an id has. Rows alike in id and text
share one result, which text_key() leads to. Null texts are empty. Offsets are UTF-8 bytes and can lie
inside a character; cut_text() widens the kept part to whole characters.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, col, mix, same_rows, slices, tmp_name, utf8

GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR of the 32 bytes up to it, each shifted by its distance."""
    h = GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def cuts(places: list[int], size: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text: the places that leave at least `least` bytes, and one after `most` bytes without, or
    sooner where the next place would be too near."""
    ends, last = [], 0
    for p in places:
        while p - last > most:
            last = min(last + most, max(p - least, last + 1))
            ends.append(last)
        if p - last >= least:
            ends.append(p)
            last = p
    while size - last > most:
        last += most
        ends.append(last)
    if size > last:
        ends.append(size)
    return ends


def least_places(h: np.ndarray, offs: np.ndarray, radius: int) -> np.ndarray:
    """Ends of the bytes at which h is the least within radius bytes (31 at most) of the same row.

    The first 31 bytes of a row still hold bytes of the row before and are no places; they keep rows apart here.
    """
    if len(h) < 32:
        return np.zeros(0, np.int64)
    h, n = h.astype(np.int64), len(h)
    first = np.minimum(offs[:-1, None] + np.arange(31), offs[1:, None] - 1)[np.diff(offs) > 0]
    h[first.ravel()] = 1 << 32
    ahead, width = h, 1
    while width < radius + 1:
        step = min(width, radius + 1 - width)
        longer = ahead.copy()
        longer[:-step] = np.minimum(ahead[:-step], ahead[step:])
        ahead, width = longer, width + step
    behind = ahead.copy()
    behind[radius:] = ahead[: n - radius]
    return np.flatnonzero((h == ahead) & (h == behind) & (h < 1 << 32)) + 1


def chunk_rows(batches, least: int, most: int):
    """doc_id, the row's key, start, size, the digest's halves, and whether the row had the digest before."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        for at, to in slices(offs):
            part, o = buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            place = least_places(gear(part), o, min(least, 32) - 1)
            first = np.searchsorted(place, o[:-1] + 32)
            last = np.searchsorted(place, o[1:], side="left")
            raw = part.tobytes()
            place = place.tolist()
            rows, starts, sizes, digests, again = [], [], [], [], []
            for i in range(to - at):
                a, n = int(o[i]), int(o[i + 1] - o[i])
                ends = cuts([p - a for p in place[first[i] : last[i]]], n, least, most)
                begin, seen = 0, set()
                for e in ends:
                    d = digest(raw[a + begin : a + e])
                    digests.append(d)
                    again.append(d in seen)
                    seen.add(d)
                    starts.append(begin)
                    sizes.append(e - begin)
                    begin = e
                rows.append(len(ends))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            index = pa.array(np.repeat(np.arange(at, to), rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(again, pa.bool_())], names=["doc", "row", "start", "size", "d1", "d2", "again"])


#: Bytes beside a seed that are compared; the cut next to the end of a repeat is at most about this far from it.
REACH = 256
BESIDE = "d1 bigint, d2 bigint, after boolean, beside binary, doc bigint, row bigint, start bigint, room bigint"


def beside_rows(batches):
    """The bytes after or before each seed (these backwards), with where it stands."""
    names = [f.split()[0] for f in BESIDE.split(", ")]
    for batch in batches:
        for doc, row, text, seeds in zip(*(batch.column(i) for i in range(4))):
            raw, row, doc = (text.as_py() or "").encode(), row.as_py(), doc.as_py()
            made = []
            for s in seeds.as_py():
                begin, end = s["start"], s["start"] + s["size"]
                beside = raw[end : end + REACH] if s["after"] else raw[max(0, begin - REACH) : begin][::-1]
                made.append((s["d1"], s["d2"], s["after"], beside, doc, row, begin, s["room"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 4])], names=names)


CARRIED = "doc bigint, row bigint, start bigint, after boolean, whole bigint, later bigint, source bigint"


def carried_rows(batches):
    """How far each seed with room goes on like one before it in the sort order: like any, and like one that comes
    before it by document and start, with that one's document. To be run on both directions of the order.

    For each length, the first occurrence (by document and start) that is alike so far is all that is kept of those before.
    """
    top = np.iinfo(np.int64).max
    docs, starts = np.full(REACH + 1, top), np.full(REACH + 1, top)
    old, held = None, b""
    for batch in batches:
        out = []
        for d1, d2, after, beside, doc, row, start, room in zip(*(c.to_pylist() for c in batch.columns)):
            if old != (d1, d2, after):
                old, common = (d1, d2, after), -1
            else:
                common, high = 0, min(len(beside), len(held))
                if beside[:high] == held[:high]:
                    common = high
                while common < high:
                    half = (common + high + 1) // 2
                    if beside[:half] == held[:half]:
                        common = half
                    else:
                        high = half - 1
            docs[common + 1 :] = top
            mine = top if doc is None else doc
            if room > 0 and common > 0:
                whole = min(common, room)
                sooner = np.flatnonzero((docs[: whole + 1] < mine) | ((docs[: whole + 1] == mine) & (mine < top) & (starts[: whole + 1] < start)))
                later = int(sooner[-1]) if len(sooner) else 0
                out.append((doc, row, start, after, whole, later, int(docs[later]) if later else None))
            n = len(beside) + 1
            less = (mine < docs[:n]) | ((mine == docs[:n]) & (start < starts[:n])) | (docs[:n] == top)
            docs[:n][less], starts[:n][less] = mine, start
            held = beside
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 3])], names=[f.split()[0] for f in CARRIED.split(", ")])


RUNS = "struct<n_repeated:bigint,n_removed:bigint,longest_run:bigint,removed:array<struct<start:bigint,end:bigint>>,sources:array<bigint>>"


def stretches(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end of each run of parts that follow one another without a gap."""
    found: list[list[int]] = []
    for s, e in sorted(parts):
        if found and s <= found[-1][1]:
            found[-1][1] = max(e, found[-1][1])
        else:
            found.append([s, e])
    return [(s, e) for s, e in found]


def inside(at: int, spans: list[tuple[int, int]]) -> bool:
    k = bisect_right(spans, (at, 1 << 62)) - 1
    return k >= 0 and at < spans[k][1]


def runs(parts: pa.Array, least: pa.Array) -> pa.Array:
    """What the repeated chunks of each document (start, size, first, kept, and how far they are carried on) come to."""
    out = []
    for chunks, run in zip(parts.to_pylist(), least.to_pylist()):
        repeated = stretches([(c["start"] - c["before"], c["start"] + c["size"] + c["after"]) for c in chunks])
        gone = [c for c in chunks if not c["kept"]]
        loose = [(s, e) for s, e in stretches([(c["start"] - c["before_later"], c["start"] + c["size"] + c["after_later"]) for c in gone]) if e - s >= run]
        sources = {x for c in gone if inside(c["start"], loose) for x in (c["first"], c["before_source"], c["after_source"]) if x is not None}
        out.append({"n_repeated": sum(e - s for s, e in repeated if e - s >= run), "n_removed": sum(e - s for s, e in loose), "longest_run": max((e - s for s, e in repeated), default=0), "removed": [{"start": s, "end": e} for s, e in loose], "sources": sorted(sources)})
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.array(out, pa.struct([("n_repeated", pa.int64()), ("n_removed", pa.int64()), ("longest_run", pa.int64()), ("removed", pa.list_(span)), ("sources", pa.list_(pa.int64()))]))


def text_key(doc: Column, text: Column) -> Column:
    """With the id, the key of a row's result."""
    return F.xxhash64(doc.cast("bigint"), text)


def same_row(a: str, b: str) -> Column:
    """Rows alike in id (or both without) and key: a key alone is too short to tell all rows of a large corpus apart."""
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def carried(slim: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, row and start of the seeds that are carried on, and for each side how far, how far when later, and the source."""
    # room: bytes to the next seed of the row; only seeds that are next to bytes of no seed somewhere have their sides compared
    w = Window.partitionBy("doc", "row").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    sides = seeds.select("*", (F.col("start") - F.coalesce(F.lag(end).over(w), F.lit(0))).alias("back"), (F.coalesce(F.lead("start").over(w), end + REACH) - end).alias("on"))
    sides = sides.select("doc", "row", "start", "size", "d1", "d2", F.explode(F.array(F.struct(F.lit(False).alias("after"), F.col("back").alias("room")), F.struct(F.lit(True).alias("after"), F.col("on").alias("room")))).alias("s")).select("*", "s.after", "s.room").drop("s")
    sides = scratch.keep(sides, "sides")
    wanted = sides.where("room > 0").select("d1", "d2", "after").distinct()
    lists = sides.join(wanted, ["d1", "d2", "after"], "left_semi").groupBy("doc", "row").agg(F.collect_list(F.struct("d1", "d2", "after", "start", "size", "room")).alias("seeds"))
    beside = slim.alias("s").join(lists.alias("l"), same_row("s", "l")).select("s.doc", "s.row", "text", "seeds").mapInArrow(beside_rows, BESIDE)
    beside = scratch.keep(beside, "beside")
    dealt, key = beside.repartition("d1", "d2", "after"), ("d1", "d2", "after", "beside")
    both = [dealt.sortWithinPartitions(*order).mapInArrow(carried_rows, CARRIED) for order in (key, [F.desc(c) for c in key])]
    best = {}
    for name, side in (("before", ~F.col("after")), ("after", F.col("after"))):
        best |= {name: F.max(F.when(side, F.col("whole"))), name + "_later": F.max(F.when(side, F.col("later"))), name + "_source": F.max_by("source", F.when(side & (F.col("later") > 0), F.col("later")))}
    return both[0].union(both[1]).groupBy("doc", "row", "start").agg(*[c.alias(n) for n, c in best.items()])


def repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 32, most: int = 128, run: int = 128) -> DataFrame:
    """One result for each row with a repeated chunk: doc, text_key, n_repeated and n_removed (bytes in long enough runs), the
    longest run, the removed spans, and the sources (ids of the documents that keep what is removed here)."""
    scratch = Scratch(df.sparkSession, "chunks")
    slim = df.select(col(doc).cast("bigint").alias("doc"), text_key(col(doc), col(text)).alias("row"), col(text).alias("text"))
    chunks = slim.mapInArrow(lambda it: chunk_rows(it, least, most), "doc bigint, row bigint, start bigint, size int, d1 bigint, d2 bigint, again boolean")
    chunks = scratch.keep(chunks, "chunks")
    shared = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where("n > 1").drop("n")
    seeds = scratch.keep(chunks.join(shared, ["d1", "d2"]), "seeds")
    scratch.forget("chunks", 0)
    on = carried(slim, seeds, scratch)
    kept = F.when(F.col("first").isNull(), ~F.col("again")).otherwise((F.col("s.doc") == F.col("first")) & ~F.col("again"))
    far = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("before", "before_later", "after", "after_later")]
    part = F.struct("s.start", "s.size", "first", F.coalesce(kept, F.lit(False)).alias("kept"), *far, "before_source", "after_source")
    by = seeds.alias("s").join(on.alias("o"), same_row("s", "o") & (F.col("s.start") == F.col("o.start")), "left").groupBy("s.doc", "s.row").agg(F.collect_list(part).alias("p"))
    return by.select("doc", "row", arrow_udf(runs, RUNS)("p", F.lit(run)).alias("r")).select(F.col("doc").alias(doc), F.col("row").alias("text_key"), "r.*")


def results(df: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of df with its result of repeats() in a column `found`, null where nothing of it is repeated."""
    name, mine = tmp_name(df, "_found"), tmp_name(df, "_mine")
    there = found.select(F.struct(*found.columns).alias(name))
    rows = df.withColumn(mine, text_key(col(doc), col(text)))
    same = rows[mine].eqNullSafe(F.col(name)["text_key"]) & col(doc).cast("bigint").eqNullSafe(F.col(name)[doc])
    return same_rows(rows.join(there, same, "left").drop(mine), "found", lambda: F.col(name)).drop(name)


def cut_text(text: Column, removed: Column) -> Column:
    """text without the removed spans (bytes); a character that is cut through stays. Null stays null."""

    @arrow_udf("string")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts, lists):
            t, spans = t.as_py(), spans.as_py()
            if t is not None and spans:
                raw, done, parts = t.encode(), 0, []
                for s in spans:
                    a, b = s["start"], s["end"]
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    parts.append(raw[done:a])
                    done = b
                t = b"".join([*parts, raw[done:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return without(text, removed)
