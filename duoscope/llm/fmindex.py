"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is an Arrow batch. Its texts become word numbers: words that no phrase uses are breaks, and so are the ends of
documents; stretches between breaks shorter than the shortest phrase cannot hold one and are left out. Over what
remains stands an FM-index: the suffix array, the last column behind a wavelet matrix whose levels hold ranks, and
suffix positions sampled at every eighth place and at the start of each stretch. All phrases are searched at once,
backwards, a word a step; each range of rows is walked to sampled positions, and the places found are merged into spans.

A phrase is a window of consecutive words of a benchmark text, or the whole of a shorter one. The phrases go to the tasks
in blocks of bounded size; with more than one block the spans of all blocks are merged for each document row.

Null texts have no words. Repeated benchmark texts each count as items; items without words occur nowhere; the words of
an item without an id are found as those of any other, but no list of items names it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col, lower_ascii, same_rows, slices, spread, tmp_name, utf8, word_hashes, words

STEP = 8
LOWER = lower_ascii()
#: Letters, digits and every byte of a code point beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 2 << 20


class Phrases:
    """The windows of a block of benchmark texts, as rows of word numbers from 1 on (0: none, at the end)."""

    def __init__(self, items: list[str], texts: list[str], window: int):
        buf, offs = utf8(pa.array(texts, pa.large_string()))
        buf = LOWER[buf]
        starts, ends, row = words(buf, offs, IS_WORD)
        self.vocabulary, number = np.unique(word_hashes(buf, starts, ends), return_inverse=True)
        first = np.searchsorted(row, np.arange(len(items)))
        count = np.bincount(row, minlength=len(items))
        size = np.minimum(count, window)
        many = np.where(count > 0, count - size + 1, 0)
        place = spread(first, many)[:, None] + np.arange(window)
        inside = np.arange(window) < np.repeat(size, many)[:, None]
        table = np.where(inside, number[np.where(inside, place, 0)] + 1, 0) if len(place) else np.zeros((0, window), np.int64)
        owner = np.repeat(np.arange(len(items)), many)
        self.rows, group = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        group = group.ravel()
        self.sizes = (self.rows > 0).sum(axis=1)
        # the items of each distinct window, one after the other
        order = np.argsort(group, kind="stable")
        self.owner = owner[order]
        self.owner_at = np.searchsorted(group[order], np.arange(len(self.rows) + 1))
        self.items = items

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of s, in which each 0 is a symbol of its own, smaller than all words."""
    n, zeros = len(s), np.flatnonzero(s == 0)
    rank = s + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    order = np.argsort(rank, kind="stable")
    _, rank = np.unique(rank, return_inverse=True)
    while True:
        top = int(rank.max()) + 1
        if top == n:
            return np.argsort(rank)
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        step *= 2


class Index:
    """An FM-index of a sequence of word numbers that ends with 0."""

    def __init__(self, s: np.ndarray, symbols: int):
        sa = suffix_array(s)
        self.n = len(s)
        last = s[sa - 1]
        self.last = last
        counts = np.bincount(s, minlength=symbols + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        level = last
        for b in range(self.bits - 1, -1, -1):
            bit = level >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        sampled = (np.arange(self.n) % STEP == 0) | (np.concatenate([[0], s[:-1]]) == 0)
        self.sampled = sampled[sa]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before row at."""
        low = np.zeros(len(symbol), np.int64)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            ones = self.ones[k]
            low = np.where(bit, self.zeros[k] + ones[low], low - ones[low])
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
        return at - low

    def search(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for k in range(rows.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < sizes) & (low < high))
            if on.size:
                c = rows[on, k]
                low[on] = self.before[c] + self.rank(c, low[on])
                high[on] = self.before[c] + self.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of the suffix in each row, by steps to the left until a sampled one."""
        at, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while open_.size:
            hit = self.sampled[at[open_]]
            done = open_[hit]
            found[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.last[at[open_]]
            at[open_] = self.before[c] + self.rank(c, at[open_])
            steps[open_] += 1
        return found


def scan(texts: pa.Array, phrases: Phrases) -> dict[str, np.ndarray]:
    """Words of each row, and the hits of a shard: merged spans (row, first and last byte, first and last word) and (row, item) pairs."""
    buf, offs = utf8(texts)
    n_words = np.zeros(len(texts), np.int64)
    least = phrases.sizes.min() if len(phrases.rows) else 0
    kept = []
    stretches = 0
    for lo, hi in slices(offs):
        part, at = LOWER[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        starts, ends, row = words(part, at, IS_WORD)
        count = np.bincount(row, minlength=hi - lo)
        n_words[lo:hi] = count
        if not least or not len(starts):
            continue
        number = phrases.numbers(word_hashes(part, starts, ends))
        # stretches of phrase words within a row
        known = number > 0
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | ~known[:-1]]) & known
        stretch = np.cumsum(fresh) - 1
        use = np.flatnonzero(known)
        if not use.size:
            continue
        use = use[np.bincount(stretch[use])[stretch[use]] >= least]
        r = row[use]
        kept.append(np.stack([number[use], stretch[use] + stretches, r + lo, starts[use] - at[r], ends[use] - at[r], use - (np.cumsum(count) - count)[r]]))
        stretches += int(stretch[-1]) + 1
    none = np.zeros(0, np.int64)
    out = {"n_words": n_words} | dict.fromkeys(("row", "start", "end", "first", "last", "item_row", "item"), none)
    used = np.concatenate(kept, axis=1) if kept else np.zeros((6, 0), np.int64)
    if not used.shape[1]:
        return out
    number, stretch, row, starts, ends, nth = used
    gap = np.concatenate([[0], np.cumsum(stretch[1:] != stretch[:-1])])
    s = np.zeros(len(number) + int(gap[-1]) + 1, np.int64)
    place = np.arange(len(number)) + gap
    s[place] = number
    word = np.full(len(s), -1, np.int64)
    word[place] = np.arange(len(number))
    index = Index(s, len(phrases.vocabulary))
    low, high = index.search(phrases.rows, phrases.sizes)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    if not which.size:
        return out
    at = index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which)))
    cover = np.bincount(at, minlength=len(s) + 1) - np.bincount(at + phrases.sizes[which], minlength=len(s) + 1)
    covered = np.cumsum(cover)[:-1] > 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    a, b = word[np.flatnonzero(edge == 1)], word[np.flatnonzero(edge == -1) - 1]
    out |= {"row": row[a], "start": starts[a], "end": ends[b], "first": nth[a], "last": nth[b] + 1}
    per = np.diff(phrases.owner_at)[which]
    hit_row = np.repeat(row[word[at]], per)
    item = phrases.owner[np.repeat(phrases.owner_at[which] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(int(per.sum()))]
    pairs = np.unique(hit_row * len(phrases.items) + item)
    return out | {"item_row": pairs // len(phrases.items), "item": pairs % len(phrases.items)}


SPANS = "array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"


def hits_column(spark, items: list[str], texts: list[str], window: int, text: Column) -> Column:
    """n_words, spans (start and end in UTF-8 bytes, first and last word) and items (ids in their order as strings) of each row."""
    phrases = spark.sparkContext.broadcast(Phrases(items, texts, window))

    @arrow_udf(f"struct<n_words:bigint,spans:{SPANS},items:array<string>>")
    def hits(rows: pa.Array) -> pa.Array:
        p = phrases.value
        found = scan(rows, p)
        n = len(rows)
        span_at = np.searchsorted(found["row"], np.arange(n + 1))
        item_at = np.searchsorted(found["item_row"], np.arange(n + 1))
        spans = pa.StructArray.from_arrays([pa.array(found[k], pa.int64()) for k in ("start", "end", "first", "last")], names=["start", "end", "first", "last"])
        ids = pa.array(p.items, pa.string()).take(pa.array(found["item"], pa.int64()))
        return pa.StructArray.from_arrays([pa.array(found["n_words"], pa.int64()), pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans), pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), ids)], names=["n_words", "spans", "items"])

    # evaluated once, also where a filter reads it
    return hits.asNondeterministic()(text)


def blocks(benchmark: DataFrame, item: str, text: str):
    """Benchmark rows in blocks of bounded size, one block after another; their order decides nothing."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(col(item).cast("string"), col(text)).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
        if size > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def merge_spans(lists: Column) -> Column:
    """One sorted list of spans that neither overlap nor touch, from several."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        longer = F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"), last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["first"] <= last["last"], joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(F.flatten(lists)), F.array().cast(SPANS), step)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, out: str = "hits") -> DataFrame:
    """df and a struct column out: n_words, spans (start and end in UTF-8 bytes, first and last word), items (sorted ids, as strings, none null).

    Ends are exclusive. n_words counts all words of the row, spans cover every word inside an occurrence of a phrase, items are those
    with an occurring phrase. Every other column stays; an empty benchmark gives no spans.
    """
    done, k = df, 0
    names = []
    for ids, texts in blocks(benchmark, item, item_text):
        name = tmp_name(done, f"_hits{k}")
        done = done.withColumn(name, hits_column(df.sparkSession, ids, texts, window, col(text)))
        names.append(name)
        k += 1
    if k == 1:
        spans = F.col(f"{names[0]}.spans")
    else:
        spans = merge_spans(F.array(*[F.col(f"{n}.spans") for n in names]))
    items = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*[F.col(f"{n}.items") for n in names])))))
    return same_rows(done, out, lambda: F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))).drop(*names)


def cut(text: Column, spans: Column) -> Column:
    """text without the bytes of the spans, a line break in place of each; null stays null."""

    @arrow_udf("string")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts, lists):
            t, spans = t.as_py(), spans.as_py()
            if t is not None and spans:
                raw, done, parts = t.encode(), 0, []
                for s in spans:
                    parts += [raw[done : s["start"]], b"\n"]
                    done = s["end"]
                t = b"".join([*parts, raw[done:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return without(text, spans)
