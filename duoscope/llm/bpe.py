"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Corpus. Texts are split into pieces (matches of the split pattern), 1 MB of text at a time. One aggregation counts the
pieces of all rows; those that make up one in 131,072 of all pieces or more, at most 131,072 of them and 64 bytes long at
most, are replayed together in Spark tasks, and their ids, 20 MB at most, go to all executors. Pieces that are rarer,
and longer ones, are replayed together for each block of 4 MB of text; a worker remembers them up to a fixed number. So
which pieces are common only decides where a piece is replayed, never its ids.

Replay. An inverted index holds, for each rank, the positions at which a pair with that rank stands. The ranks are taken
from a heap in order; all positions of a rank merge at once, and only the pairs that touch a merged place are looked
up again and put back into the index.

The result of a piece is that of taking its lowest-ranked pair again and again, leftmost first. Merging several places
of one piece in one step is the same unless a pair that the merge makes has a lower rank than the merge itself; the
table of pairs knows the tokens for which that can be, and for these only the leftmost place of each piece merges.

Pieces are told apart by 64-bit fingerprints, and each is then compared byte by byte with the one it is taken for; a piece
that differs from it is replayed by itself. Null texts count as empty. Rows are independent, so repeated rows and ids
give repeated results.
"""

from __future__ import annotations

import base64
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, col, from_bytes, same_rows, slices, spread, utf8, word_hashes

NONE = np.iinfo(np.int32).max
#: Pieces that a worker remembers; more start afresh from the common ones.
KEEP = 250_000
#: Bytes of text whose rare pieces are replayed together.
BLOCK = 4 << 20
#: Common pieces make up one in so many of all pieces, and have so many bytes at most.
COMMON, LONGEST = 1 << 17, 64
#: Fixed value: the split pattern that split_plain() does without a regular expression.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE = 1, 2, 3


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file (base64 token and rank on each line), read once on the driver: some 50,000 lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def packed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of pieces, one after the other, and where each begins and ends."""
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends


class Merges:
    """What the ranks say, as flat arrays: the tokens, and the pairs of token ids that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        top = max(ranks.values()) + 1
        self.top = np.int64(top)
        keys, made, risky = [], [], np.zeros(top, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * top + b)
                    made.append(rank)
                    risky[a] |= a > rank
                    risky[b] |= b > rank
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made, self.risky = np.array(keys, np.int64)[order], np.array(made, np.int32)[order], risky
        self.slot_key = None
        by_rank = [b""] * top
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.bytes, self.start, end = packed(by_rank)
        self.size = end - self.start
        prints = word_hashes(self.bytes, self.start, end)
        there = np.flatnonzero(self.size > 0)
        self.by_print = there[np.argsort(prints[there])]
        self.prints = prints[self.by_print]

    def slots(self) -> None:
        """Open addressing with one key in each slot, built where it is used; the rest is found by binary search."""
        self.bits = 20
        slots = self.slot(self.keys)
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        self.slot_key[slots], self.slot_rank[slots] = self.keys, self.made
        self.shared = np.bincount(slots, minlength=1 << self.bits) > 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for no merge."""
        if self.slot_key is None:
            self.slots()
        keys = a * self.top + b
        at = self.slot(keys)
        out = np.where(self.slot_key[at] == keys, self.slot_rank[at], NONE).astype(np.int32)
        odd = np.flatnonzero(self.shared[at] & (out == NONE))
        if odd.size:
            found = np.searchsorted(self.keys, keys[odd])
            found[found == len(self.keys)] = 0
            hit = self.keys[found] == keys[odd]
            out[odd[hit]] = self.made[found[hit]]
        return out

    def tokens(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The rank of each piece that is a token as a whole, else -1."""
        at = np.searchsorted(self.prints, h)
        at[at == len(self.prints)] = 0
        rank = self.by_print[at]
        same = np.flatnonzero((self.prints[at] == h) & (self.size[rank] == size))
        same = same[alike(buf, start[same], self.bytes, self.start[rank[same]], size[same])]
        out = np.full(len(h), -1, np.int64)
        out[same] = rank[same]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin, with the end."""
        if ids.size and (ids.max() >= len(self.size) or (self.size[ids] < 1).any()):
            raise ValueError("an id has no token in the rank file")
        size = self.size[ids]
        return self.bytes[spread(self.start[ids], size)], np.concatenate([[0], np.cumsum(size)])


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, zeros after the end."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def alike(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from a[at] on equal those from b[bt] on."""
    same = np.ones(len(at), bool)
    x, y, idx, done = eights(a), eights(b), np.flatnonzero(size > 0), 0
    while idx.size:
        rest = np.minimum(size[idx] - done, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        same[idx] &= (x[at[idx] + done] & mask) == (y[bt[idx] + done] & mask)
        done += 8
        idx = idx[size[idx] > done]
    return same


def replay(buf: np.ndarray, start: np.ndarray, lens: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces (lens bytes of buf from start on) one after the other, and how many each has."""
    n = len(start)
    flat = buf[spread(start, lens)]
    total = len(flat)
    sym = merges.byte_id[flat]
    word = np.repeat(np.arange(n, dtype=np.int64), lens)
    # a guard at the end stands for the neighbour of the last position of each piece
    nxt = np.arange(1, total + 1, dtype=np.int64)
    prv = np.arange(-1, total - 1, dtype=np.int64)
    ends = np.cumsum(lens)
    nxt[ends[lens > 0] - 1] = total
    prv[(ends - lens)[lens > 0]] = -1
    alive = np.ones(total, bool)
    pair = np.full(total, NONE, np.int32)
    inner = np.flatnonzero(nxt < total)
    pair[inner] = merges.rank(sym[inner], sym[nxt[inner]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(at: np.ndarray) -> None:
        at = at[pair[at] < NONE]
        if not at.size:
            return
        at = at[np.argsort(pair[at], kind="stable")]
        r = pair[at]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(part)

    put(inner)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))
        at = at[alive[at] & (pair[at] == rank)]
        if not at.size:
            continue
        if at.size > 1:
            if merges.risky[rank]:
                lead = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                rest = at[~lead]
                at = at[lead]
                if rest.size:
                    index[rank] = [rest]
                    heapq.heappush(heap, rank)
            else:
                linked = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                if linked.any():  # overlapping places: every other one of each chain, from the left
                    starts = np.flatnonzero(~linked)
                    chain = np.arange(at.size) - np.repeat(starts, np.diff(np.append(starts, at.size)))
                    at = at[chain % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = rank
        alive[gone] = False
        nxt[at] = after
        inside = after < total
        prv[after[inside]] = at[inside]
        pair[gone] = NONE
        pair[at] = NONE
        pair[at[inside]] = merges.rank(sym[at[inside]], sym[after[inside]])
        left = prv[at]
        left = left[left >= 0]
        pair[left] = merges.rank(sym[left], sym[nxt[left]])
        put(np.concatenate([at[inside], left]) if left.size else at[inside])
    count = np.bincount(word[alive], minlength=n) if total else np.zeros(n, np.int64)
    return sym[alive], count


def classes() -> np.ndarray:
    """Of each code point whether it is a letter, a number, white space or something else."""
    import regex

    table, every = np.zeros(0x110000, np.uint8), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            first, last = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            table[first : last + 1] = kind
    return table


def split_plain(buf: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in bytes, of each match of PLAIN in each row; they cover the rows without a gap.

    A match is a run of one kind with the blank before it. Of several white spaces the last is a match of its own, or goes
    to what follows if it is a blank. A lone apostrophe that no blank goes to takes the letters of a contraction.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    char = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind, n = kinds[char], len(char)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offs)] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = run.copy()
    start[1:] &= ~((char[:-1] == 32) & ~space[1:] & ~first[1:-1])
    end = np.ones(n, bool)
    end[:-1] = run[1:]
    start |= space & end & ~first[1:]
    mark = np.flatnonzero((char == 39) & start & end & ~first[1:])
    if mark.size:
        more = np.concatenate([char, np.zeros(2, char.dtype)])
        a, b = more[mark + 1], more[mark + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        inside = np.append(~first[1:-1], [False, False])[mark + 1]
        two = inside & ((((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[mark[one | two] + 1] = False
        for which, after in ((one, 2), (two, 3)):
            next_one = mark[which] + after
            start[next_one[next_one < n]] = True
    begin = at[start]
    return begin, np.append(begin[1:], len(buf))


def split_pattern(buf: np.ndarray, offs: np.ndarray, finditer) -> tuple[np.ndarray, np.ndarray]:
    """As split_plain(), for any pattern; what no match covers is left out."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(offs[:-1], offs[1:]):
        raw = buf[a:b]
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)) + a
        spans = np.array([m.span() for m in finditer(raw.tobytes().decode())], np.int64).reshape(-1, 2)
        starts.append(at[spans[:, 0]])
        ends.append(at[spans[:, 1]])
    return np.concatenate(starts), np.concatenate(ends)


class Splitter:
    def __init__(self, pattern: str):
        import regex

        if pattern == PLAIN:
            kinds = classes()
            self.one = lambda buf, offs: split_plain(buf, offs, kinds)
        else:
            finditer = regex.compile(pattern).finditer
            self.one = lambda buf, offs: split_pattern(buf, offs, finditer)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of all pieces, 1 MB of text at a time."""
        parts = [(a, *self.one(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])) for a, b in slices(offs)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([p[i] + offs[p[0]] for p in parts]) for i in (1, 2))


class Known:
    """Pieces and their ids: fingerprints in order, and the bytes and ids of each."""

    def __init__(self):
        self.prints = np.zeros(0, np.uint64)
        self.start = self.size = self.first = self.count = np.zeros(0, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def add(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Pieces that are not there yet, each fingerprint once."""
        new = (h, np.cumsum(size) - size + len(self.bytes), size, np.cumsum(count) - count + len(self.ids), count)
        old = (self.prints, self.start, self.size, self.first, self.count)
        both = [np.concatenate(x) for x in zip(old, new)]
        order = np.argsort(both[0], kind="stable")
        self.prints, self.start, self.size, self.first, self.count = (x[order] for x in both)
        self.bytes, self.ids = np.concatenate([self.bytes, buf[spread(start, size)]]), np.concatenate([self.ids, ids.astype(np.uint32)])

    def find(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece, -1 if it is not there, and whether its fingerprint is."""
        at = np.searchsorted(self.prints, h)
        if not len(self.prints):
            return np.full(len(h), -1), np.zeros(len(h), bool)
        at[at == len(self.prints)] = 0
        seen = self.prints[at] == h
        same = np.flatnonzero(seen & (self.size[at] == size))
        same = same[alike(buf, start[same], self.bytes, self.start[at[same]], size[same])]
        place = np.full(len(h), -1)
        place[same] = at[same]
        return place, seen


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and one occurrence of each distinct piece, and the number of each piece among these. A piece that
    differs from the one whose fingerprint it has is listed by itself, after the others."""
    h, size = word_hashes(buf, start, end), end - start
    prints, one, number = np.unique(h, return_index=True, return_inverse=True)
    of = one[number]
    odd = np.flatnonzero((size != size[of]) | ~alike(buf, start, buf, start[of], np.minimum(size, size[of])))
    number[odd] = len(prints) + np.arange(len(odd))
    return np.concatenate([prints, h[odd]]), np.concatenate([one, odd]), number


class Encoder:
    """Ids for whole texts; remembers the pieces that it has seen."""

    def __init__(self, ranks: dict[bytes, int] | Merges, pattern: str | None, common: tuple | None = None):
        self.merges = ranks if isinstance(ranks, Merges) else Merges(ranks)
        self.split, self.common = pattern and splitter(pattern), common
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        if self.common:
            buf, start, end, ids, count = self.common
            self.known.add(word_hashes(buf, start, end), buf, start, end - start, ids, count)

    def ids_of(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has: one for a token, else by replay."""
        whole = self.merges.tokens(h, buf, start, size)
        single = whole >= 0
        ids, count = replay(buf, start[~single], size[~single], self.merges)
        counts = np.ones(len(h), np.int64)
        counts[~single] = count
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[first[single]] = whole[single]
        out[spread(first[~single], count)] = ids
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned, 32 bits) and the number of ids of each row."""
        return self.encode_bytes(*utf8(texts))

    def encode_bytes(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known.prints) > KEEP:
            self.clear()
        start, end = self.split(buf, offs)
        h, one, number = distinct(buf, start, end)
        begin, size = start[one], (end - start)[one]
        place, seen = self.known.find(h, buf, begin, size)
        fresh = np.flatnonzero(place < 0)
        ids, count = self.ids_of(h[fresh], buf, begin[fresh], size[fresh])
        both = np.concatenate([self.known.ids, ids])
        first, counts = (np.where(place >= 0, x[place], 0) if len(x) else np.zeros(len(h), np.int64) for x in (self.known.first, self.known.count))
        first[fresh], counts[fresh] = np.cumsum(count) - count + len(self.known.ids), count
        per = counts[number]
        out = both[spread(first[number], per)]
        ends = np.concatenate([[0], np.cumsum(per)])
        rows = ends[np.searchsorted(start, offs)]
        _, leads = np.unique(h[fresh], return_index=True)
        new = leads[~seen[fresh[leads]]]
        if len(new):
            took = np.cumsum(count) - count
            self.known.add(h[fresh[new]], buf, begin[fresh[new]], size[fresh[new]], ids[spread(took[new], count[new])], count[new])
        return out, np.diff(rows)


HELD: dict[tuple, object] = {}


def held(key: tuple, make):
    """One object of each kind (the key's first part) for a worker process."""
    if key not in HELD:
        for other in [k for k in HELD if k[0] == key[0]]:
            del HELD[other]
        HELD[key] = make()
    return HELD[key]


def splitter(pattern: str) -> Splitter:
    return held(("split", pattern), lambda: Splitter(pattern))


def piece_rows(batches, pattern: str):
    """The pieces that stand twice or more in a block, with their counts; under null the number of all pieces."""
    split = splitter(pattern)
    for batch in batches:
        buf, offs = utf8(batch.column(0))
        for a, b in slices(offs, BLOCK):
            part = buf[offs[a] : offs[b]]
            start, end = split(part, offs[a : b + 1] - offs[a])
            _, one, number = distinct(part, start, end)
            n = np.bincount(number, minlength=len(one))
            take = np.flatnonzero((n > 1) & ((end - start)[one] <= LONGEST))
            at, size = start[one[take]], (end - start)[one[take]]
            pieces = from_bytes(part[spread(at, size)], np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([pieces, pa.array(n[take], pa.int64())], names=["piece", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([len(start)], pa.int64())], names=["piece", "n"])


def common_pieces(df: DataFrame, merges, text: str, pattern: str) -> tuple:
    """The common pieces of all rows of df and their ids, as flat arrays."""
    counts = df.select(col(text).alias("text")).mapInArrow(lambda it: piece_rows(it, pattern), "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = Scratch(df.sparkSession, "pieces").keep(counts, "counts")
    total = counts.where("piece IS NULL").agg(F.sum("n")).first()[0] or 0

    def ids_rows(batches):
        enc = Encoder(merges.value, None)
        for batch in batches:
            buf, offs = utf8(batch.column(0))
            h = word_hashes(buf, offs[:-1], offs[1:])
            ids, count = enc.ids_of(h, buf, offs[:-1], np.diff(offs))
            yield pa.RecordBatch.from_arrays([batch.column(0), from_bytes(ids.astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(count) * 4]))], names=["piece", "ids"])

    often = counts.where(F.col("piece").isNotNull() & (F.col("n") >= total / COMMON)).select("piece")
    table = often.mapInArrow(ids_rows, "piece binary, ids binary").toArrow().combine_chunks()
    if not len(table):
        return ()
    buf, offs = utf8(table["piece"].combine_chunks())
    ids, at = utf8(table["ids"].combine_chunks())
    _, one = np.unique(word_hashes(buf, offs[:-1], offs[1:]), return_index=True)
    one = np.sort(one)  # of two common pieces of one fingerprint only one
    size, count = np.diff(offs)[one], np.diff(at)[one] // 4
    flat = buf[spread(offs[:-1][one], size)]
    ends = np.cumsum(size)
    return flat, ends - size, ends, np.frombuffer(ids.tobytes(), "<u4")[spread(at[:-1][one] // 4, count)], count


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: bool = False) -> DataFrame:
    """df and a struct column out: n_tokens (long) and ids (binary, little-endian unsigned 32-bit integers), and with
    decoded the bytes (binary) that these ids decode to again.

    Ids are those that the ranks give for each match of the pattern by itself, special tokens aside. A null or empty
    text has no ids. Every other column, whatever its name, stays.
    """
    context = df.sparkSession.sparkContext
    merges = context.broadcast(Merges(read_ranks(df.sparkSession, ranks_path)))
    common = context.broadcast(common_pieces(df, merges, text, pattern))
    key = ("encode", uuid.uuid4().hex)

    @arrow_udf("struct<n_tokens:bigint,ids:binary" + (",decoded:binary>" if decoded else ">"))
    def ids_of(texts: pa.Array) -> pa.Array:
        enc = held(key, lambda: Encoder(merges.value, pattern, common.value))
        buf, offs = utf8(texts)
        flat, counts, plain, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for a, b in slices(offs, BLOCK):
            ids, n = enc.encode_bytes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            flat.append(ids)
            counts.append(n)
            if decoded:
                raw, at = enc.merges.decode(ids)
                plain.append(raw)
                sizes.append(np.diff(at[np.concatenate([[0], np.cumsum(n)])]))
        n = np.concatenate(counts)
        arrays = [pa.array(n, pa.int64()), from_bytes(np.concatenate(flat).astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(n * 4)]))]
        if decoded:
            arrays.append(from_bytes(np.concatenate(plain), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])))
        return pa.StructArray.from_arrays(arrays, names=["n_tokens", "ids", "decoded"][: len(arrays)])

    return same_rows(df, out, lambda: ids_of(col(text)))


def decode_column(spark: SparkSession, ranks_path: str, ids: Column) -> Column:
    """The bytes that ids (as encode() writes them) stand for; an id without a token is an error."""
    merges = spark.sparkContext.broadcast(Merges(read_ranks(spark, ranks_path)))

    @arrow_udf("binary")
    def bytes_of(rows: pa.Array) -> pa.Array:
        buf, offs = utf8(rows)
        parts, ends = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        for a, b in slices(offs):
            raw, at = merges.value.decode(np.frombuffer(buf[offs[a] : offs[b]].tobytes(), "<u4").astype(np.int64))
            parts.append(raw)
            ends.append(ends[-1][-1] + at[(offs[a + 1 : b + 1] - offs[a]) // 4])
        return from_bytes(np.concatenate(parts), np.concatenate(ends))

    return bytes_of(ids)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and the decoded bytes as a binary column; null ids decode to no bytes."""
    return same_rows(df, out, lambda: decode_column(df.sparkSession, ranks_path, F.col(ids)))
