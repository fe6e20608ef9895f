"""Exact Jaccard join of word shingle sets, given as connected components.

A document's set holds its distinct shingles of `k` consecutive words, as 64-bit fingerprints; a text of fewer words
has its whole sequence as the one shingle. Two sets link when 100 * intersection >= percent * union. Equal sets are
one set from then on, so copies cost nothing.

Index. Shingles have one order over the whole corpus: rare ones first by fingerprint, then heavy ones by their count.
Heavy ones are those that some batch of rows holds in one of 4,096 sets or twice, and all batches together in one of
4,096; there are at most 4,096 times the mean set size of them. Two sets that link share a shingle among the first
n - ceil(percent n / 100) + 1 of each, so only these are indexed, each with its position. The list of a shingle is
ordered by set size; blocks whose sizes cannot link are skipped by binary search, and so are entries whose positions
leave too little room for the intersection.

Answers. In each of a few rounds every set takes one set of another component from each of its lists, and of these the
one that most lists name. Where that link holds, the components become one, and lists that hold a single component are
dropped: what a highly similar set has answered is not asked again. All pairs of different components in the lists that
are left are then compared. Candidates must pass a bound by parity bitmaps (differing bits never outnumber differing
shingles) and are then checked exactly on their texts. A bitmap of one width says nothing of sets that fill it, so long sets
have a second one with a bit or more for each shingle, which their candidates must pass before texts are fetched.

Nulls and texts without words have no shingles, are linked with nothing and are their own component. Rows that
share an id are documents of one name, each with its own set: sets are named by their fingerprints, and only the result
names a component by its smallest id, null if no row of it has one. Repeated rows have equal sets and link.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import GOLD, Scratch, col, give_back, lower_ascii, mix, slices, spread, utf8, word_hashes, words
from .components import components

LOWER = lower_ascii()
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
BITS = 1024
#: Heavy shingles are in one of so many sets.
SHARE = 4096
#: Rows of ids, 8 bytes each, that are sent to all executors as a filter; more are joined by a shuffle.
SMALL = 1_000_000
#: Rounds in which each set is compared with one other (NAMED others from the second on), before what is left is compared in full.
TURNS = 3
NAMED = 3
#: Places of a list at which a set looks for one to compare with, in each round after the first.
SPOTS = 8


def sets_of(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each row, sorted and distinct, one row after the other, and the offsets of the rows."""
    n = len(offs) - 1
    buf = LOWER[buf]
    starts, ends, row = words(buf, offs, IS_WORD)
    w = word_hashes(buf, starts, ends)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(int(size.sum()), np.uint64)
    at = np.cumsum(size) - size
    full = np.flatnonzero(count >= k)
    where, place = spread(first[full], size[full]), spread(at[full], size[full])
    h = np.full(len(where), np.uint64(k))
    for j in range(k):
        h = mix(h * GOLD + w[where + j])
    out[place] = h
    for i in np.flatnonzero((count > 0) & (count < k)):
        h = np.array([count[i]], np.uint64)
        for x in w[first[i] : first[i] + count[i]]:
            h = mix(h * GOLD + x)
        out[at[i]] = h[0]
    for a, b in zip(at.tolist(), (at + size).tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[np.concatenate([at, [len(out)]])].astype(np.int64)


def heavy_rows(batches, k: int):
    """Shingles that this batch holds often, and how often."""
    for batch in batches:
        buf, offs = utf8(batch.column(0))
        found = [sets_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)[0] for a, b in slices(offs)]
        if found:
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            often = n >= max(2, len(batch) / SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])


def features_rows(batches, k: int, percent: int, heavy: np.ndarray, rank: np.ndarray):
    """doc, key, n, the set's two fingerprints, its prefix in the corpus order, its parity bitmap, and a wide one if it is long."""
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        for a, b in slices(offs):
            tokens, at = sets_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
            n = np.diff(at)
            rows = len(n)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ c))]) for c in (GOLD, np.uint64(0xD6E8FEB86659FD93))]
            h1, h2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            row = np.repeat(np.arange(rows), n)
            odd = (np.bincount(row * BITS + (tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=rows * BITS) & 1).astype(np.uint8)
            parity = np.packbits(odd.reshape(rows, BITS), axis=1).view("<i8").reshape(rows, -1)
            wide = [wide_bitmap(tokens[at[i] : at[i + 1]]) if n[i] > BITS else None for i in range(rows)]
            want = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
            if len(heavy):
                spot = np.searchsorted(heavy, tokens)
                spot[spot == len(heavy)] = 0
                is_heavy = heavy[spot] == tokens
            else:
                spot, is_heavy = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
            light = np.concatenate([[0], np.cumsum(~is_heavy)])
            index = light[:-1] - np.repeat(light[at[:-1]], n)
            pick = ~is_heavy & (index < np.repeat(want, n))
            few = np.minimum(light[at[1:]] - light[at[:-1]], want)
            prefix = np.split(tokens[pick].view(np.int64), np.cumsum(few)[:-1]) if rows else []
            for i in np.flatnonzero(few < want):
                part = slice(at[i], at[i + 1])
                mine = np.flatnonzero(is_heavy[part]) + at[i]
                mine = mine[np.argsort(rank[spot[mine]], kind="stable")][: want[i] - few[i]]
                prefix[i] = np.concatenate([prefix[i], tokens[mine].view(np.int64)])
            sizes = np.array([len(p) for p in prefix], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(prefix) if rows else np.zeros(0, np.int64), pa.int64()))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (BITS // 64), pa.int32()), pa.array(parity.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists, bits, pa.array(wide, pa.list_(pa.int64()))], names=["doc", "key", "n", "h1", "h2", "prefix", "parity", "wide"])


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity bitmap of one set in a power of two of bits, as many as it has shingles at least. Folded, with its halves
    combined by exclusive or, it is the one of half the width."""
    width = 1 << (len(tokens) - 1).bit_length()
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def numbers(col: pa.Array) -> np.ndarray:
    """A column as numpy values, lists of one length as rows."""
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)
    return col.to_numpy(zero_copy_only=False)


def lists_of(batches, columns: list[str]):
    """The rows of a partition sorted by token, as numpy columns, never with part of a token's list."""
    held = None
    for batch in batches:
        give_back()
        cols = [numbers(batch.column(batch.schema.get_field_index(c))) for c in columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if last:
            yield [c[:last] for c in cols]
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def may_link(i, j, n, pos, bits, percent: int) -> np.ndarray:
    """Whether the sizes, positions and bitmaps of entries i and j of one list allow a link."""
    need = ((n[i] + n[j]) * percent + 99 + percent) // (100 + percent)
    ok = np.flatnonzero(np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
    odd = np.zeros(len(ok), np.int64)
    for k in range(bits.shape[1]):
        odd += np.bitwise_count(bits[i[ok], k] ^ bits[j[ok], k])
    out = np.zeros(len(i), bool)
    out[ok] = odd <= (n[i] + n[j] - 2 * need)[ok]
    return out


def star_rows(batches, percent: int, turn: int):
    """Entries of lists that hold two components or more, each with a set of another component to compare with, or null.

    That set's size can link. In turn 0 it is the list's set with the smallest id, else the smallest one. In later turns
    positions and bitmaps allow a link too; it is the first such of the nearest in order of size and of SPOTS places among
    those whose sizes can link, which differ by set, list and turn.
    """
    columns = ["token", "sid", "n", "pos", "label"]
    for token, sid, n, pos, label, *bits in lists_of(batches, columns + ["parity"] * (turn > 0)):
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        many = np.repeat(np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts), sizes)
        token, sid, n, pos, label, *bits = (x[many] for x in (token, sid, n, pos, label, *bits))
        if not len(token):
            continue
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        group = np.repeat(np.arange(len(starts)), sizes)
        # the nearest places after and before with another label
        new = np.concatenate([[True], (label[1:] != label[:-1]) | (token[1:] != token[:-1])])
        edges = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        after = np.append(edges[1:], len(token))[run]
        before = edges[run] - 1
        wide = np.int64(n.max() + 1)
        low = np.searchsorted(group * wide + n, group * wide + (n * percent + 99) // 100)

        def usable(c):
            inside = (c >= 0) & (c < len(token))
            c = np.clip(c, 0, len(token) - 1)
            return inside & (group[c] == group) & (label[c] != label) & (100 * np.minimum(n[c], n) >= percent * np.maximum(n[c], n))

        best = np.full(len(token), -1)
        if turn:
            room = np.searchsorted(group * wide + n, group * wide + np.minimum(n * 100 // percent, wide - 1), side="right") - low
            seed = mix((token ^ sid).view(np.uint64))

            def spot(k):
                c = low + (mix(seed + np.uint64(SPOTS * turn + k)) >> np.uint64(33)).astype(np.int64) % room
                return np.where(label[c] == label, after[c], c)

            for rule in (lambda: before, lambda: after, *(partial(spot, k) for k in range(SPOTS))):
                left = np.flatnonzero(best < 0)
                if not len(left):
                    break
                c = rule()
                left = left[usable(c)[left]]
                left = left[may_link(left, c[left], n, pos, bits[0], percent)]
                best[left] = c[left]
        else:
            smallest_id = np.lexsort((sid, group))[starts][group]
            for c in (smallest_id, low, after[low]):
                take = (best < 0) & usable(c)
                best[take] = c[take]
        centre = pa.array(sid[np.maximum(best, 0)], mask=best < 0)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(sid), pa.array(n), pa.array(pos), centre], names=["token", "sid", "n", "pos", "centre"])


def pair_rows(batches, percent: int, block: int = 1 << 20):
    """Pairs of sets in one list, of different components, whose sizes, positions and bitmaps allow a link."""

    def pairs(i, j, sid, n, pos, label, bits):
        ok = np.flatnonzero((label[i] != label[j]) & (sid[i] != sid[j]))
        i, j = i[ok], j[ok]
        ok = may_link(i, j, n, pos, bits, percent)
        i, j = i[ok], j[ok]
        both = np.unique(np.stack([np.maximum(sid[i], sid[j]), np.minimum(sid[i], sid[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for token, sid, n, pos, label, bits in lists_of(batches, ["token", "sid", "n", "pos", "label", "parity"]):
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
        # a pair of different components has a member outside the component that is commonest in the list
        order = np.lexsort((label, group))
        by_group, by_label = group[order], label[order]
        edge = np.flatnonzero(np.concatenate([[True], (by_group[1:] != by_group[:-1]) | (by_label[1:] != by_label[:-1])]))
        run = np.diff(np.append(edge, len(order)))
        best = np.lexsort((run, by_group[edge]))
        top = best[np.append(by_group[edge][best][1:] != by_group[edge][best][:-1], True)]
        other = np.flatnonzero(label != by_label[edge[top]][group])
        if not len(other):
            continue
        wide = np.int64(n.max() * 2 + 2)
        key = group * wide + n
        low = np.searchsorted(key, group[other] * wide + (n[other] * percent + 99) // 100)
        high = np.searchsorted(key, group[other] * wide + n[other] * 100 // percent, side="right")
        size = high - low
        total = np.cumsum(size)
        at = 0
        while at < len(other):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block, side="right")))
            i = spread(low[at:to], size[at:to])
            yield pairs(i, np.repeat(other[at:to], size[at:to]), sid, n, pos, label, bits)
            at = to


def differing(a: Column | str, b: Column | str) -> Column:
    """Bits by which two parity bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def folded(a: str, b: str) -> Column:
    """Wide bitmap a, folded if it has twice the width of b."""
    half = (F.size(a) / 2).cast("int")
    halves = F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(a) == 2 * F.size(b), halves).otherwise(F.col(a))


def linked_column(a: str, b: str, k: int, percent: int) -> Column:
    """Whether the shingle sets of two texts link, exactly."""

    @arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        sides = []
        for texts in (left, right):
            coded = texts.dictionary_encode()
            buf, offs = utf8(coded.dictionary)
            found = []
            for s, e in slices(offs):
                tokens, at = sets_of(buf[offs[s] : offs[e]], offs[s : e + 1] - offs[s], k)
                found += np.split(tokens, at[1:-1])
            sides.append((coded.indices.to_numpy(zero_copy_only=False), found))
        out = []
        for i, j in zip(*(s[0].tolist() for s in sides)):
            x, y = sides[0][1][i], sides[1][1][j]
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            out.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
        return pa.array(out, pa.bool_())

    return linked(F.col(a), F.col(b))


def set_name(turn: int) -> Column:
    """The 64-bit name of the set with fingerprint h1, h2; each turn gives other names."""
    return F.xxhash64("h1", "h2", F.lit(turn)) if turn else F.xxhash64("h1", "h2")


class Join:
    """The steps of one join; every table between them is written out."""

    def __init__(self, spark: SparkSession, rows: DataFrame, k: int, percent: int):
        self.spark, self.rows, self.k, self.percent = spark, rows, k, percent
        self.scratch = Scratch(spark, "jaccard")
        self.wide: DataFrame | None = None  # sid, n and wide bitmap of the long sets

    def features(self) -> DataFrame:
        k, percent = self.k, self.percent
        least = max(16, self.rows.count() // SHARE)
        often = self.rows.select("text").mapInArrow(lambda it: heavy_rows(it, k), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
        tokens, counts = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
        order = np.argsort(tokens)
        heavy = self.spark.sparkContext.broadcast((tokens[order], counts[order]))
        made = self.rows.select("doc", "key", "text").mapInArrow(lambda it: features_rows(it, k, percent, *heavy.value), "doc bigint, key bigint, n bigint, h1 bigint, h2 bigint, prefix array<bigint>, parity array<bigint>, wide array<bigint>")
        return self.scratch.keep(made, "features")

    def named(self, features: DataFrame) -> tuple[DataFrame, DataFrame]:
        """features with sid, the name of each row's set (null without words), and one row for each set.

        A name has 64 bits, a set's fingerprint 128. Some names of very many sets are shared: the sets of such a name all
        get new ones, until no two sets have one name. There are some n^2 / 2^65 of them among n sets.
        """
        features = features.withColumn("sid", F.when(F.col("n") > 0, set_name(0)))
        edges = [f(c).alias(f"{c}_{f.__name__}") for c in ("h1", "h2") for f in (F.min, F.max)]
        turn = 0
        while True:
            sets = features.where("n > 0").groupBy("sid").agg(F.min("doc").alias("top"), F.min(F.struct("doc", "key")).alias("one"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"), F.first("wide").alias("wide"), *edges)
            sets = self.scratch.keep(sets, "sets")
            self.scratch.forget("sets")
            shared = sets.where("h1_min < h1_max OR h2_min < h2_max").select(F.col("sid").alias("taken"))
            if shared.isEmpty():
                return features, sets.drop("h1_min", "h1_max", "h2_min", "h2_max")
            turn += 1
            shared = self.scratch.keep(shared, "shared")
            again = features.join(shared, F.col("sid") == F.col("taken"), "left")
            features = again.withColumn("sid", F.when(F.col("taken").isNotNull(), set_name(turn)).otherwise(F.col("sid"))).drop("taken")

    def allowed(self) -> Column:
        """Shingles by which two sets of na and nb may differ if they link."""
        total = F.col("na") + F.col("nb")
        return total - 2 * F.floor((total * self.percent + 99 + self.percent) / (100 + self.percent))

    def near(self, pairs: DataFrame, bits: DataFrame) -> DataFrame:
        """The pairs (a, b) whose bitmaps allow a link."""
        left = bits.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
        right = bits.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
        return pairs.join(left, "a").join(right, "b").where(differing("pa", "pb") <= self.allowed()).select("a", "b").distinct()

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs but those of two long sets whose wide bitmaps allow no link."""
        if self.wide is None:
            return pairs
        wide = self.paired(pairs, self.wide)
        left = wide.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
        right = wide.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
        may = differing(folded("wa", "wb"), folded("wb", "wa")) <= self.allowed()  # null where a width is missing or more than twice the other
        kept = self.scratch.keep(pairs.join(left, "a", "left").join(right, "b", "left").where(F.coalesce(may, F.lit(True))).select("a", "b"), "close")
        self.scratch.forget("close")
        return kept

    def paired(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The texts (or other rows by sid) of sets that are in a pair. Most sets are in none, and all texts would be shuffled beside the few that are."""
        ends = self.scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct(), "ends")
        self.scratch.forget("ends")
        return texts.join(F.broadcast(ends), F.col("sid") == F.col("end"), "left_semi") if ends.count() <= SMALL else texts

    def check(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that link."""
        pairs = self.close(pairs)
        texts = self.paired(pairs, texts)
        left, right = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(left, "a").join(right, "b")
        return self.scratch.keep(both.where(linked_column("ta", "tb", self.k, self.percent)).select("a", "b"), "checked")

    def labelled(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        return lists.join(labels, lists.sid == labels.node, "left").select("token", "sid", "n", "pos", F.coalesce("component", "sid").alias("label"))

    def merge(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """node and component after new links; labels has those before, for nodes with a link."""
        if labels is None:
            return components(links, self.scratch)
        names = labels.select("node", "component")
        ends = links.join(names.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(names.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        joined = components(ends, self.scratch).withColumnsRenamed({"node": "old", "component": "new"})
        moved = names.join(joined, names.component == joined.old, "left").select("node", F.coalesce("new", "component").alias("component"))
        fresh = joined.join(names, joined.old == names.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        return self.scratch.keep(moved.union(fresh), "labels")

    def run(self) -> DataFrame:
        """doc, key, n, group (a key of the component) and component (its smallest doc) of every row."""
        percent = self.percent
        features, sets = self.named(self.features())
        entries = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "sid", "n", F.col("pos").cast("bigint").alias("pos"), F.col("sid").alias("label"))
        bits = sets.select("sid", "n", "parity")
        self.wide = sets.where("wide IS NOT NULL").select("sid", "n", "wide")
        kind = "token bigint, sid bigint, n bigint, pos bigint, centre bigint"
        texts = labels = None
        for turn in range(TURNS):
            ordered = (entries.join(bits.drop("n"), "sid") if turn else entries).repartition("token").sortWithinPartitions("token", "n", "sid")
            lists = self.scratch.keep(ordered.mapInArrow(lambda it, turn=turn: star_rows(it, percent, turn), kind), "lists")
            self.scratch.forget("lists")
            if texts is None:
                texts = self.texts(lists.select("sid").distinct().join(sets.select("sid", "one"), "sid").select("sid", F.col("one.doc").alias("d"), F.col("one.key").alias("q")), features)
            votes = lists.where("centre IS NOT NULL").groupBy(F.col("sid").alias("a"), F.col("centre").alias("b")).count()
            if turn:  # their bitmaps allow a link
                first = Window.partitionBy("a").orderBy(F.desc("count"), "b")
                centres = votes.withColumn("place", F.row_number().over(first)).where(F.col("place") <= NAMED).select("a", "b")
            else:
                centres = self.near(votes.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b")), bits)
            links = self.check(self.scratch.keep(centres, "centres"), texts)
            labels = self.merge(labels, links)
            entries = self.labelled(lists, labels)
        # what is left in lists of several components is compared in full
        multi = entries.join(bits.drop("n"), "sid").repartition("token").sortWithinPartitions("token", "n", "sid")
        rest = self.scratch.keep(multi.mapInArrow(lambda it: pair_rows(it, percent), "a bigint, b bigint").distinct(), "pairs")
        self.scratch.forget("lists", 0)
        labels = self.merge(labels, self.check(rest, texts))
        named = sets.select("sid", "top").join(labels, F.col("sid") == labels.node, "left").select("sid", "top", F.coalesce("component", "sid").alias("group"))
        named = named.join(named.groupBy("group").agg(F.min("top").alias("component")), "group").select(F.col("sid").alias("s"), "group", "component")
        members = features.select("doc", "key", "n", "sid").join(named, F.col("sid") == F.col("s"), "left")
        alone = F.col("sid").isNull()
        return members.select("doc", "key", "n", F.when(alone, F.xxhash64("doc", "key")).otherwise(F.col("group")).alias("group"), F.when(alone, F.col("doc")).otherwise(F.col("component")).alias("component"))

    def texts(self, ids: DataFrame, features: DataFrame) -> DataFrame:
        """One text each of the sets that share an indexed shingle with another."""
        ids = self.scratch.keep(ids, "ids")
        if ids.count() <= SMALL:
            ids = F.broadcast(ids)
        rows = self.rows.join(ids, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q"))).select("sid", "text")
        if not features.groupBy("doc", "key").count().where("count > 1").isEmpty():
            rows = rows.dropDuplicates(["sid"])
        return self.scratch.keep(rows, "texts")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of df: its id, n_shingles (long), component_id (the smallest id that links lead to),
    text_key (xxhash64 of the text, which tells rows of one id apart) and component_key (equal in rows of one component
    only, whatever their ids)."""
    rows = df.select(col(doc).cast("bigint").alias("doc"), F.xxhash64(col(text)).alias("key"), col(text).alias("text"))
    done = Join(df.sparkSession, rows, k, percent).run()
    return done.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("key").alias("text_key"), F.col("group").alias("component_key"))


def keep_one(df: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df but for all except one of each component of found (near_duplicates() of df).

    The row with the smallest id stays, of rows of that id the one with the smallest text key, and one of rows that are
    the same in both. One of a component's rows without an id stays too, since no id says which row stands for it.
    """
    one = F.min(F.struct(F.col(doc).alias("d"), F.col("text_key").alias("q"))).alias("x")
    wordless = F.when(F.col("n_shingles") == 0, F.struct(col(doc), "text_key"))  # of no component; told apart in full
    kept = found.groupBy("component_key", wordless, col(doc).isNull()).agg(one).select("x.d", "x.q")
    kept = Scratch(df.sparkSession, "kept").keep(kept, "ids")
    if kept.count() <= SMALL:
        kept = F.broadcast(kept)
    rows = df.join(kept, col(doc).cast("bigint").eqNullSafe(F.col("d")) & (F.xxhash64(col(text)) == F.col("q")), "left_semi")
    if not found.groupBy(doc, "text_key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([doc, text])
    return rows
