"""Vector code compression: each vector as one byte a part, the number of the nearest entry in that part's codebook.

Vectors are cut into equal parts of integer components. The rows of a task are cut into chunks; for each part, a chunk's
points lie in the order of a Hilbert curve, in flat blocks of BLOCK points that carry their least and largest
coordinates (a box) and the sums of them. In a round, the distances of an entry to the near and the far side of a box
say whether some other entry is nearer to all of the block: the entries left are its shortlist. A block with one entry
on its list is counted by its sums, no point of it is looked at; for the others the distances to the shortlist alone are
worked out, in integers. So the result is that of comparing all points with all entries, ties to the lower number too.

Chunks are written once, and read in each round; a round sends one row for each task and coordinate of the codebooks
through the shuffle, and the codebooks (entries times dimension numbers) to the driver. No vector is shuffled.

Null, empty and non-finite vectors and those of another length are dropped (vectors.usable). Rows that share a key are
rows like any other; among equal keys the lesser vector comes first, rows without a key come last. With fewer rows than
entries, the codebooks are as small as that. Components beyond 2**20 raise an error, since sums would not stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, give_back, tmp_name
from .vectors import lattice, narrow, usable, widened

#: Points of a block; rows of a chunk at most (and 16 MB of components).
BLOCK, CHUNK = 32, 16_384
#: Labels up to this many are sent to all tasks, more are joined by a shuffle.
FEW = 100_000
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "<u2")


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place of each point (a row of integers) on a Hilbert curve through the box that holds all of them.

    Coordinates are scaled to as many bits as leave a place within 63; past 63 dimensions the first 63 decide."""
    x = points[:, :63]
    n, w = x.shape
    bits = max(1, min(10, 63 // w))
    low = x.min(axis=0)
    span = np.maximum(x.max(axis=0) - low, 1)
    axes = [((x[:, i] - low[i]) * ((1 << bits) - 1) // span[i]) for i in range(w)]
    for b in range(bits - 1, 0, -1):  # undo the turns and mirrorings of the cells, the largest first
        below = (1 << b) - 1
        for i in range(w):
            far = (axes[i] >> b) & 1 == 1
            swap = np.where(far, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(far, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, w):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    place = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            place = place << 1 | ((a ^ turn) >> b & 1)
    return place


def chunk_rows(batches, dim: int, parts: int):
    """Chunks of the rows (last column: the vector): the other columns, the points of each part along the curve, their rows, and boxes and sums of the blocks."""
    w = dim // parts
    most = max(BLOCK, min(CHUNK, (16 << 20) // (8 * dim)))
    for batch in batches:
        give_back()
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            x = lattice(some.column(some.num_columns - 1), dim)
            n = len(x)
            if w * (2 * int(np.abs(x).max()) + 1) ** 2 >= 1 << 62:
                raise ValueError("squared distances would not fit 64 bits")
            starts = np.arange(0, n, BLOCK)
            points, order, boxes = np.empty((parts, n, w), np.int64), np.empty((parts, n), "<u4"), np.empty((parts, 3, len(starts), w), np.int64)
            for p in range(parts):
                own = x[:, p * w : (p + 1) * w]
                order[p] = np.argsort(hilbert(own), kind="stable")
                points[p] = own = own[order[p]]
                boxes[p] = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts), np.add.reduceat(own, starts)
            held = pa.StructArray.from_arrays(some.columns[:-1], names=some.schema.names[:-1])
            rows = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), rows, *(pa.array([a.tobytes()], pa.binary()) for a in (narrow(points), order, narrow(boxes)))], names=["n", "held", "points", "rows", "boxes"])


def nearest(points: np.ndarray, boxes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest entry of book for each point of the blocks, the squared distance, and the blocks that were settled by their boxes."""
    low, high = boxes[0][:, None, :], boxes[1][:, None, :]
    near, far = np.zeros((len(boxes[0]), len(book)), np.int64), np.zeros((len(boxes[0]), len(book)), np.int64)
    for i in range(book.shape[1]):
        a, b = low[..., i] - book[:, i], book[:, i] - high[..., i]
        near += np.maximum(np.maximum(a, b), 0) ** 2
        far += np.maximum(-a, -b) ** 2  # the farther side of the box: the larger of entry - low and high - entry
    listed = near <= far.min(axis=1, keepdims=True)
    count = listed.sum(axis=1)
    # the listed entries first, each in the order of their numbers
    lists = np.argsort(~listed, axis=1, kind="stable")
    n = len(points)
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    room = 1
    while True:
        mine = np.flatnonzero((count <= room) & (count > room // 2))
        if len(mine):
            at = (mine[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = np.minimum(at, n - 1)  # the last block can be shorter; its last point then comes several times
            short = lists[mine, : min(room, len(book))]
            over = np.arange(short.shape[1]) >= count[mine, None]
            own = points[at].reshape(len(mine), BLOCK, -1)
            d = np.zeros((len(mine), BLOCK, short.shape[1]), np.int64)
            for i in range(book.shape[1]):
                d += (own[:, :, None, i] - book[short, i][:, None, :]) ** 2
            d = np.where(over[:, None, :], np.iinfo(np.int64).max, d)
            best = d.argmin(axis=2)
            code[at] = np.take_along_axis(short, best, axis=1).ravel()
            error[at] = np.take_along_axis(d, best[..., None], axis=2).ravel()
        if room >= len(book):
            return code, error, count == 1
        room *= 2


def unpacked(batches, parts: int, dim: int):
    """Of each chunk the column of held rows, and for each part points, rows and boxes."""
    w = dim // parts
    for batch in batches:
        give_back()
        for k in range(batch.num_rows):
            n = batch.column(0)[k].as_py()
            points = np.frombuffer(batch.column(2)[k].as_buffer(), f"<i{batch.column(2)[k].as_buffer().size // (n * dim)}").reshape(parts, n, w)
            order = np.frombuffer(batch.column(3)[k].as_buffer(), "<u4").reshape(parts, n)
            boxes = widened(batch.column(4)[k].as_py(), parts * 3 * -(-n // BLOCK) * w).reshape(parts, 3, -1, w)
            yield batch.column(1)[k].values, points, order, boxes


def round_rows(batches, books: np.ndarray, parts: int, dim: int):
    """For each coordinate of the codebooks the sum and count of what this task's points add to it."""
    entries, w = books.shape[1:]
    total, count = np.zeros((parts, entries, w), object), np.zeros((parts, entries), np.int64)
    for _, points, _, boxes in unpacked(batches, parts, dim):
        for p in range(parts):
            own = points[p].astype(np.int64)
            code, _, settled = nearest(own, boxes[p], books[p])
            first = code[::BLOCK]
            sizes = np.minimum(BLOCK, len(own) - np.arange(len(first)) * BLOCK)
            here = np.zeros((entries, w), np.int64)
            np.add.at(here, first[settled], boxes[p][2][settled])
            open_ = ~np.repeat(settled, sizes)
            for i in range(w):  # below 2**53: exact
                here[:, i] += np.bincount(code[open_], own[open_, i], entries).astype(np.int64)
            total[p] += here
            count[p] += np.bincount(code[open_], minlength=entries) + np.bincount(first[settled], sizes[settled], entries).astype(np.int64)
    p, e, i = np.nonzero(np.repeat(count[:, :, None], w, axis=2))
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array([str(t) for t in total[p, e, i]], pa.string()), pa.array(count[p, e], pa.int64())], names=["part", "entry", "place", "total", "n"])


def code_rows(batches, books: np.ndarray, parts: int, dim: int):
    """The held rows with code and error."""
    for held, points, order, boxes in unpacked(batches, parts, dim):
        n = points.shape[1]
        codes, errors = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
        for p in range(parts):
            code, error, _ = nearest(points[p].astype(np.int64), boxes[p], books[p])
            codes[order[p], p] = code
            errors[order[p]] += error
        text = np.ascontiguousarray(HEX[codes]).view(np.uint8)
        offsets = np.arange(n + 1, dtype=np.int32) * 2 * parts
        code = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text))
        yield pa.RecordBatch.from_arrays([*held.flatten(), code, pa.array(errors)], names=[*(f.name for f in held.type), "code", "error"])


def fit(df: DataFrame, key: str, vector: str, keep: list[str], parts: int = 16, entries: int = 64, rounds: int = 2, scratch: Scratch | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codebooks, as an array (part, entry, place), and the rows: the columns keep, code (two hexadecimal digits a part)
    and error (squared distances summed over parts).

    A codebook starts as the parts of the vectors with the least keys; each round assigns all parts and moves the
    entries to the floors of their means."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    if bad := [c for c in keep if c.lower() in ("code", "error")]:
        raise ValueError(f"the table already has a column {bad[0]}; rename it")
    scratch = scratch or Scratch(df.sparkSession, "codes")
    left, dim = usable(df, vector, key, parts)
    kinds = df.select(*[col(c) for c in keep]).schema
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kinds] + ["code string", "error bigint"])
    if not dim:
        return df.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    w, numbers = dim // parts, col(vector).cast("array<double>")
    first = left.select(numbers.alias("v"), col(key).alias("k")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    books = lattice(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dim).reshape(len(first), parts, w).transpose(1, 0, 2).copy()
    held = ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in kinds)
    name = tmp_name(df)
    rows = left.select(*[col(c) for c in keep], numbers.alias(name))
    chunks = scratch.keep(rows.mapInArrow(lambda it: chunk_rows(it, dim, parts), f"n int, held array<struct<{held}>>, points binary, rows binary, boxes binary"), "chunks")
    for _ in range(rounds):
        # functions are sent with the codebooks of their round
        sums = chunks.mapInArrow(lambda it, b=books: round_rows(it, b, parts, dim), "part int, entry int, place int, total string, n bigint")
        wide = F.sum(F.col("total").cast("decimal(38,0)")).cast("string")
        for r in sums.groupBy("part", "entry", "place").agg(wide.alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return chunks.mapInArrow(lambda it, b=books: code_rows(it, b, parts, dim), schema), books


def group_errors(coded: DataFrame, label: str, out: str = "label_error", few: int = FEW) -> DataFrame:
    """coded with the sum of error over the rows of equal label, nulls together. Sums are made before the shuffle; they
    are sent to all tasks where there are few of them, and joined by a shuffle (split where a label is hot) otherwise."""
    key, other = tmp_name(coded), tmp_name(coded, "_label")
    sums = coded.groupBy(col(label).alias(other)).agg(F.sum("error").alias(key))
    many = sums.limit(few + 1).count() > few
    return coded.join(sums if many else F.broadcast(sums), col(label).eqNullSafe(col(other)), "left").drop(other).withColumnRenamed(key, out)


def decode(books: np.ndarray, code: str) -> list[int]:
    """The integer vector that a code stands for."""
    return [int(v) for p, e in enumerate(bytes.fromhex(code)) for v in books[p, e]]
