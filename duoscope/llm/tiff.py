"""TIFF columns: payloads stored losslessly as 8-bit images, and images read back page by page.

The reader walks the chain of image directories of each file, of either byte order, and decodes strips and tiles that
are stored plainly or by PackBits, LZW or deflate, undoes horizontal differencing, and gives one row for each page.
Files that break the format are an error that names what is wrong; a null file has no pages.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SCHEMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as a count and a byte, all else as literal stretches."""
    a = np.frombuffer(data, np.uint8)
    out = bytearray()
    if not len(a):
        return b""
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    literal = 0  # where the literal stretch that is open begins
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if e - s < 3:
            continue
        for i in range(literal, s, 128):
            part = data[i : min(i + 128, s)]
            out.append(len(part) - 1)
            out += part
        while e - s:
            n = min(e - s, 128)
            if n == 1:
                out += bytes((0, data[s]))
            else:
                out += bytes((257 - n, data[s]))
            s += n
        literal = e
    for i in range(literal, len(a), 128):
        part = data[i : i + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise ValueError("TIFF: a PackBits segment ends early")
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early, as the format has it."""
    acc, held, out = 0, 0, bytearray()

    def emit(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    table, width, new = {bytes([i]): i for i in range(256)}, 9, 258
    emit(256, width)
    now = b""
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        emit(table[now], width)
        table[longer] = new
        new += 1
        now = data[i : i + 1]
        if new == 4094:
            emit(256, width)
            table, width, new = {bytes([i]): i for i in range(256)}, 9, 258
        elif new + 1 > 1 << width:
            width += 1
    if now:
        emit(table[now], width)
        new += 1
        if new + 1 > 1 << width and width < 12:
            width += 1
    emit(257, width)
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    out, total, acc, held, width = [], 0, 0, 0, 9
    table, last = list(first), b""
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code == 257 or total >= size:
            break
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("TIFF: an LZW code is out of range")
        if last:
            table.append(last + now[:1])
        out.append(now)
        total += len(now)
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    got = b"".join(out)
    if len(got) < size:
        raise ValueError("TIFF: an LZW segment ends early")
    return got[:size]


def squeeze(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}[scheme](data)


def expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        out = bytes(data[:size])
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompress(data)[:size]
    elif scheme == LZW:
        return lzw_decode(data, size)
    elif scheme == PACKBITS:
        return unpack_bits(data, size)
    else:
        raise ValueError(f"TIFF: compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError("TIFF: a segment ends early")
    return out


def difference(rows: np.ndarray) -> np.ndarray:
    """rows: height x width x samples of one byte; each sample less the one to its left."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def write_pages(pages: list[np.ndarray], scheme: str = "deflate", predictor: bool = True, strip_rows: int = 512, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of pages, each height x width or height x width x samples of unsigned bytes."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        h, w, n = a.shape
        if tile:
            th, tw = tile
            full = np.pad(a, ((0, -h % th), (0, -w % tw), (0, 0)))
            blocks = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            blocks = [a[y : y + strip_rows] for y in range(0, h, strip_rows)]
        at, size = [], []
        for block in blocks:
            data = squeeze((difference(block) if predictor else block).tobytes(), SCHEMES[scheme])
            at.append(len(out))
            size.append(len(data))
            out += data
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * n), (COMPRESSION, 3, [SCHEMES[scheme]]), (PHOTOMETRIC, 3, [2 if n == 3 else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_AT, 4, at), (TILE_BYTES, 4, size)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, size)]
        body = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                spot = struct.pack(order + "I", len(out))
                out += raw
            else:
                spot = raw.ljust(4, b"\0")
            body.append(struct.pack(order + "HHI", tag, kind, len(values)) + spot)
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(body)) + b"".join(body)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: memoryview) -> list[dict[int, list[int]]]:
    """The tags of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("TIFF: no header")
    found, seen, at = [], set(), struct.unpack_from(order + "I", data, 4)[0]
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("TIFF: the chain of directories is broken")
        seen.add(at)
        tags = {}
        n = struct.unpack_from(order + "H", data, at)[0]
        for i in range(n):
            spot = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, spot)
            width = SIZES.get(kind, 1) * count
            where = spot + 8 if width <= 4 else struct.unpack_from(order + "I", data, spot + 8)[0]
            if kind in (1, 3, 4):
                tags[tag] = list(struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind] * count, data, where))
        found.append(tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return found


def page(data: memoryview, tags: dict[int, list[int]]) -> np.ndarray:
    """The samples of one page, height x width x samples, predictors undone."""
    w, h, n = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, [1])[0]
    if set(tags.get(BITS, [8])) != {8} or tags.get(PLANAR, [1])[0] != 1:
        raise ValueError("TIFF: only 8-bit samples stored together are supported")
    scheme, predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]

    def block(at: int, size: int, rows: int, width: int) -> np.ndarray:
        a = np.frombuffer(expand(bytes(data[at : at + size]), scheme, rows * width * n), np.uint8).reshape(rows, width, n)
        return np.cumsum(a, axis=1, dtype=np.uint8) if predictor == 2 else a

    if TILE_AT in tags:
        tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        across, down = -(-w // tw), -(-h // th)
        out = np.empty((down * th, across * tw, n), np.uint8)
        for i, (at, size) in enumerate(zip(tags[TILE_AT], tags[TILE_BYTES])):
            y, x = i // across * th, i % across * tw
            out[y : y + th, x : x + tw] = block(at, size, th, tw)
        return out[:h, :w]
    rows = min(tags.get(STRIP_ROWS, [h])[0], h)
    parts = [block(at, size, min(rows, h - i * rows), w) for i, (at, size) in enumerate(zip(tags[STRIP_AT], tags[STRIP_BYTES]))]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def payload_column(text: Column, multiple: int = 192) -> Column:
    """UTF-8 bytes of a text (null: none), filled up with spaces to a positive multiple."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.octet_length(raw)
    fill = F.when(n == 0, multiple).otherwise(F.pmod(-n, F.lit(multiple)))
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), fill), "utf-8"))


def image_column(payload: Column, width: int = 192, scheme: str = "deflate", predictor: bool = True, strip_rows: int = 512) -> Column:
    """A one-page grey TIFF of each payload, whose length is a multiple of width; null stays null."""

    @arrow_udf("binary")
    def image(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            v = r.as_py()
            out.append(None if v is None else write_pages([np.frombuffer(v, np.uint8).reshape(-1, width)], scheme, predictor, strip_rows))
        return pa.array(out, pa.binary())

    return image(payload)


def features(a: np.ndarray) -> str:
    """Size, sum, sum of squares, sum of steps along rows, and an 8 x 8 map of what is above the mean, as integers."""
    wide = a.astype(np.int64)
    h, w = wide.shape[:2]
    flat = wide.reshape(h, -1)
    ys, xs = np.arange(8) * h // 8, np.arange(8) * flat.shape[1] // 8
    cells = np.array([[flat[y : max(y + 1, y2), x : max(x + 1, x2)].mean() for x, x2 in zip(xs, [*xs[1:], flat.shape[1]])] for y, y2 in zip(ys, [*ys[1:], h])])
    bits = "".join("1" if c else "0" for c in (cells > flat.mean()).ravel())
    return f"{w}x{h};sum={flat.sum()};squares={(flat * flat).sum()};steps={np.abs(np.diff(flat, axis=1)).sum()};map={int(bits, 2):016x}"


def read_pages(df: DataFrame, image: str, keep: list[str]) -> DataFrame:
    """One row for each page of the TIFFs in column image: the columns keep, page (long, from 0), width, height,
    samples (int), pixels (binary, row by row) and feature (string). A null file gives no row."""
    clash = {"page", "width", "height", "samples", "pixels", "feature"} & {k.lower() for k in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename those of the table")
    made = ["page", "width", "height", "samples", "pixels", "feature"]
    plain = [f"k{i}" for i in range(len(keep))]  # names with dots don't pass through mapInArrow
    slim = df.select(*[col(k).alias(p) for k, p in zip(keep, plain)], col(image).alias("image"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[:-1]), "page bigint, width int, height int, samples int, pixels binary, feature string"])

    def walk(batches):
        for batch in batches:
            source, cols, held = [], [[], [], [], [], [], []], 0
            files = batch.column(len(keep))

            def flush():
                arrays = [batch.column(i).take(pa.array(source, pa.int64())) for i in range(len(keep))]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                return pa.RecordBatch.from_arrays(arrays + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[*plain, *made])

            for i, f in enumerate(files):
                if not f.is_valid:
                    continue
                data = memoryview(f.as_buffer())
                for k, tags in enumerate(directories(data)):
                    a = page(data, tags)
                    source.append(i)
                    for c, v in zip(cols, (k, a.shape[1], a.shape[0], a.shape[2], a.tobytes(), features(a))):
                        c.append(v)
                    held += a.size
                    if held > 8 << 20:
                        yield flush()
                        source, cols, held = [], [[], [], [], [], [], []], 0
            if source:
                yield flush()

    return slim.mapInArrow(walk, schema).toDF(*keep, *made)
