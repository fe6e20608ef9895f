"""TIFF: round trips through every scheme, strips and tiles, several pages, both byte orders, and broken files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.llm import tiff


def sample(seed, h, w, n):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (h, w, n), dtype=np.uint8)
    a[h // 3 :] = np.repeat(rng.integers(0, 4, (h - h // 3, 1, n), dtype=np.uint8), w, axis=1)
    return a


@pytest.mark.parametrize("scheme", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(scheme, predictor, tile, order):
    pages = [sample(1, 37, 50, 1), sample(2, 5, 3, 3), sample(3, 120, 192, 1)]
    data = memoryview(tiff.write_pages(pages, scheme, predictor, 10, tile, order))
    back = [tiff.page(data, tags) for tags in tiff.directories(data)]
    assert len(back) == 3 and all((a == b).all() for a, b in zip(pages, back))


def test_codes():
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 3, 127, 128, 129, 300, 9000, 60000):
        for raw in (bytes(size), rng.integers(0, 3, size, dtype=np.uint8).tobytes(), rng.integers(0, 256, size, dtype=np.uint8).tobytes()):
            assert tiff.unpack_bits(tiff.pack_bits(raw), size) == raw
            assert tiff.lzw_decode(tiff.lzw_encode(raw), size) == raw


@pytest.mark.parametrize("data", [b"", b"II*\0", b"II" + struct.pack("<HI", 42, 8) + b"\0", b"II" + struct.pack("<HI", 42, 8) + struct.pack("<HI", 0, 8)])
def test_broken_files_are_named(data):
    with pytest.raises((ValueError, struct.error)):
        tiff.directories(memoryview(data))


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é" * 500, 0), (3, "é" * 500, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `x.y` int")
    media = df.select("doc_id", "`x.y`", tiff.image_column(tiff.payload_column(F.col("text"))).alias("m"))
    got = tiff.read_pages(media, "m", ["doc_id", "x.y"]).orderBy("doc_id").collect()
    assert [(r.page, len(r.pixels)) for r in got] == [(0, 192), (0, 192), (0, 1152), (0, 1152)]
    assert bytes(got[2].pixels) == ("é" * 500).encode() + b" " * 152 and got[2].feature == got[3].feature
    assert zlib.crc32(bytes(got[0].pixels)[-16:]) == zlib.crc32(b" " * 16)
    assert tiff.read_pages(media.limit(0), "m", ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="rename"):
        tiff.read_pages(media.withColumnRenamed("doc_id", "Page"), "m", ["Page"])


def test_pages_are_rows(spark):
    data = tiff.write_pages([sample(1, 4, 5, 1), sample(2, 6, 7, 3)], "lzw")
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, m binary")
    assert [(r.id, r.page, r.width, r.height, r.samples) for r in tiff.read_pages(df, "m", ["id"]).collect()] == [(1, 0, 5, 4, 1), (1, 1, 7, 6, 3)]
