"""Split reading of xz and zip files against Python's own decoders."""

import io
import lzma
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.errors import PySparkException

from duoscope.sources import archives, readers


def plain_lines(data):
    """(offset, line) by a plain walk."""
    out, at = [], 0
    for line in data.split(b"\n"):
        if line or at + len(line) < len(data):
            out.append((at, line.rstrip(b"\r")))
        at += len(line) + 1
    return out


def number(n):
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def many_blocks(texts):
    """One xz stream with a block for each text."""
    header, body, records = None, b"", b""
    for t in texts:
        data = lzma.compress(t, preset=0)
        (b,) = archives.blocks_of(io.BytesIO(data), len(data))
        n_index = (struct.unpack("<I", data[-8:-4])[0] + 1) * 4
        packed, _ = archives.number_at(data[-12 - n_index :], 2)
        header, body, records = b.header, body + data[b.at : b.at + b.size], records + number(packed) + number(len(t))
    index = b"\0" + number(len(texts)) + records
    index += b"\0" * (-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + header[6:8]
    return header + body + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"


def samples():
    rnd = random.Random(5)
    texts = [b"".join(bytes(rnd.choice(b"ab\n\r") for _ in range(rnd.randrange(1, 60))) for _ in range(4)) for _ in range(12)]
    long = [b"x" * 3000, b"y" * 3000, b"\nz\n", b"\n", b"last"]
    return {"mixed": texts, "long": long, "ends": [b"a\n", b"b\n", b"\n\n"], "one": [b"only"], "bare": [b"\n"]}


@pytest.mark.parametrize("name", list(samples()))
def test_every_split_of_blocks(name):
    texts = samples()[name]
    whole = b"".join(texts)
    streams = [lzma.compress(t, preset=0, check=c) for t, c in zip(texts, [lzma.CHECK_CRC64, lzma.CHECK_SHA256, lzma.CHECK_NONE] * len(texts))]
    assert lzma.decompress(many_blocks(texts)) == whole == lzma.decompress(b"".join(streams))
    # Python's own decoder stops at padding between streams, so the padded ones are only held against the text
    for data in (many_blocks(texts), b"".join(streams), b"\0\0\0\0".join(streams), many_blocks(texts[:1]) + b"\0" * 8 + b"".join(streams[1:]), lzma.compress(b"") + many_blocks(texts)):
        f = io.BytesIO(data)
        blocks = archives.blocks_of(f, len(data))
        assert b"".join(archives.decoded(f, blocks)) == whole
        for size in (1, 40, 200, 10**9):
            got, first = [], 0
            for i, b in enumerate(blocks):
                end = b.start + b.length
                if end - blocks[first].start >= size or i == len(blocks) - 1:
                    got += [(at, line.rstrip(b"\r")) for at, line in archives.lines_of(archives.decoded(f, blocks[first:]), blocks[first].start, end)]
                    first = i + 1
            assert got == plain_lines(whole)


def test_one_file_in_many_tasks(spark, tmp_path):
    texts = [("".join(f"{i},{j},é\r\n" for j in range(300))).encode() for i in range(9)]
    texts[4] = b"half a line "
    (tmp_path / "a.csv.xz").write_bytes(many_blocks(texts))
    df = archives.lines(spark, f"file://{tmp_path}/a*.xz", stretch=2000)
    assert df.rdd.getNumPartitions() >= 5
    assert sorted((r.offset, r.value) for r in df.collect()) == [(at, x.decode()) for at, x in plain_lines(b"".join(texts))]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr(zipfile.ZipInfo("d/stored.txt"), b"".join(texts))
        z.writestr("d/packed.txt", b"caf\xe9\tx\n\nend", compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("d/empty.txt", b"")
        z.writestr("other.md", b"no\n")
    df = archives.lines(spark, str(tmp_path / "b.zip"), r"d/.*\.txt", encoding="latin-1", stretch=2000)
    assert df.rdd.getNumPartitions() >= 6
    rows = sorted((r.member, r.offset, r.value) for r in df.collect())
    assert rows == [("d/packed.txt", 0, "café\tx"), ("d/packed.txt", 7, ""), ("d/packed.txt", 8, "end")] + [("d/stored.txt", at, x.decode("latin-1")) for at, x in plain_lines(b"".join(texts))]
    assert readers.fields(archives.lines(spark, str(tmp_path / "b.zip"), "d/packed.txt", encoding="latin-1"), "\t").columns == ["café", "x"]
    assert archives.lines(spark, str(tmp_path / "b.zip"), "none").count() == 0


def test_broken_files(spark, tmp_path):
    good = many_blocks([b"a\n" * 500, b"b\n" * 500])
    hurt = bytearray(good)
    hurt[archives.blocks_of(io.BytesIO(good), len(good))[1].at + 20] ^= 1
    for name, data in {"cut": good[:-4], "text": b"no archive at all, only text....", "hurt": bytes(hurt)}.items():
        (tmp_path / f"{name}.xz").write_bytes(data)
        with pytest.raises(PySparkException):
            archives.lines(spark, str(tmp_path / f"{name}.xz")).collect()
    with pytest.raises(FileNotFoundError):
        archives.lines(spark, str(tmp_path / "none.xz"))
    (tmp_path / "empty.xz").write_bytes(b"")
    assert archives.lines(spark, str(tmp_path / "empty.xz")).count() == 0
