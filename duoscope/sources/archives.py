"""Lines of text in zip and xz files of any size, as a Spark data source that reads one file in many tasks.

An xz file is a row of streams, each with an index of its blocks at its end: the driver reads the indexes alone, and every
task decodes the blocks of its stretch. A zip file has a directory of its members at its end: a member is a stretch of its own,
and one that is stored as it is has several. A line belongs to the stretch in which it begins after the first byte (the first
stretch has the line at 0 too), so lines over several blocks are read once. Whatever a task reads passes through it in pieces.

Only xz files of several blocks (xz -T0, or --block-size) can be split; others are one task, without a limit of size.
Checksums of blocks and whole members are verified; stretches of stored members have none. Paths may be of any file system
that pyarrow.fs knows.
"""

from __future__ import annotations

import json
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of text in a stretch, at least; bytes that are decoded at once; lines and bytes in a batch of rows.
STRETCH, PIECE, LINES, BATCH = 128 << 20, 1 << 20, 10_000, 4 << 20
SCHEMA = "file string, member string, offset bigint, value string"
ARROW = pa.schema([("file", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("value", pa.string())])


class Block(NamedTuple):
    """A block of an xz file: its place and size there, the place and size of its text, and the header of its stream."""

    at: int
    size: int
    start: int
    length: int
    header: bytes


@dataclass
class Stretch(InputPartition):
    """Lines of a member that begin after `start` (or at 0) and not after `end`; first: the first of its blocks."""

    path: str
    member: str | None
    start: int
    end: int
    first: int = 0


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return pfs.LocalFileSystem().open_input_file(path)
    fs, inner = pfs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def part(f: Any, at: int, size: int) -> bytes:
    f.seek(at)
    got = f.read(size)
    if len(got) != size:
        raise ValueError(f"the file ends within {size} bytes at {at}")
    return got


def number_at(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the least first, and where it ends."""
    n = shift = 0
    while True:
        n |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return n, at


def blocks_of(f: Any, size: int) -> list[Block]:
    """All blocks of an xz file in order, from the indexes of its streams, which are found from the end on."""
    streams: list[list[tuple[int, int, int, bytes]]] = []
    end = size
    while end > 0:
        if end < 4 or end % 4:
            raise ValueError("not an xz file, or cut off")
        if part(f, end - 4, 4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        if end < 32:
            raise ValueError("not an xz file, or cut off")
        footer = part(f, end - 12, 12)
        if footer[10:] != b"YZ" or zlib.crc32(footer[4:10]) != struct.unpack("<I", footer[:4])[0]:
            raise ValueError("not an xz file, or cut off")
        n_index = (struct.unpack("<I", footer[4:8])[0] + 1) * 4
        index = part(f, end - 12 - n_index, n_index) if n_index + 12 <= end else b"\1"
        if index[0] or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("the index of an xz stream is broken")
        n, at = number_at(index, 1)
        sizes = []
        for _ in range(n):
            packed, at = number_at(index, at)
            plain, at = number_at(index, at)
            sizes.append(((packed + 3) // 4 * 4, plain))
        begin = end - 24 - n_index - sum(p for p, _ in sizes)
        header = part(f, begin, 12) if begin >= 0 else b""
        if header[:6] != b"\xfd7zXZ\0":
            raise ValueError("an xz stream does not begin where its index says")
        placed, place = [], begin + 12
        for packed, plain in sizes:
            placed.append((place, packed, plain, header))
            place += packed
        streams.append(placed)
        end = begin
    out, start = [], 0
    for at, packed, plain, header in (b for s in reversed(streams) for b in s):
        out.append(Block(at, packed, start, plain, header))
        start += plain
    return out


def decoded(f: Any, blocks: Iterable[Block]) -> Iterator[bytes]:
    """The text of blocks in pieces; a block with a wrong checksum or length is an error."""
    for b in blocks:
        stream, got, left, at = lzma.LZMADecompressor(lzma.FORMAT_XZ), 0, b.size, b.at
        feed = b.header
        while True:
            piece = stream.decompress(feed, PIECE)
            got += len(piece)
            if piece:
                yield piece
            feed = b""
            if stream.needs_input:
                if not left:
                    break
                feed = part(f, at, min(left, PIECE))
                at, left = at + len(feed), left - len(feed)
        if got != b.length:
            raise ValueError(f"a block at {b.at} holds {got} bytes, {b.length} are listed")


def pieces(f: Any, at: int, size: int) -> Iterator[bytes]:
    while size > 0:
        piece = part(f, at, min(size, PIECE))
        yield piece
        at, size = at + len(piece), size - len(piece)


def lines_of(text: Iterable[bytes], start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin after start (or at 0) and not after end, out of text from start on."""
    begin, held, skipped = start, [], start > 0
    for piece in text:
        ended = piece.split(b"\n")
        for line in ended[:-1]:
            held.append(line)
            whole = b"".join(held)
            held = []
            if not skipped:
                yield begin, whole
            skipped = False
            begin += len(whole) + 1
            if begin > end:
                return
        held.append(ended[-1])
    whole = b"".join(held)
    if whole and not skipped:
        yield begin, whole


def data_at(f: Any, info: zipfile.ZipInfo) -> int:
    """Where the bytes of a member begin."""
    name, extra = struct.unpack("<HH", part(f, info.header_offset + 26, 4))
    return info.header_offset + 30 + name + extra


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.member = json.loads(options["paths"]), options.get("member", ".*")
        self.encoding, self.stretch = options.get("encoding", "utf-8"), int(options.get("stretch", STRETCH))
        if "\n".encode(self.encoding) != b"\n":
            raise ValueError(f"{self.encoding} has no line feeds of one byte")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with opened(path) as f:
                if path.endswith(".zip"):
                    with zipfile.ZipFile(f) as z:
                        for m in sorted(z.infolist(), key=lambda m: m.filename):
                            if m.is_dir() or not re.fullmatch(self.member, m.filename):
                                continue
                            cut = self.stretch if m.compress_type == zipfile.ZIP_STORED and not m.flag_bits & 1 else m.file_size
                            starts = range(0, m.file_size, max(cut, 1))
                            out += [Stretch(path, m.filename, s, min(s + cut, m.file_size)) for s in starts]
                    continue
                blocks = blocks_of(f, f.size())
                first = 0
                for i, b in enumerate(blocks):
                    end = b.start + b.length
                    if end - blocks[first].start >= self.stretch or i == len(blocks) - 1:
                        out.append(Stretch(path, None, blocks[first].start, end, first))
                        first = i + 1
        return out or [Stretch("", None, 0, 0)]

    def text(self, f: Any, s: Stretch) -> Iterator[bytes]:
        if s.member is None:
            return decoded(f, blocks_of(f, f.size())[s.first :])
        z = zipfile.ZipFile(f)
        info = z.getinfo(s.member)
        if s.start or s.end < info.file_size:
            return pieces(f, data_at(f, info) + s.start, info.file_size - s.start)
        member = z.open(info)
        return iter(lambda: member.read(PIECE), b"")

    def read(self, s: Stretch) -> Iterator[pa.RecordBatch]:
        if not s.path:
            return
        with opened(s.path) as f:
            at, values, size = [], [], 0
            for offset, line in lines_of(self.text(f, s), s.start, s.end):
                at.append(offset)
                values.append(line.rstrip(b"\r").decode(self.encoding))
                size += len(line)
                if len(at) == LINES or size >= BATCH:
                    yield self.batch(s, at, values)
                    at, values, size = [], [], 0
            if at:
                yield self.batch(s, at, values)

    def batch(self, s: Stretch, at: list[int], values: list[str]) -> pa.RecordBatch:
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array([s.path] * n, pa.string()), pa.array([s.member] * n, pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.string())], schema=ARROW)


class Archives(DataSource):
    """file, member (null in xz), offset (bytes of the member's text before the line) and value of each line."""

    @classmethod
    def name(cls) -> str:
        return "archived_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> Reader:
        return Reader(self.options)


def lines(spark: SparkSession, pattern: str, member: str = ".*", encoding: str = "utf-8", stretch: int = STRETCH) -> DataFrame:
    """The lines of all zip and xz files that a pattern of paths fits; an error where it fits none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    paths = sorted(str(s.getPath()) for s in found or ())
    if not paths:
        raise FileNotFoundError(pattern)
    spark.dataSource.register(Archives)
    return spark.read.format("archived_lines").options(paths=json.dumps(paths), member=member, encoding=encoding, stretch=str(stretch)).load()
