"""WARC archives as a PySpark data source, and the rule that stores equal payloads once.

Writing: each task writes one .warc.gz file under a name of its own, a gzip member for each record, with the member's
lengths in the gzip header. The commit lists the files of the tasks that succeeded, with the offset of a record every
few MB, in a manifest; files of failed or repeated attempts are in no manifest and are not read.

Reading: a partition is a stretch of a file between two listed offsets, or a whole file where there is no manifest.
Of each record the headers are inflated first. Predicates on the record type, ids, address and digest are pushed down
and decided on the headers; a record that fails them is skipped by its stored length, its payload never inflated.
With the option payload=none no payload is. Plain .warc files are read by the lengths in their headers; a gzip member that
holds more than one record is an error. In a folder with manifests, files that no manifest lists are not read.

Paths may be of any file system that pyarrow.fs knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import col

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of compressed records between two offsets that a manifest lists.
STRETCH = 8 << 20
#: Bytes of the first inflation of a record; more follow where its headers are longer.
HEAD = 2048


def member(data: bytes) -> bytes:
    """A gzip member whose header holds its lengths (subfield "sl": compressed, plain)."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def clean(value: str) -> str:
    """A header value: no line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, ident: str, uri: str | None, refers_to: str | None, digest: str, length: int, payload: bytes, date: str) -> bytes:
    """One record; the digest is the hex SHA-1 of the full payload and length its bytes, also where it is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{clean(ident)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {clean(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{clean(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


def headers_of(text: bytes) -> dict[str, str]:
    found = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def row_of(head: dict[str, str]) -> dict[str, str | None]:
    row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if row[c] is not None:
            row[c] = row[c].removeprefix("<").removesuffix(">")
    if digest := row["payload_digest"]:
        value = digest.partition(":")[2]
        row["payload_digest"] = value.lower() if len(value) == 40 else base64.b32decode(value).hex()
    return row


class Member:
    """One gzip member at an offset of data; its text is inflated only as far as it is asked for."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.size = data, at, None
        if bytes(data[at : at + 4]) == b"\x1f\x8b\x08\x04":
            n = struct.unpack_from("<H", data, at + 10)[0]
            field = at + 12
            while field < at + 12 + n:
                name, width = struct.unpack_from("<2sH", data, field)
                if name == b"sl" and width >= 4:
                    self.size = struct.unpack_from("<I", data, field + 4)[0]
                field += 4 + width
        self.inflate = zlib.decompressobj(31)
        self.text = b""
        self.pending = data[at : at + self.size] if self.size else data[at:]

    def more(self, n: int) -> bool:
        """Inflates n bytes more, or all with 0; false at the member's end."""
        if self.inflate.eof:
            return False
        self.text += self.inflate.decompress(self.pending, n)
        self.pending = self.inflate.unconsumed_tail
        return True

    def head(self) -> dict[str, str]:
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self.more(HEAD):
                raise ValueError(f"no WARC record at offset {self.at}")
        self.body_at = end + 4
        head = headers_of(self.text[:end])
        self.length = int(head["content-length"])
        return head

    def whole(self) -> bytes:
        self.more(0)
        return self.text[self.body_at :]

    def end(self) -> int:
        if self.size:
            return self.at + self.size
        total = len(self.text)
        while not self.inflate.eof:
            self.text = b""
            if not self.more(1 << 20) or (not self.pending and not self.inflate.eof):
                raise ValueError(f"the gzip member at offset {self.at} ends early")
            total += len(self.text)
        if total > self.body_at + self.length + 4:
            raise ValueError(f"the gzip member at offset {self.at} holds more than one record")
        return len(self.data) - len(self.inflate.unused_data)


class Plain:
    """As Member, for a record that is not compressed."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.text, self.body_at = data, at, b"", 0

    def head(self) -> dict[str, str]:
        size = HEAD
        while (end := bytes(self.data[self.at : self.at + size]).find(b"\r\n\r\n")) < 0:
            if self.at + size >= len(self.data):
                raise ValueError(f"no WARC record at offset {self.at}")
            size *= 2
        self.body_at = end + 4
        self.text = bytes(self.data[self.at : self.at + self.body_at])
        head = headers_of(self.text[:end])
        self.length = int(head["content-length"])
        return head

    def more(self, n: int) -> bool:
        """The first n bytes of the body, or all with 0; false if they are there."""
        whole = self.body_at + self.length
        if len(self.text) >= whole:
            return False
        self.text = bytes(self.data[self.at : self.at + (min(whole, len(self.text) + n) if n else whole)])
        return True

    def whole(self) -> bytes:
        self.more(0)
        return self.text[self.body_at :]

    def end(self) -> int:
        return self.at + self.body_at + self.length + 4


def passes(row: dict[str, str | None], tests: list[tuple[str, str, object]]) -> bool:
    for column, kind, value in tests:
        have = row[column]
        if kind == "null" and have is not None or kind != "null" and have is None:
            return False
        if kind == "equal" and have != value or kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
            return False
    return True


def place(path: str):
    fs, at = pfs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    marks: list[int]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((name, "equal", f.value))
            elif isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((name, "null" if isinstance(f, IsNull) else "some", None))
            else:
                yield f

    def partitions(self):
        fs, at = place(self.path)
        found = [f for f in fs.get_file_info(pfs.FileSelector(at, recursive=True)) if f.type == pfs.FileType.File]
        lists = [f.path for f in found if f.base_name.startswith("_manifest-")]
        parts = []
        for name in sorted(lists):
            with fs.open_input_file(name) as f:
                for entry in json.loads(f.read()):
                    marks = entry["marks"]
                    parts += [Stretch(f"{at}/{entry['file']}", a, b) for a, b in zip(marks[:-1], marks[1:])]
        if not lists:
            parts = [Stretch(f.path, 0, f.size) for f in found if f.base_name.endswith((".warc.gz", ".warc"))]
        return parts or [Stretch("", 0, 0)]

    def read(self, part: Stretch):
        names = [*HEADERS, "payload_length", "payload"]
        kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        if not part.file:
            return
        fs, _ = place(self.path)
        with fs.open_input_file(part.file) as f:
            f.seek(part.start)
            data = memoryview(f.read(part.end - part.start))
        rows, held, at = [], 0, 0
        while at < len(data):
            m = (Member if bytes(data[at : at + 2]) == b"\x1f\x8b" else Plain)(data, at)
            head = m.head()
            row = row_of(head)
            if passes(row, self.tests):
                http = head.get("content-type", "").startswith("application/http")
                length = payload = None
                if http:
                    block = m.whole() if self.payload else None
                    if block is None:
                        while (cut := m.text.find(b"\r\n\r\n", m.body_at)) < 0 and m.more(HEAD):
                            pass
                        inner = m.text[m.body_at : cut]
                    else:
                        cut = block.find(b"\r\n\r\n")
                        inner = block[:cut]
                    stated = headers_of(inner).get("content-length", "")
                    length = int(stated) if stated.isdigit() else None
                    if block is not None and row["record_type"] != "revisit":
                        payload = block[cut + 4 : int(head["content-length"])]
                elif self.payload:
                    payload = m.whole()[: int(head["content-length"])]
                    length = len(payload)
                rows.append([*row.values(), length, payload])
                held += len(payload or b"")
                if held > 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            at = m.end()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite, self.job = path, date, overwrite, uuid.uuid4().hex

    def write(self, batches):
        fs, at = place(self.path)
        name, size, marks, out = f"{self.job}-{uuid.uuid4().hex}.warc.gz", 0, [0], None
        for batch in batches:
            for r in batch.select(["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length", "payload"]).to_pylist():
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_length"], r["payload"] or b"", self.date))
                out.write(data)
                size += len(data)
                if size - marks[-1] >= STRETCH:
                    marks.append(size)
        if out is None:
            return Written(None, [])
        out.close()
        return Written(name, marks if marks[-1] == size else [*marks, size])

    def commit(self, messages):
        fs, at = place(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pfs.FileSelector(at)):
                if f.type == pfs.FileType.File and not f.base_name.startswith(self.job) and f.base_name.endswith((".warc.gz", ".json")):
                    fs.delete_file(f.path)
        with fs.open_output_stream(f"{at}/_manifest-{self.job}.json") as f:
            f.write(json.dumps([{"file": m.file, "marks": m.marks} for m in messages if m and m.file]).encode())

    def abort(self, messages):
        fs, at = place(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{at}/{m.file}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "all") != "none")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives in a folder, in the columns of SCHEMA; a revisit has no payload of its own, its
    payload_length and payload_digest are those of the payload it stands for. An empty folder gives no rows."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", "all" if payload else "none").load(path)


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Adds records (columns of SCHEMA) to the archives of a folder."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("date", date).mode("append").save(path)


def as_records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """A record for each page, columns as in SCHEMA, the id urn:page:<page id>.

    Of pages whose payloads (UTF-8 html; null: empty) are equal and of least bytes or more, that with the largest id is
    the response and the others revisit it; shorter payloads are all responses. Rows that share the largest id are all
    responses; a page without an id revisits where it can. Groups are found on SHA-256 and lengths, pre-aggregated; the
    join back is on these, and a common page is a skewed key of that join, which Spark splits.
    """
    raw = F.encode(F.coalesce(col(html), F.lit("")), "utf-8")
    rows = pages.select(col(page).alias("p"), col(url).alias("target_uri"), raw.alias("payload"))
    rows = rows.select("p", "target_uri", F.sha1("payload").alias("d"), F.sha2("payload", 256).alias("e"), F.octet_length("payload").cast("bigint").alias("n"), "payload")
    groups = rows.where(F.col("n") >= least).groupBy("e", "n").agg(F.max("p").alias("last"), F.count(F.lit(1)).alias("k")).where("k > 1 AND last IS NOT NULL").select("e", "n", "last")
    seen = rows.join(groups, ["e", "n"], "left").withColumn("again", F.col("last").isNotNull() & (F.col("p").isNull() | (F.col("p") < F.col("last"))))

    def urn(c):
        return F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))

    return seen.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), urn(F.col("p")).alias("record_id"), "target_uri",
        F.when(F.col("again"), urn(F.col("last"))).alias("refers_to"), F.col("d").alias("payload_digest"), F.col("n").alias("payload_length"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )
