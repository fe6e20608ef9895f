"""WARC archives: the revisit rule, pushed predicates, payloads that are not inflated, and foreign archives."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from duoscope.llm import warc


@pytest.fixture
def archives(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://b/3\r\nX: y", big), (4, None, "small"), (5, "u", "small"), (6, "u", None), (7, "u", "z" * 1000), (None, "u", big)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload int").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.as_records(df), path)
    return pages, path


def test_round_trip(spark, archives):
    pages, path = archives
    got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(pages)
    for page, url, html in pages:
        r = got[f"urn:page:{'' if page is None else page}"]
        raw = (html or "").encode()
        revisit = page in (1, 2, None)
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == ("urn:page:3" if revisit else None)
        assert (r.payload_length, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r.payload is None if revisit else bytes(r.payload) == raw
        assert r.target_uri == (url and url.replace("\r\n", "%0D%0A"))


def test_predicates_reach_the_headers(spark, archives):
    _, path = archives
    df = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "isnotnull" not in plan
    assert sorted(r.record_id for r in df.collect()) == ["urn:page:1", "urn:page:2"]
    assert warc.read_archives(spark, path, payload=False).where(F.col("payload").isNotNull()).count() == 0
    assert warc.read_archives(spark, path).where("record_id IN ('urn:page:4', 'urn:page:7')").count() == 2


def test_unwanted_payloads_are_not_inflated():
    data = warc.member(warc.record("response", "urn:page:1", None, None, "00" * 20, 10**6, b"x" * 10**6, "1970-01-01T00:00:00Z"))
    m = warc.Member(memoryview(data + data), 0)
    m.head()
    assert len(m.text) <= warc.HEAD and m.end() == len(data)


def test_foreign_archives_have_no_lengths(spark, tmp_path):
    one = warc.record("response", "urn:x", "http://a", None, "00" * 20, 5, b"hello", "2020-01-01T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one.replace(b"urn:x", b"urn:y")))
    got = warc.read_archives(spark, f"file://{tmp_path}").orderBy("record_id").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("urn:x", b"hello"), ("urn:y", b"hello")]
    assert [r.record_id for r in warc.read_archives(spark, f"file://{tmp_path}", payload=False).where("record_id = 'urn:y'").collect()] == ["urn:y"]


def test_files_of_failed_attempts_are_not_read(spark, archives, tmp_path):
    pages, path = archives
    (tmp_path / "w" / "left-over.warc.gz").write_bytes(b"no archive")
    assert warc.read_archives(spark, path).count() == len(pages)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/none"
    warc.write_archives(warc.as_records(df), path)
    assert warc.read_archives(spark, path).collect() == []


def test_plain_files_and_members_of_several_records(spark, tmp_path):
    import pathlib

    pages = spark.createDataFrame([(1, "u", "x" * 3000), (2, None, "é"), (3, "w", "x" * 3000), (4, "v", None)], "page_id long, url string, html string")
    warc.write_archives(warc.as_records(pages), f"{tmp_path}/packed")
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(pathlib.Path(f"{tmp_path}/packed").rglob("*.warc.gz")))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/all.warc").write_bytes(raw)
    want, got = (sorted(map(repr, warc.read_archives(spark, f"{tmp_path}/{d}").collect())) for d in ("packed", "plain"))
    assert got == want and len(got) == 4
    assert warc.read_archives(spark, f"{tmp_path}/plain", payload=False).where("record_type = 'revisit'").count() == 1
    (tmp_path / "joined").mkdir()
    (tmp_path / "joined/all.warc.gz").write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="more than one record"):
        warc.read_archives(spark, f"{tmp_path}/joined").collect()
