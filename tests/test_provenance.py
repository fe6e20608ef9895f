"""From the pin down: provenance, entries and files; and what is said of a build."""

import hashlib
import json

import pytest

from duoscope.sources import provenance as pv


def build(spark, folder):
    spark.range(20).repartition(5).write.parquet(f"{folder}/numbers.parquet")
    (folder / "one.csv").write_bytes(b"x" * (3 << 20))
    (folder / "empty").write_bytes(b"")
    report = spark.createDataFrame([("interactions", "A", 1200), ("interactions", "B", 34), ("side_effects", "S", 7)], "table string, source string, n bigint")
    return pv.write(spark, str(folder), report, "full", profile="public", sources={"rxnorm": {"version": "v9"}, "sider": {}}, source_order=["rxnorm", "sider"])


def statuses(spark, folder, pin):
    return {r["name"]: r["status"] for r in pv.verify_build(spark, str(folder), pin).collect()}


def test_chain(spark, tmp_path):
    folder = tmp_path / "b c"
    folder.mkdir()
    pin = build(spark, folder)
    assert pin == hashlib.sha256((folder / "provenance.json").read_bytes()).hexdigest()
    names = {"provenance.json", "numbers.parquet", "one.csv", "empty"}
    assert statuses(spark, folder, pin) == dict.fromkeys(names, "same")
    pv.require_build(spark, str(folder), pin)
    listed = json.loads((folder / "provenance.json").read_text())["processed_files"]
    assert listed["one.csv"] == hashlib.sha256(b"x" * (3 << 20)).hexdigest() and listed["empty"] == hashlib.sha256(b"").hexdigest()
    stamp = pv.data_stamp(spark, str(folder))
    assert stamp == {"profile": "public", "data": "Data: public build from RxNorm Current Prescribable v9, SIDER 4.1; 1,234 interaction records; not synthetic.", "provenance_sha256": pin}
    assert set(statuses(spark, folder, "0" * 64).values()) == {"unverified", "changed"}
    (folder / "one.csv").write_bytes(b"y")
    (folder / "more.txt").write_bytes(b"y")
    (folder / "empty").unlink()
    (part, *_) = sorted(folder.glob("numbers.parquet/*.parquet"))
    part.rename(part.with_name("moved.parquet"))
    assert statuses(spark, folder, pin) == {"provenance.json": "same", "numbers.parquet": "changed", "one.csv": "changed", "empty": "missing", "more.txt": "extra"}
    with pytest.raises(pv.BuildError, match="empty is missing; more.txt is extra"):
        pv.require_build(spark, str(folder), pin)


def test_builds_without_a_list(spark, tmp_path):
    assert statuses(spark, tmp_path, "x") == {"provenance.json": "missing"} and pv.read(spark, str(tmp_path)) is None
    assert pv.data_stamp(spark, str(tmp_path)) == {"profile": None, "data": "Data: no ingestion record found; data provenance unknown.", "provenance_sha256": None}
    text = json.dumps({"mode": "sample", "synthetic": True, "interaction_records": 5, "interactions_by_source": {"A": 5}})
    (tmp_path / "provenance.json").write_text(text)
    assert statuses(spark, tmp_path, hashlib.sha256(text.encode()).hexdigest()) == {"provenance.json": "same", "processed_files": "missing"}
    assert pv.data_stamp(spark, str(tmp_path))["profile"] == "sample"
    assert pv.line(json.loads(text)) == "Data: synthetic sample dataset (5 interaction records), not real clinical data."
    assert pv.line({"mode": "x", "interaction_records": 3, "interactions_by_source": {"b": 1, "a": 2}}) == "Data: 3 interaction records ingested from data/raw (a 2, b 1)." and pv.line({"interaction_records": 0, "interactions_by_source": {}}).endswith("(no sources).")
