"""What a build holds and where it came from: hashes of its files, its provenance file, and their check from a pinned hash down.

The pin is the SHA-256 of provenance.json; that lists an entry for each table or file of the build, and an entry is checked
against the files. Files are hashed in pieces, one task a file at most, whatever their size. Names that begin with _ or . are
no part of a build; Spark's readers pass over them too.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives
from .tables import _fs, _there

FILE = "provenance.json"
#: Bytes hashed at once; groups in which the files of a table are hashed first.
PIECE, GROUPS = 1 << 20, 1024

# What the line about a build calls its sources; the line must agree.
LABELS = {
    "ddinter": "DDInter bulk download (ddinter2.scbdd.com, 2024-05-21)",
    "sider": "SIDER 4.1",
    "rxnorm": "RxNorm Current Prescribable",
    "drugbank": "DrugBank vocabulary",
    "drugsatfda": "Drugs@FDA brand names",
    "twosides": "TWOSIDES (research only; not for redistribution)",
}


class BuildError(RuntimeError):
    """A build that must not be used; the message says why."""


def sha256_of(path: str) -> str:
    """The SHA-256 of a file, read in pieces."""
    done = hashlib.sha256()
    with archives.opened(path) as f:
        while piece := f.read(PIECE):
            done.update(piece)
    return done.hexdigest()


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"path": df["path"], "sha256": [sha256_of(p) for p in df["path"]], "n_bytes": df["length"]}, columns=["path", "sha256", "n_bytes"])


def listed_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """path and length of every file that a pattern fits or that is under a folder it fits, empty ones too (Spark's own reader of
    files leaves those out); names that begin with _ or . below it are left out."""
    at, fs = _fs(spark, pattern)
    out = []
    for hit in fs.globStatus(at) or ():
        root = str(hit.getPath())
        files = fs.listFiles(hit.getPath(), True)
        while files.hasNext():
            f = files.next()
            path = str(f.getPath())
            if not any(p[:1] in ("_", ".") for p in path[len(root) :].split("/") if p):
                out.append((path, f.getLen()))
    return out


def of_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 and n_bytes of every file under paths. The driver lists names and sizes; the files are spread over tasks, the
    largest apart, and each is read by the task that hashes it."""
    found = sorted((f for p in paths for f in listed_files(spark, p)), key=lambda f: (-f[1], f[0]))
    files = spark.createDataFrame(found, "path string, length bigint")
    return files.repartition(max(1, min(len(found), 8 * spark.sparkContext.defaultParallelism))).mapInPandas(hashed, "path string, sha256 string, n_bytes bigint")


def hashes(spark: SparkSession, paths: list[str], but: tuple[str, ...] = (FILE,)) -> DataFrame:
    """name (the last two parts of the path), sha256 and n_bytes of every file under paths."""
    last = F.substring_index("path", "/", -1)
    return of_paths(spark, paths).where(~last.isin(*but)).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), "sha256", "n_bytes")


def together(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and sha256: the hash over the names and hashes of each group's rows, in the order of the names."""
    each = F.array_sort(F.collect_list(F.concat(F.col(name), F.lit(":"), "sha256")))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(each, "\n"), 256).alias("sha256"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """name and sha256 of everything in a folder: a file's own hash; for a table of several files, a hash over their names and
    hashes. Those are first joined in groups by name, so no task holds all files of a table."""
    at, fs = _fs(spark, folder)
    root = re.sub("^file:/+", "file:/", str(fs.makeQualified(at))).rstrip("/") + "/"
    inner = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(root) + 1, 1 << 20)
    rows = of_paths(spark, [folder]).select(inner.alias("inner"), "sha256").withColumn("name", F.substring_index("inner", "/", 1))
    single = rows.where("inner = name").select("name", "sha256")
    groups = together(rows.where("inner <> name").withColumn("g", F.pmod(F.crc32(F.encode("inner", "utf-8")), F.lit(GROUPS)).cast("string")), ["name", "g"], "inner")
    return single.unionByName(together(groups, ["name"], "g"))


def verify(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """name and status (same, changed, missing, extra) of every file that is listed or there."""
    x, y = listed.select("name", F.col("sha256").alias("expected")), actual.select("name", F.col("sha256").alias("found"))
    status = F.when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.col("expected") != F.col("found"), "changed").otherwise("same")
    return x.join(y, "name", "full").select("name", status.alias("status"))


def verify_build(spark: SparkSession, folder: str, pin: str) -> DataFrame:
    """name and status of provenance.json and of every entry that it lists or that is there: same, changed, missing or extra.

    Where provenance.json is not the pinned one its list proves nothing, so all else is unverified; a list without entries is
    itself missing (processed_files).
    """
    if not _there(spark, f"{folder}/{FILE}"):
        return spark.createDataFrame([(FILE, "missing")], "name string, status string")
    found = entries(spark, folder)
    own = found.where(F.col("name") == FILE).select(F.when(F.col("sha256") == pin, "same").otherwise("changed").alias("own"))
    raw = spark.read.text(f"{folder}/{FILE}", wholetext=True)
    listing = F.coalesce(F.from_json(F.get_json_object("value", "$.processed_files"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    listed = raw.select(F.explode(listing).alias("name", "sha256"))
    each = verify(listed, found.where(F.col("name") != FILE))
    each = each.unionByName(raw.where(F.size(listing) == 0).select(F.lit("processed_files").alias("name"), F.lit("missing").alias("status")))
    each = each.crossJoin(F.broadcast(own))  # one row
    return each.select("name", F.when(F.col("own") == "same", F.col("status")).otherwise("unverified").alias("status")).unionByName(own.select(F.lit(FILE).alias("name"), F.col("own").alias("status")))


def require_build(spark: SparkSession, folder: str, pin: str, shown: int = 5) -> None:
    """Raises BuildError unless all of a build is as pinned."""
    bad = verify_build(spark, folder, pin).where("status <> 'same'").orderBy(F.col("name") != FILE, "name").limit(shown).collect()
    if bad:
        raise BuildError("; ".join(f"{r['name']} is {r['status']}" for r in bad))


def stamp(tables: dict[str, DataFrame], by: str = "source") -> DataFrame:
    """table, source and n: what a build holds, for its provenance file. A table without such a column counts as one."""
    parts = [df.groupBy((F.col(by) if by in df.columns else F.lit("all")).alias("source")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "source", "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(spark: SparkSession, folder: str, report: DataFrame, mode: str, **more: object) -> str:
    """Writes provenance.json of a build out of its report (table, source, n) and gives its hash, the pin. mode: sample or full;
    more: further fields, such as profile, sources (by key, with their version) and source_order. One entry a table is listed."""
    n: dict[str, dict[str, int]] = {}
    for r in report.collect():
        n.setdefault(r.table, {})[r.source] = r.n
    made = n.get("interactions", {})
    data = {"mode": mode, "synthetic": mode == "sample", "interaction_records": sum(made.values()), "interactions_by_source": made, "side_effect_records": sum(n.get("side_effects", {}).values()), "join_integrity_issues": sum(n.get("issues", {}).values()), **more}
    data["processed_files"] = {r["name"]: r["sha256"] for r in entries(spark, folder).where(F.col("name") != FILE).collect()}
    text = json.dumps(data, indent=2, sort_keys=True) + "\n"
    at, fs = _fs(spark, f"{folder}/{FILE}")
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return hashlib.sha256(text.encode()).hexdigest()


def read(spark: SparkSession, folder: str) -> dict | None:
    """The provenance of a build; null where there is none."""
    if not _there(spark, f"{folder}/{FILE}"):
        return None
    return json.loads(spark.read.text(f"{folder}/{FILE}", wholetext=True).first()["value"])


def line(data: dict | None) -> str:
    """One line that says what data a build holds; what is unknown is said to be."""
    if data is None:
        return "Data: no ingestion record found; data provenance unknown."
    n = data["interaction_records"]
    if data.get("mode") == "full":
        sources = data.get("sources", {})
        called = [f"{LABELS.get(k, k)} {sources[k]['version']}" if k == "rxnorm" and sources.get(k, {}).get("version") else LABELS.get(k, k) for k in data.get("source_order", sorted(sources))]
        return f"Data: {data.get('profile')} build from {', '.join(called)}; {n:,} interaction records; not synthetic."
    if data.get("synthetic"):
        return f"Data: synthetic sample dataset ({n} interaction records), not real clinical data."
    by = ", ".join(f"{k} {v}" for k, v in sorted(data["interactions_by_source"].items()))
    return f"Data: {n} interaction records ingested from data/raw ({by or 'no sources'})."


def data_stamp(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """profile, data (the line) and provenance_sha256 of the build that a result came from."""
    data = read(spark, folder)
    profile = None if data is None else data.get("profile") or ("sample" if data.get("synthetic") else data.get("mode"))
    sha = None if data is None else of_paths(spark, [f"{folder}/{FILE}"]).first()["sha256"]
    return {"profile": profile, "data": line(data), "provenance_sha256": sha}
