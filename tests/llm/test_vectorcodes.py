"""Vector codes against comparing every part with every entry."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duoscope.llm import queries, vectorcodes

SF = "/root/testdata/sf0.001"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label). Codes and errors in order of id, and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(256 * np.array([r[1] for r in rows], float)).astype(np.int64).reshape(len(rows), parts, -1)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def assign():
        return np.array([((x[:, p, None, :] - np.array(books[p])[None]) ** 2).sum(2).argmin(1) for p in range(parts)]).T

    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p][e] = [int(v) // len(own) for v in own.sum(0)]
    code = assign()
    error = sum(((x[:, p] - np.array(books[p])[code[:, p]]) ** 2).sum(1) for p in range(parts))
    return rows, ["".join(f"{c:02x}" for c in r) for r in code], error.tolist(), books


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows, codes, errors, books = brute(list(zip(t["vec_id"], t["embedding"], t["label"])))
    by = {}
    for r, e in zip(rows, errors):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    want = {r[0]: (c, e, by[r[2]], digest) for r, c, e in zip(rows, codes, errors)}
    got = {r[0]: tuple(r[1:]) for r in queries.op11_vector_codes(spark, SF).collect()}
    assert got == want


def test_ties_nulls_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 32) / 8], None if i % 3 else i % 5) for i in range(200)]
    rows += [(7, rows[7][1], 1), (None, rows[9][1], 1), (None, rows[11][1], None)]
    bad = [(-5, None, 1), (-4, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-2, [float("inf")] * 32, 1), (-1, [], 1), (1000, [0.5] * 16, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "id long, `v.v` array<float>, label int, points string, n int")
    coded, _ = vectorcodes.fit(df.repartition(3), "id", "v.v", ["id", "label", "points", "n"], entries=10)
    sorted_rows, codes, errors, _ = brute(rows, entries=10)
    assert sorted((r.id is None, r.id or 0, r.code, r.error) for r in coded.collect()) == sorted((r[0] is None, r[0] or 0, c, e) for r, c, e in zip(sorted_rows, codes, errors))
    by = {}
    for r, e in zip(sorted_rows, errors):
        by[r[2]] = by.get(r[2], 0) + e
    for few in (0, 100):
        assert {(r.label, r.label_error) for r in vectorcodes.group_errors(coded, "label", few=few).collect()} == set(by.items())
    with pytest.raises(ValueError, match="already has"):
        vectorcodes.fit(df.withColumn("code", F.lit(1)), "id", "v.v", ["id", "code"])


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.1] * 16), (2, [0.1] * 16)], "id long, v array<double>")
    coded, books = vectorcodes.fit(df, "id", "v", ["id"])
    assert [(r.code, r.error) for r in coded.orderBy("id").collect()] == [("00" * 16, 0)] * 2 and books.shape == (16, 2, 1)
    assert vectorcodes.decode(books, "00" * 16) == [25] * 16
    coded, books = vectorcodes.fit(df.where("id > 5"), "id", "v", ["id"])
    assert coded.count() == 0 and coded.columns == ["id", "code", "error"]


@pytest.mark.parametrize("w", [1, 4, 70])
def test_shortlists_lose_no_entry(w):
    rng = np.random.default_rng(w)
    x = rng.integers(-9, 10, (333, w))
    x = x[np.argsort(vectorcodes.hilbert(x), kind="stable")]
    starts = np.arange(0, len(x), vectorcodes.BLOCK)
    boxes = np.stack([np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.add.reduceat(x, starts)])
    book = rng.integers(-9, 10, (37, w))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    code, error, _ = vectorcodes.nearest(x, boxes, book)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


def test_a_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(np.arange(1024), np.arange(4), indexing="ij"), -1).reshape(-1, 2)
    full = np.stack(np.meshgrid(*[np.arange(32)] * 2, indexing="ij"), -1).reshape(-1, 2) * 1023 // 31
    assert len(set(vectorcodes.hilbert(grid).tolist())) == len(grid)
    line = full[np.argsort(vectorcodes.hilbert(full))]
    assert np.abs(np.diff(line, axis=0)).sum(1).max() <= 70  # one step of the coarse grid, or two where rounding joins cells
