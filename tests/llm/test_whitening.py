"""Whitening against the eigenvectors of the whole covariance."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from duoscope.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def exact(vectors):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    y = listed - sums / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, values[::-1], vecs[:, ::-1]


def test_query_equals_the_full_decomposition(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x, n, sums, values, vecs = exact(t["embedding"])
    got = queries.op12_whitening(spark, SF).collect()
    assert len(got) == 4 * len(x) and {r.n for r in got} == {n}
    place = {v: i for i, v in enumerate(t["vec_id"])}
    white = np.zeros((len(x), 4))
    for r in got:
        i = place[r.vec_id]
        white[i, r.component - 1] = r.whitened
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
    want = (x - sums / n) @ vecs[:, :4] / np.sqrt(values[:4])
    for c in range(4):
        sign = np.sign(white[:, c] @ want[:, c])
        assert np.abs(white[:, c] - sign * want[:, c]).max() < 1e-8


def test_repeats_nulls_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 0]).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(vectors + vectors[:1] * 40)]
    bad = [(None, None), (500, [None] * 6), (501, [float("inf")] * 6), (502, []), (503, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "d") for r in rows + bad], "id long, v array<double>, x string")
    basis, listed, left = whitening.fit(df.repartition(5), "v", "id")
    x, n, sums, values, vecs = exact(vectors)
    assert basis.n == n and basis.sums == sums.tolist() and np.allclose(basis.values, values[:4], rtol=1e-12)
    assert whitening.identity_error(basis, listed) < 1e-10
    got = whitening.whitened(left, basis, "v", ["id", "x"]).collect()
    assert len(got) == 100 and len({tuple(np.round(r.white.coordinates, 9)) for r in got if r.id == 0 or r.id >= 60}) == 1
    with pytest.raises(ValueError, match="already has"):
        whitening.whitened(left, basis, "v", ["id", "x"], out="X")


def test_without_variance(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "id long, v array<double>")
    basis, _, left = whitening.fit(df, "v", "id")
    assert basis.n == 1 and not len(basis.values) and left.count() == 2
    assert whitening.fit(df.where("id > 9"), "v", "id")[0] is None
    basis, listed, _ = whitening.fit(df.union(spark.createDataFrame([(3, [1.0, 0.0])], df.schema)), "v", "id")
    assert len(basis.values) == 1 and whitening.identity_error(basis, listed) < 1e-12


def test_wide_numbers_and_long_deviations(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1e6, 3.0]), (3, [-1e6, -2.0])], "id long, v array<double>")
    basis, _, left = whitening.fit(df, "v", "id")
    assert basis.sums == [0, 512]
    got = {r.id: r.white.deviation for r in whitening.whitened(left, basis, "v", ["id"]).collect()}
    assert got[2] == (3 * 256 * 10**6) ** 2 + (3 * 768 - 512) ** 2


@pytest.mark.parametrize("dim", [5, 64, 200])
def test_filter_finds_close_eigenvalues(dim):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = np.sort(1000 + 100 * rng.random(dim))[::-1]
    values[:2] += 500
    a = (q * values) @ q.T
    got, vecs, _, passes = whitening.eigenpairs(lambda b: a @ b, dim, 4)
    assert np.allclose(got, values[:4], rtol=1e-13) and np.abs(np.abs(np.sum(vecs * q[:, :4], axis=0)) - 1).max() < 1e-10
    assert passes < 120
