"""Embedding whitening: the leading principal components of a table of vectors, and each row in their coordinates at unit variance.

Components become integers x; the fit is made on the list of distinct x. Exact sums give the mean and the trace of the
covariance V. The leading eigenvectors come from a filtered subspace iteration: a block Q of some more columns than
components wanted goes through a Chebyshev polynomial of V, which is small over the unwanted part of the spectrum and
grows fast above it; QR makes the block orthonormal and the Rayleigh-Ritz step (eigenvectors of Q'VQ) turns it. Each
degree of the polynomial is one pass over the table that adds up Y'(YQ) of the centred rows Y; a task sends one row for
each dimension. The first filter takes 0 as the lower end of the spectrum; with it goes one Lanczos vector whose least
Ritz value gives a closer one. The loop ends when the residuals |Vu - eu| certify the pairs.

Driver and tasks hold matrices of dimension times block columns; no pass keeps rows. Null, empty and non-finite vectors
and those of another length are dropped (vectors.usable); repeated vectors count once in the fit, and all get their
rows. Components without variance (fewer distinct vectors than components, say) have no rows, since they can't be
scaled. A deviation beyond 64 bits is null. Vector components beyond 2**20 raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, give_back, tmp_name
from .vectors import lattice, narrow, usable, widened

#: Columns of the block beyond the components wanted, degree of the filter, filters at most, residual over the largest eigenvalue.
EXTRA, DEGREE, FILTERS, TOLERANCE = 28, 10, 400, 1e-13


@dataclass
class Basis:
    """A fit: n distinct vectors, their sums, the covariance's trace, eigenvalues (falling) and vectors (columns), and the residuals that certify them."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def packed_rows(batches, dim: int):
    for batch in batches:
        give_back()
        x = lattice(batch.column(0), dim)
        most = np.abs(x).max(axis=1, initial=0)
        small = narrow(x)
        raw = [r.tobytes() for r in small] if small.itemsize == 2 else [narrow(r).tobytes() for r in x]
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["x"]) if len(most) else pa.RecordBatch.from_arrays([pa.array([], pa.binary())], names=["x"])


def rows_of(packed: pa.Array, dim: int) -> np.ndarray:
    """The integer matrix of packed vectors."""
    if not len(packed):
        return np.zeros((0, dim), np.int64)
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    if (size == 2 * dim).all():
        _, offs, data = packed.buffers()
        first = np.frombuffer(offs, np.int32)[packed.offset]
        return np.frombuffer(data, "<i2", len(packed) * dim, first).reshape(-1, dim).astype(np.int64)
    return np.stack([widened(r.as_py(), dim) for r in packed])


def sum_rows(batches, dim: int):
    """Sums and sums of squares of each dimension, as text, since they can be longer than 64 bits."""
    total, square, n = [0] * dim, [0] * dim, 0
    for batch in batches:
        x = rows_of(batch.column(0), dim)
        n += len(x)
        for at in range(0, len(x), 64):  # 64 squares below 2**56
            part = x[at : at + 64]
            total = [a + int(b) for a, b in zip(total, part.sum(axis=0))]
            square = [a + int(b) for a, b in zip(square, (part * part).sum(axis=0))]
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total]), pa.array([str(s) for s in square]), pa.array([n] * dim, pa.int64())], names=["i", "total", "square", "n"])


def product_rows(batches, mean: np.ndarray, q: np.ndarray):
    """Y'(YQ) of the centred rows of a task, one row for each dimension."""
    dim = len(mean)
    acc = np.zeros(q.shape)
    for batch in batches:
        give_back()
        for at in range(0, batch.num_rows, 4096):
            y = rows_of(batch.column(0).slice(at, 4096), dim) - mean
            acc += y.T @ (y @ q)
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), *(pa.array(c) for c in acc.T)], names=["i", *(f"c{j}" for j in range(q.shape[1]))])


def scaled_rows(batches, mean: np.ndarray, w: np.ndarray):
    """Sums and products of the whitened rows of a task: row j of a k + 1 square, the last of it the sums."""
    k = w.shape[1]
    acc = np.zeros((k + 1, k + 1))
    for batch in batches:
        z = np.hstack([(rows_of(batch.column(0), len(mean)) - mean) @ w, np.ones((batch.num_rows, 1))])
        acc += z.T @ z
    yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), *(pa.array(c) for c in acc.T)], names=["i", *(f"c{j}" for j in range(k + 1))])


def added(df: DataFrame, work, width: int) -> np.ndarray:
    """The sum over tasks of what work gives: a matrix whose rows have numbers."""
    names = [f"c{j}" for j in range(width)]
    parts = df.mapInArrow(work, ", ".join(["i int", *(f"{c} double" for c in names)]))
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([r[1:] for r in sorted(rows, key=lambda r: r["i"])])


def eigenpairs(apply, dim: int, k: int, extra: int = EXTRA, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a positive semi-definite matrix, their vectors, residuals, and the passes taken.

    apply gives the matrix times a block. Ends when residuals are below tolerance times the largest value, or when they
    no longer fall and are below 1e4 times that, which is what rounding leaves; an error after FILTERS filters."""
    p = min(dim, k + extra)
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((dim, p)))[0]
    probe = rng.standard_normal(dim)
    probe /= np.linalg.norm(probe)
    chain, along, across = [probe], [], []  # Lanczos vectors and the diagonals of their matrix
    passes, low, before = 0, 0.0, np.inf
    for turn in range(FILTERS):
        more = turn == 0 and p < dim
        def times(block):
            nonlocal passes
            passes += 1
            if not more or len(chain) > dim:
                return apply(block)
            both = apply(np.column_stack([block, chain[-1]]))
            step = both[:, -1]
            along.append(float(step @ chain[-1]))
            for v in chain:  # the whole chain is kept orthogonal; it is short
                step = step - (step @ v) * v
            for v in chain:
                step = step - (step @ v) * v
            across.append(float(np.linalg.norm(step)))
            chain.append(step / across[-1] if across[-1] > 0 else np.zeros(dim))
            return both[:, :-1]

        vq = times(q)
        small = q.T @ vq
        theta, turned = np.linalg.eigh((small + small.T) / 2)
        theta, turned = theta[::-1], turned[:, ::-1]
        u, vu = q @ turned, vq @ turned
        residual = np.linalg.norm(vu[:, :k] - u[:, :k] * theta[:k], axis=0)
        top, worst = max(theta[0], 0.0), residual.max(initial=0.0)
        if worst <= tolerance * top or worst > before / 2 and worst <= 1e4 * tolerance * top or top == 0:
            return np.maximum(theta[:k], 0), u[:, :k], residual, passes
        before = worst if turn else np.inf
        # Chebyshev on [low, high]: the unwanted spectrum goes to [-1, 1]; scaled by its value at the largest eigenvalue
        high = max(theta[-1], 1e-9 * top)
        low = min(low, 0.9 * high)
        half, middle = (high - low) / 2, (high + low) / 2
        sigma = first = half / (low - top) if low != top else -1.0
        old, new = u, (vu - middle * u) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            old, new = new, (times(new) - middle * new) * (2 * after / half) - (sigma * after) * old
            sigma = after
        q = np.linalg.qr(new)[0]
        if more and along:
            t = np.diag(along) + np.diag(across[:-1], 1) + np.diag(across[:-1], -1)
            ritz, vec = np.linalg.eigh(t)
            low = max(0.0, float(ritz[0] - abs(across[-1] * vec[-1, 0])))
    raise RuntimeError(f"no certified eigenpairs after {passes} passes")


def fit(df: DataFrame, vector: str, key: str, k: int = 4, scratch: Scratch | None = None) -> tuple[Basis | None, DataFrame | None, DataFrame]:
    """The basis of k components, the list of distinct vectors it was fitted on, and the rows that are left. None where no row is left."""
    scratch = scratch or Scratch(df.sparkSession, "whitening")
    left, dim = usable(df, vector, key)
    if not dim:
        return None, None, left
    numbers = left.select(col(vector).cast("array<double>").alias("v"))
    listed = scratch.keep(numbers.mapInArrow(lambda it: packed_rows(it, dim), "x binary").distinct(), "distinct")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    sums = sorted(listed.mapInArrow(lambda it: sum_rows(it, dim), "i int, total string, square string, n bigint").groupBy("i").agg(wide("total"), wide("square"), F.sum("n").alias("n")).collect())
    n, totals = sums[0]["n"], [int(r["total"]) for r in sums]
    trace = float(Fraction(sum(n * int(r["square"]) - t * t for r, t in zip(sums, totals)), n * n))
    basis = Basis(n, totals, trace, np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    if trace > 0:
        mean = basis.mean

        def apply(block):
            return added(listed, lambda it: product_rows(it, mean, block), block.shape[1]) / n

        values, vectors, residuals, passes = eigenpairs(apply, dim, min(k, dim))
        real = values > 1e-10 * values[0]
        basis = Basis(n, totals, trace, values[real], vectors[:, real], residuals[real], passes)
    return basis, listed, left


def identity_error(basis: Basis, listed: DataFrame) -> float:
    """Largest absolute entry of the whitened list's covariance minus the identity, measured in one pass."""
    k, mean, w = len(basis.values), basis.mean, basis.vectors / np.sqrt(basis.values)
    m = added(listed, lambda it: scaled_rows(it, mean, w), k + 1) / basis.n
    return float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())


def whitened(left: DataFrame, basis: Basis, vector: str, keep: list[str], out: str = "white") -> DataFrame:
    """The rows with the columns keep and, in a structure out, deviation (exact, null beyond 64 bits) and the coordinates."""
    if out.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the table already has a column {out}; choose another output name")
    n, sums, mean, w, dim = basis.n, basis.sums, basis.mean, basis.vectors / np.sqrt(basis.values), len(basis.sums)
    kinds = left.select(*[col(c) for c in keep]).schema
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kinds] + [f"`{out}` struct<deviation: bigint, coordinates: array<double>>"])

    def work(batches):
        for batch in batches:
            give_back()
            x = lattice(batch.column(batch.num_columns - 1), dim)
            room = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums))
            exact = x if dim * room * room < 1 << 63 else x.astype(object)  # numbers of any length where 64 bits could be too few
            d = ((n * exact - np.array(sums, exact.dtype)) ** 2).sum(axis=1) if len(x) else []
            d = pa.array([int(v) if int(v) < 1 << 63 else None for v in d], pa.int64())
            z = (x - mean) @ w
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays([d, lists], names=["deviation", "coordinates"])], names=[*batch.schema.names[:-1], out])

    return left.select(*[col(c) for c in keep], col(vector).cast("array<double>").alias(tmp_name(left))).mapInArrow(work, schema)
