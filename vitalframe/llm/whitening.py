"""Whitening of embeddings by block Jacobi-Davidson over distributed products.

The covariance is never formed. A product with a block of vectors is one pass over the fit list: every task multiplies
its centred rows, and only (dimension, column) sums meet. The leading eigenpairs come from a search space that grows by
approximate solutions of the projected correction equations

    (I - Q Q') (A - theta I) (I - Q Q') t = -r,    Q' t = 0,

one for each wanted pair, all solved side by side by inner MINRES, so an inner step is one pass for all of them. Each
outer step does Rayleigh-Ritz on the search space; pairs whose residual has reached double precision are locked and
projected out. It ends when all wanted pairs are locked.

Numbers that sit on the driver or travel to tasks are of dimension x columns, never of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import stored

COMPONENTS = 16
#: Vectors sought beside the wanted ones, which guard the order of close eigenvalues.
GUARD = 4
INNER = 6
OUTER = 60
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are cut to it, so that sums of entries stay exact.
LARGEST = 1 << 40


class Fit:
    """The fit list: n distinct integer vectors, stored, and their exact sums."""

    def __init__(self, rows: DataFrame, dim: int) -> None:
        self.rows, self.dim = rows, dim
        self.n = rows.count()
        sums = {r.i: int(r.s) for r in self._summed(lambda x: x.sum(0)[:, None], "long").collect()}
        #: exact sums of the x, in Python integers
        self.sums = [sums.get(i, 0) for i in range(dim)]
        base = [s // self.n if self.n else 0 for s in self.sums]
        self.base = np.array(base, np.int64)
        #: what remains of the mean beside its integer part
        self.part = np.array([(s - b * self.n) / self.n if self.n else 0.0 for s, b in zip(self.sums, base)])

    def _summed(self, tally, kind: str = "double") -> DataFrame:
        """(i, j, s): sums over the tasks of what ``tally`` makes of all rows of a batch, an (i, j) table."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = tally(matrix(batch.column(0), dim))
                total = part if total is None else total + part
            if total is not None:
                i, j = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

        parts = self.rows.select("x").mapInArrow(run, f"i long, j long, s {kind}")
        return parts.groupBy("i", "j").agg(F.sum("s").alias("s"))

    def table(self, tally, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        for r in self._summed(tally).collect():  # dimension x columns numbers
            out[r.i, r.j] = r.s
        return out

    def centred(self):
        base, part = self.base, self.part
        return lambda x: (x - base) - part  # the first difference is exact

    def product(self, v: np.ndarray) -> np.ndarray:
        """A v for the covariance A and a block of columns v, in one pass."""
        centred = self.centred()

        def tally(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ v)

        return self.table(tally, v.shape) / self.n

    def trace(self) -> float:
        centred = self.centred()
        return float(self.table(lambda x: np.square(centred(x)).sum(0)[:, None], (self.dim, 1)).sum()) / self.n


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of equally long lists as rows."""
    return np.asarray(column.flatten()).reshape(-1, dim)


def orthonormal(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to the bases; near-dependent ones go."""
    for _ in range(2):
        for q in bases:
            block = block - q @ (q.T @ block)
        norm = np.linalg.norm(block, axis=0)
        block = block[:, norm > 1e-13] / norm[norm > 1e-13]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block


def correction(product, q: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of the projected correction equations, a column for each theta, by MINRES.

    The columns have recurrences of their own and share the product of each step.
    """

    def project(z: np.ndarray) -> np.ndarray:
        z = z - q @ (q.T @ z)
        return z - q @ (q.T @ z)

    r = project(-residual)
    beta = np.linalg.norm(r, axis=0)
    live = beta > 0
    t = np.zeros_like(r)
    v_old, v = np.zeros_like(r), r / np.where(live, beta, 1)
    d_old, d = np.zeros_like(r), np.zeros_like(r)
    c, s = np.ones(len(theta)), np.zeros(len(theta))
    c_old, s_old = c.copy(), s.copy()
    eta, beta_k = beta.copy(), np.zeros(len(theta))
    for _ in range(steps):
        if not live.any():
            break
        w = project(product(v) - v * theta)
        alpha = np.einsum("ij,ij->j", v, w)
        w = w - alpha * v - beta_k * v_old
        beta_next = np.linalg.norm(w, axis=0)
        # QR of the tridiagonal matrix, one rotation a step
        delta = c * alpha - c_old * s * beta_k
        rho = np.hypot(delta, beta_next)
        live &= rho > 1e-300
        safe = np.where(live, rho, 1)
        second = s * alpha + c_old * c * beta_k
        third = s_old * beta_k
        d_old, d = d, (v - third * d_old - second * d) / safe
        c_old, s_old = c, s
        c, s = delta / safe, beta_next / safe
        t = t + np.where(live, c * eta, 0) * d
        eta = np.where(live, -s * eta, eta)
        live &= (np.abs(eta) > 1e-3 * beta) & (beta_next > 0)
        v_old, v = v, w / np.where(beta_next > 0, beta_next, 1)
        beta_k = beta_next
    return t


def leading_pairs(product, dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator given by its block product."""
    wanted = min(wanted, dim)
    block = min(dim, wanted + GUARD)
    widest = max(4 * block, 64)
    rng = np.random.default_rng(seed)
    v = orthonormal(rng.standard_normal((dim, block)))
    av = product(v)
    locked, values, alocked = np.zeros((dim, 0)), np.zeros(0), np.zeros((dim, 0))
    scale = 0.0
    for _ in range(OUTER):
        theta, y = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = v @ y, av @ y
        scale = max(scale, float(np.abs(theta).max(initial=0)), float(np.abs(values).max(initial=0)))
        missing = wanted - len(values)
        residual = au - u * theta
        if locked.shape[1]:
            residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        done = size <= 8 * np.finfo(float).eps * np.sqrt(dim) * scale
        # pairs are locked in order, so that none is passed over
        n = int(np.argmin(np.append(done[:missing], False)))
        locked, alocked, values = np.hstack([locked, u[:, :n]]), np.hstack([alocked, au[:, :n]]), np.append(values, theta[:n])
        if len(values) == wanted:
            break
        u, au, theta, residual = u[:, n:], au[:, n:], theta[n:], residual[:, n:]
        if u.shape[1] + block > widest:
            u, au = u[:, : 2 * block], au[:, : 2 * block]
        active = min(block, u.shape[1])
        v, av = u, au
        if locked.shape[1] + v.shape[1] < dim:
            basis = np.hstack([locked, u[:, :active]])
            t = correction(product, basis, theta[:active], residual[:, :active], INNER)
            t = orthonormal(t, locked, v)
            if not t.shape[1]:
                t = orthonormal(rng.standard_normal((dim, block)), locked, v)
            at = product(t)
            v, av = np.hstack([v, t]), np.hstack([av, at])
        else:
            # the space is whole: rounding alone is left, which products of the Ritz vectors themselves take out
            v = orthonormal(u, locked)
            av = product(v)
        if locked.shape[1]:
            av = av - locked @ (locked.T @ av)
    else:
        raise RuntimeError(f"{len(values)} of {wanted} eigenpairs after {OUTER} steps")
    # locked pairs meet once more, so that close values are in order and the vectors orthogonal to rounding
    h = locked.T @ alocked
    theta, y = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], locked @ y[:, ::-1]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is neither null nor empty and holds no null or non-finite entry.

    x is floor(64 c) + 1000000 of each entry c; an entry beyond 2**40 either way counts as 2**40.
    """
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    scaled = F.transform(
        F.col("embedding"),
        lambda c: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + F.lit(SHIFT),
    )
    return vectors.filter(whole).select("vec_id", scaled.alias("x"))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and leading component.

    Vectors (``vec_id``, ``embedding``) that are null, empty or hold null or non-finite entries are dropped, and so are
    those that have not the most frequent length (the longer of two as frequent). Distinct vectors are the fit list; repeated
    rows each come out. Components whose variance is zero but for rounding cannot be scaled to one and are left out:
    with one distinct vector, or none, no rows come out. deviation is null where it does not fit in a long. A null vec_id stays.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors)
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0].d if lengths else 1
    whole = stored(whole.filter(F.size("x") == dim), "vectors")
    fit = Fit(stored(whole.select("x").distinct(), "fit"), dim)
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(
        whole.schema["vec_id"].dataType.simpleString()
    )
    trace = fit.trace() if fit.n else 0.0
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes = leading_pairs(fit.product, dim, wanted)
    kept = values > dim * np.finfo(float).eps * values[0]
    values, axes = values[kept], axes[:, kept]
    turn = axes / np.sqrt(values)
    centred = fit.centred()

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ turn
        return np.vstack([z.T @ z, z.sum(0)[None, :]])

    k = len(values)
    second = fit.table(moments, (k + 1, k)) / fit.n
    error = float(np.abs(second[:k] - np.outer(second[k], second[k]) - np.eye(k)).max())
    n, base, explained = fit.n, fit.base, values / trace
    rest = np.array([s - int(b) * n for s, b in zip(fit.sums, base)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            z = centred(x) @ turn
            near = x - base
            fits = np.square((near * float(n) - rest)).sum(1) < 9.2e18
            deviation = np.square(np.where(fits[:, None], near, 0) * n - rest).sum(1)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n)),
                    pa.array(deviation[rows], mask=~fits[rows]),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whole.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
