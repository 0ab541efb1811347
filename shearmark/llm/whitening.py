"""Whitening of embeddings by their leading principal components, found by Jacobi-Davidson.

The covariance is never formed: a pass over the distinct vectors applies it, centred, to a few directions at a time.
The eigenvectors are sought in a growing subspace.  Its Rayleigh-Ritz pairs that have a residual at the level of
rounding are locked; every other one asks for the correction t that solves (I - QQ') (V - theta I) (I - QQ') t = -r,
Q being the locked and the current vectors.  These equations are solved roughly by a few steps of MINRES, all of them
side by side, so that a step of all is one pass.  The corrections extend the subspace.  On the driver there are only
matrices of the dimension by some dozens of columns.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import settle

SCALE = 64.0
SHIFT = 1_000_000
COMPONENTS = 16
TOLERANCE = 1e-13
INNER_STEPS = 4
SUBSPACE = 96
ROUNDS = 200


def whole(vector: str) -> Column:
    """floor(64 * c) + 1000000 of every component; null where the vector takes no part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(wide, lambda x: F.floor(x * F.lit(SCALE)).cast("long") + F.lit(SHIFT)))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    rows = batch.column(column)
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def summed(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Sum of the matrices that tasks give as (i, v): entries are added up on the cluster."""
    out = np.zeros(rows * columns)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # rows * columns numbers
        out[r["i"]] = r["v"]
    return out.reshape(rows, columns)


class Covariance:
    """V of a table of vectors (x: whole numbers of one length), applied to blocks of directions by a pass over it."""

    def __init__(self, fit: DataFrame, dim: int):
        self.fit, self.dim, self.passes = fit, dim, 0
        totals = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
        self.n = fit.count()
        self.sums = [0] * dim
        for r in totals:  # one number a dimension
            self.sums[r["i"]] = int(r["s"])

    def centred(self):
        """x - S / n of a batch: the large whole numbers cancel before anything is rounded."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - base) - rest

    def gathered(self, weigh, columns: int) -> np.ndarray:
        """Sum over the vectors of a matrix [dim, columns] that ``weigh`` makes of each centred batch."""
        centred = self.centred()

        def scan(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = weigh(centred(matrix(batch)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

        self.passes += 1
        return summed(self.fit.mapInArrow(scan, "i long, v double"), self.dim, columns)

    def __call__(self, directions: np.ndarray) -> np.ndarray:
        return self.gathered(lambda y: y.T @ (y @ directions), directions.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.gathered(lambda y: (y * y).sum(axis=0)[:, None], 1).sum() / self.n)


def minres(apply, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for several symmetric systems side by side; ``apply`` maps all columns at once."""
    n, k = rhs.shape
    x, d1, d2, v_old = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    beta = np.linalg.norm(rhs, axis=0)
    v = rhs / np.where(beta > 0, beta, 1)
    eta, c, c_old, s, s_old = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    beta = np.zeros(k)
    for _ in range(steps):
        w = apply(v) - beta * v_old
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v
        next_beta = np.linalg.norm(w, axis=0)
        r3, r2 = s_old * beta, s * alpha + c_old * c * beta
        r1 = c * alpha - c_old * s * beta
        size = np.hypot(r1, next_beta)
        going = size > 1e-300
        safe = np.where(going, size, 1)
        c_old, s_old = c, s
        c, s = np.where(going, r1 / safe, 1), np.where(going, next_beta / safe, 0)
        direction = np.where(going, (v - r3 * d1 - r2 * d2) / safe, 0)
        x = x + c * eta * direction
        eta = -s * eta
        d1, d2 = d2, direction
        v_old, v, beta = v, w / np.where(next_beta > 1e-300, next_beta, 1), next_beta
    return x


def orthogonal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add to ``basis`` what ``new`` has besides; directions that vanish are left out."""
    out = basis[:, :0]
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            for b in (basis, out):
                column = column - b @ (b.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-8 * size:
            column = column / left
            for b in (basis, out):
                column = column - b @ (b.T @ column)
            out = np.c_[out, column / np.linalg.norm(column)]
    return out


def ritz_turns(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values from large to small, and the coordinates of their vectors in the basis."""
    small = basis.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], turns[:, ::-1]


def jacobi_davidson(apply, dim: int, wanted: int, tolerance: float = TOLERANCE, inner: int = INNER_STEPS,
                    most: int = SUBSPACE) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite map and their vectors, residuals below tolerance * the largest."""
    wanted = min(wanted, dim)
    most = max(most, 3 * wanted)
    start = np.random.default_rng(7).standard_normal((dim, min(dim, wanted + 4)))
    basis = orthogonal(start, np.zeros((dim, 0)))
    image, whole_space = apply(basis), False
    for _ in range(ROUNDS):
        values, turns = ritz_turns(basis, image)
        values, ritz = values[:wanted], basis @ turns[:, :wanted]
        rest = image @ turns[:, :wanted] - ritz * values
        bad = np.linalg.norm(rest, axis=0) > tolerance * max(abs(values[0]), 1e-300)
        # locked are the converged pairs; the order of the open ones may still change
        if not bad.any() or basis.shape[1] == dim and whole_space:
            return values, ritz
        if basis.shape[1] == dim:  # nothing is left to add: fresh images, without the rounding of the older ones
            image, whole_space = apply(basis), True
            continue
        open_ = np.flatnonzero(bad)
        q, theta = ritz, values[open_]
        project = lambda y: y - q @ (q.T @ y)
        shifted = lambda y: project(apply(project(y)) - project(y) * theta)
        corrections = minres(shifted, -project(rest[:, open_]), inner)
        if basis.shape[1] + len(open_) > most:  # start anew from the best directions of the subspace
            turn = turns[:, :2 * wanted]
            basis, image = basis @ turn, image @ turn
        more = orthogonal(corrections, basis)
        if not more.shape[1]:  # nothing new in them: the residuals themselves, then any direction
            more = orthogonal(rest[:, open_], basis)
        if not more.shape[1]:
            more = orthogonal(np.random.default_rng(basis.shape[1]).standard_normal((dim, len(open_))), basis)
        basis, image = np.c_[basis, more], np.c_[image, apply(more)]
    raise ArithmeticError(f"no convergence in {ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding",
           tolerance: float = TOLERANCE, inner: int = INNER_STEPS) -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained and identity_error of every row and component.

    Vectors that are null or hold null or non-finite entries give no rows.  The fit list has each distinct vector once;
    a repeated row is whitened as often as it is there, a null key stays null.  Vectors of different lengths are fitted
    apart.  Directions without variance (eigenvalue below 1e-12 of the trace) are no components, so equal vectors only, or
    vectors of length 0, give no rows; nor does an empty table.  Equal eigenvalues share any orthonormal basis.
    Other columns are not read.
    """
    rows = settle(vectors.select(F.col(key).alias("key"), whole(vector).alias("x")).filter("x is not null"), "whole_vectors")
    fit = settle(rows.select("x").distinct(), "fit_list")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    # as many numbers as there are different lengths: one, unless tables are mixed
    dims = sorted(r[0] for r in fit.select(F.size("x")).distinct().collect() if r[0] > 0)
    parts = [whitened_rows(rows.filter(F.size("x") == dim), fit.filter(F.size("x") == dim), dim, components, tolerance, inner, schema)
             for dim in dims]
    out = reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def whitened_rows(rows: DataFrame, fit: DataFrame, dim: int, components: int, tolerance: float, inner: int, schema: str) -> DataFrame:
    v = Covariance(fit, dim)
    n, sums, centred, trace = v.n, v.sums, v.centred(), v.trace()
    values, units = jacobi_davidson(v, dim, components, tolerance, inner) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    real = values > 1e-12 * trace
    values, units = values[real], units[:, real]
    turn, k = units / np.sqrt(values), len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)

    def product(y):
        w = y @ turn
        both = np.zeros((dim, k))
        both[:k] = w.T @ w
        return both

    error = float(np.abs(v.gathered(product, k)[:k] / n - np.eye(k)).max())
    explained = values / trace
    base, rest = [s // n for s in sums], [s % n for s in sums]

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, m = matrix(part), part.num_rows
                # n * x - S as n * (x - base) - rest, in whole numbers of any size where 64 bits may not do
                away = x - np.array(base, dtype=np.int64)
                big = (int(np.abs(away).max(initial=0)) + 1) * n
                kind = object if big * big * dim >= 1 << 63 else np.int64
                off = away.astype(kind) * n - np.array(rest, dtype=kind)
                deviation = (off * off).sum(axis=1)
                repeat = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(repeat), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                     pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0)).take(repeat), pa.array((centred(x) @ turn).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(scan, schema)
