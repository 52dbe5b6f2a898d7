"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from jobledger.session import materialise

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARD = 24
DEGREE = 12
CERTIFIED = 1e-13
PASSES = 3_000


@dataclass(frozen=True)
class Whitening:
    """What one fit gives: a few vectors of the embeddings' length, whatever the number of rows."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``x`` of the usable rows: each entry c, as double, is floor(1024 c) + 100000.

    A vector that is null, or holds a null or non-finite entry, is dropped.  So
    is one whose length is not that of most others (ties: the longer length counts).
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    rows = materialise(rows, "vectors")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), dtype=np.int64).reshape(-1, d)


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all vectors of ``add(block)``, ``size`` numbers; each task sends that many, Spark adds them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(_matrix(batch, 0, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["cell", "v"])

    cells = rows.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in cells:
        out[r.cell] = r.v
    return out


def _covariance_times(rows: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V Q by one pass: the vectors are centred, then multiplied with Q and with the product again."""
    d, p = q.shape

    def add(x: np.ndarray) -> np.ndarray:
        c = x - mean
        return (c.T @ (c @ q)).ravel()

    return _summed(rows, d * p, add, d).reshape(d, p) / n


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """p(V) Q for the Chebyshev polynomial that stays below 1 on [0, ``cut``], scaled to about 1 at ``top``."""
    half = cut / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    before, now = q, (times(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (tau - sigma)
        before, now = now, 2 * following / half * (times(now) - half * now) - sigma * following * before
        sigma = following
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, trace: float, guard: int = GUARD, degree: int = DEGREE,
            certified: float = CERTIFIED, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``k`` largest eigenvalues, their vectors, the largest residual over the largest eigenvalue, and the passes taken.

    The block has ``guard`` vectors more than are wanted, so its smallest Ritz
    value, which no eigenvalue outside the wanted ones can be proven to exceed,
    is the end of the spectrum to be damped.  A round filters, takes QR and the Rayleigh-Ritz
    vectors, and measures ``|V q - t q|`` for the wanted ones.  It ends below
    ``certified`` times the largest value, or once rounding lets a round
    gain nothing more below a thousand times that.
    """
    p = min(d, k + guard)
    q = np.linalg.qr(np.random.default_rng(20).standard_normal((d, p)))[0]
    taken, last = 0, np.inf
    while True:
        vq = times(q)
        taken += 1
        h = q.T @ vq
        t, u = np.linalg.eigh((h + h.T) / 2)
        t, u = t[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * t[:k], axis=0).max() / max(t[0], 1e-300))
        if residual <= certified or (residual <= 1000 * certified and residual > last / 2):
            real = t[:k] > 1e-12 * trace
            return t[:k][real], q[:, :k][:, real], residual, taken
        if taken > passes:
            raise ArithmeticError(f"residual {residual:.1e} after {taken} passes; raise guard or degree")
        last = residual
        wanted = t[:k][t[:k] > 1e-12 * trace][-1]
        cut = max(t[-1], wanted / 1000)
        q = np.linalg.qr(chebyshev(times, q, degree, cut, max(t[0], 2 * cut)))[0]
        taken += degree


def fit(rows: DataFrame, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> Whitening | None:
    """Mean, leading components and their certificate over all rows of ``whole_numbers``; None where there is no variance.

    ``rows`` is a written table that each pass reads once; what reaches the
    driver is one vector per component and guard.  A lost executor costs the tasks of one pass.
    """
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    n, d = sums[0].n, len(sums)
    total = np.zeros(d, np.int64)
    for r in sums:
        total[r.i] = r.s
    # Whole and fractional part apart: the mean is then exact to the last bit, however many rows there are.
    mean = np.array([int(s) // n + (int(s) % n) / n for s in total])
    trace = _summed(rows, 1, lambda x: np.array([((x - mean) ** 2).sum()]), d)[0] / n
    if trace <= 0:
        return None
    values, vectors, residual, passes = leading(lambda q: _covariance_times(rows, n, mean, q), d, min(k, d), trace, guard, degree)
    a = vectors / np.sqrt(values)
    c = len(values)

    def add(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ a
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    moments = _summed(rows, c * c + c, add, d) / n
    covariance = moments[:c * c].reshape(c, c) - np.outer(moments[c * c:], moments[c * c:])
    return Whitening(n, total, vectors, values, trace, residual, passes, float(np.abs(covariance - np.eye(c)).max()))


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; null where it is no long."""
    y = n * x - sums
    if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0 ** 62:
        return (y * y).sum(1).tolist()
    exact = (sum(v * v for v in row) for row in y.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Unusable vectors (``whole_numbers``) have no rows.  Ids may be null or
    repeat: each row is judged by its vector alone.  Components whose eigenvalue is zero (all rows
    alike in that direction; a single row) are left out, so a table without variance, or an
    empty one, gives no rows.  Equal eigenvalues have no vectors of their own: any basis
    of theirs may come out.  Other columns are not looked at.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    rows = whole_numbers(df, id_col, vector_col)
    model = fit(rows, k)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return spark.createDataFrame([], schema)
    n, sums, vectors, values, explained, error = (
        model.n, model.sums, model.vectors, model.values, model.values / model.trace, model.identity_error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c = vectors.shape
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch, 1, d)
            # n x - S is exact in whole numbers; one division centres.
            w = ((n * x - sums) / n) @ vectors / np.sqrt(values)
            every = pa.array(np.repeat(np.arange(m), c))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(every), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)),
                 pa.array(_deviation(x, n, sums), pa.int64()).take(every), pa.array(w.ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))], schema.names)

    return rows.mapInArrow(run, schema)
