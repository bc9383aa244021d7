"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V are found without forming V. A
pass over the vectors gives V Q = Xᵀ (X Q) / n for a narrow block Q: every task
multiplies its own centred vectors and Spark sums the small products. A
polynomial of V, evaluated by the Chebyshev recurrence with one pass per
degree, damps the unwanted end of the spectrum; QR and a Rayleigh-Ritz step
follow, until residuals and gaps certify the wanted eigenvectors.

Entries become integers (``floor(scale * c) + offset``), so counts, sums and
deviations are exact at any size; a vector is centred before it is multiplied.
The driver holds dimension x block numbers, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

BLOCK_BYTES = 4 << 20  # of integers in one stored block of vectors
WIDTH = 4  # columns of Q for each wanted component
FRESH = 2  # columns that are drawn anew after each cycle, to meet missed directions
LIMIT = 1 << 52  # larger entries count as this much: a double still holds them
ROUNDOFF = 4e-15  # residual, of the largest eigenvalue, that rounding leaves
ACCURACY = 1e-12  # residual over gap at which an eigenvector counts as found
MOST_CYCLES = 60


@dataclass(frozen=True)
class Spectrum:
    """Exact moments of the vectors and their leading eigenvectors."""

    n: int
    sums: list[int]  # exact, per dimension
    trace: float
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # dimension x components
    residual: float  # the largest of a component, over the first eigenvalue
    passes: int  # over the data


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """(ids, m): blocks of valid vectors as 64-bit integers; the dimension."""
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # abs(null) is null and abs(NaN) is not below infinity: both fail
    src = src.filter(F.expr("v is not null and size(v) > 0 and forall(v, x -> abs(x) < double('infinity'))"))
    top = src.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    dim = top["d"] if top else 0
    schema = T.StructType([T.StructField("ids", T.ArrayType(src.schema["id"].dataType)), T.StructField("m", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK_BYTES // (8 * dim))
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                x = np.clip(np.floor(scale * c), -LIMIT, LIMIT).astype(np.int64) + offset
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "m"])

    rows = src.filter(F.size("v") == dim) if dim else src.limit(0)
    return stored(rows.mapInArrow(run, schema), "vectors"), dim


def _matrices(cells: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for cell in cells:
        yield np.frombuffer(cell.as_buffer(), np.int64).reshape(-1, dim)


def _moments(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums: each entry is summed as two halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            for x in _matrices(b.column(0), dim):
                n += len(x)
                low += (x & 0x3FFFFFF).sum(0)
                high += (x >> 26).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)),
                                              pa.array(low), pa.array(high)], names=["i", "n", "low", "high"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = (blocks.select("m").mapInArrow(run, "i int, n long, low long, high long")
            .groupBy("i").agg(F.sum("n").alias("n"), big("low"), big("high")).collect())
    sums = {r["i"]: int(r["low"]) + (int(r["high"]) << 26) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(dim)]


class _Centre:
    """Takes the mean away: the integer part exactly, then the fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[Decimal] | np.ndarray:
        """Sum over dimensions of (n x - S)²: exact, as 64-bit integers where
        they hold it and else as decimals."""
        x = x - self.whole
        most = int(np.abs(x).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] < 1 << 63:
            y = x * self.n - self.rest
            return (y * y).sum(1)
        if most < 1 << 62:  # three limbs of 21 bits, whose products add up exactly
            y = x * self.n - self.rest
            y = np.stack([y & 0x1FFFFF, (y >> 21) & 0x1FFFFF, y >> 42])
            dot = lambda a, b: (y[a] * y[b]).sum(1).astype(object)
            out = (dot(2, 2) << 84) + (dot(1, 2) << 64) + ((2 * dot(0, 2) + dot(1, 1)) << 42) + (dot(0, 1) << 22) + dot(0, 0)
        else:
            y = x.astype(object) * self.n - self.rest.astype(object)
            out = (y * y).sum(1)
        return [Decimal(int(v)) if v < 10 ** 38 else None for v in out]


def _summed(blocks: DataFrame, dim: int, rows: int, cols: int, product) -> np.ndarray:
    """Sum over all vectors of ``product(x)``, a rows x cols array. Tasks add
    up their own blocks; Spark adds the tasks' arrays, row by row."""
    names = [f"c{k}" for k in range(cols)]
    schema = "i int, " + ", ".join(f"{c} double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((rows, cols)), False
        for b in batches:
            for x in _matrices(b.column(0), dim):
                total += product(x)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *map(pa.array, total.T.copy())],
                                             names=["i", *names])

    found = blocks.select("m").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((rows, cols))
    for r in found:
        out[r["i"]] = r[1:]
    return out


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of q: falling values, vectors, V times them
    and the residuals' lengths."""
    h = q.T @ vq
    w, u = np.linalg.eigh((h + h.T) / 2)
    w, u = w[::-1], u[:, ::-1]
    q, vq = q @ u, vq @ u
    return w, q, vq, np.linalg.norm(vq - q * w, axis=0)


def _certified(w: np.ndarray, res: np.ndarray, wanted: int) -> bool:
    """Whether each wanted residual is down to rounding, or small against the
    distance of its eigenvalue to the others'."""
    ok = res[:wanted] <= ROUNDOFF * w[0] * np.sqrt(len(w))
    for k in np.flatnonzero(~ok):
        gap = np.abs(np.delete(w, k) - w[k]).min() if len(w) > 1 else w[0]
        ok[k] = res[k] <= ACCURACY * gap
    return bool(ok.all())


def _filter_step(apply, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of V times q: values in [low, high] are damped and
    those above grow. ``vq`` is V q; the scaling keeps the largest near 1."""
    centre, half = (high + low) / 2, (high - low) / 2
    s = s1 = half / (top - centre)
    before, now = q, (vq - centre * q) * (s1 / half)
    for _ in range(degree - 1):
        s2 = 1 / (2 / s1 - s)
        before, now = now, 2 * (s2 / half) * (apply(now) - centre * now) - s * s2 * before
        s = s2
    return now


def leading_spectrum(blocks: DataFrame, dim: int, components: int, degree: int = 8, seed: int = 11) -> Spectrum | None:
    """The ``components`` leading eigenvectors of the blocks' covariance."""
    n, sums = _moments(blocks, dim)
    if not n:
        return None
    centre = _Centre(n, sums)
    trace = float(_summed(blocks, dim, 1, 1, lambda x: np.square(centre(x)).sum()[None, None])[0, 0]) / n
    passes = 2
    if trace == 0:
        return Spectrum(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), 0.0, passes)

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ q)

        return _summed(blocks, dim, dim, q.shape[1], product) / n

    rng = np.random.default_rng(seed)
    wanted = min(components, dim)
    width = min(dim, max(WIDTH * wanted, wanted + FRESH + 2))
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    w, q, vq, res = _ritz(q, apply(q))
    low = np.inf
    for _ in range(MOST_CYCLES):
        if width == dim or _certified(w, res, wanted):
            break
        # the smallest Ritz value seen, less its residual, stands for the lower
        # end; what may lie below it only is damped less
        low = max(0.0, min(low, float((w - res).min())))
        high = float(w[-1 - FRESH])
        if high - low < 1e-3 * w[0]:
            low = max(0.0, high - 1e-3 * float(w[0]))
        y = _filter_step(apply, q, vq, low, high, float(w[0]), degree) if high > low else vq
        y[:, width - FRESH:] = rng.standard_normal((dim, FRESH)) * np.linalg.norm(y, axis=0).mean() / np.sqrt(dim)
        q = np.linalg.qr(y)[0]
        w, q, vq, res = _ritz(q, apply(q))
    # directions without variance cannot be whitened
    use = [k for k in range(wanted) if w[k] > dim * np.finfo(float).eps * 8 * w[0]]
    return Spectrum(n, sums, trace, w[use], q[:, use], float(res[use].max() / w[0]), passes)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
           scale: int = 1024, offset: int = 100_000, degree: int = 8) -> DataFrame:
    """One row per valid vector and leading component: the id, ``component``
    (from 1, by falling eigenvalue), ``n``, ``deviation`` (decimal, exact),
    ``whitened``, ``explained`` and ``identity_error``.

    Entries become integers x = floor(``scale`` * c) + ``offset``. The
    covariance V has divisor n, the number of valid vectors. ``whitened`` is
    the centred vector on a unit eigenvector of V over the root of its
    eigenvalue; ``explained`` the eigenvalue's share of the trace;
    ``identity_error`` the largest absolute entry of the covariance of
    ``whitened`` minus the identity, measured over all vectors.

    Left out are vectors that are null or empty, that hold null or non-finite
    entries, or whose length is not the most frequent one (ties: the longer).
    Entries beyond 2**52 in size count as 2**52. A null id is kept; repeated
    rows count each. Components without variance (a rank below
    ``components``, a single vector) have no rows. Equal eigenvalues share
    their eigenspace, in some basis that is the same for all rows. A deviation
    of more than 38 digits is null. An empty table gives an empty result.
    Other columns are not read.
    """
    blocks, dim = _blocks(vectors, id_col, vector_col, scale, offset)
    id_type = vectors.schema[id_col].dataType
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)),
              ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(c, t) for c, t in fields]])
    found = leading_spectrum(blocks, dim, components, degree) if dim else None
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    centre, k = _Centre(found.n, found.sums), len(found.values)
    to_white = found.vectors / np.sqrt(found.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ to_white
        return np.vstack([w.T @ w, w.sum(0)])

    m = _summed(blocks, dim, k + 1, k, moments) / found.n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    explained, n = found.values / found.trace, found.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in enumerate(_matrices(b.column(1), dim)):
                dev = centre.deviations(x)
                dev = pa.array(dev).cast(pa.decimal128(38, 0)) if isinstance(dev, np.ndarray) else pa.array(dev, pa.decimal128(38, 0))
                ids, each = b.column(0).slice(row, 1).flatten(), pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, n)), dev.take(each), pa.array((centre(x) @ to_white).reshape(-1)),
                     pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))], names=schema.names)

    return blocks.mapInArrow(run, schema).withColumnRenamed("id", id_col)
