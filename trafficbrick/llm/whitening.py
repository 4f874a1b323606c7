"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

The rows ``x`` of whole numbers are centred exactly (``x - S / n``). Starting from a
unit vector ``v`` the bidiagonalisation alternates ``u = X v - beta u'`` and
``v' = X^T u - alpha v``, which leaves ``X V = U B`` with orthonormal ``U``, ``V`` and an
upper bidiagonal ``B``. The singular value decomposition of the small ``B`` gives the
components and the deviations along them, without the covariance matrix ever being
formed, so small deviations keep their precision.

Distribution. ``V`` (as long as a vector) lives on the driver. The left vectors are as
long as the table and never exist as one: a left vector is ``X a`` for a short ``a``, so a
task forms its part of all of them from its block of rows. One scan per step gives the
part sums of ``X^T u``, of ``U^T u`` (the full reorthogonalisation against all earlier
left vectors) and of ``|u|^2``; two entries a dimension reach the driver, summed in Spark.
Nothing is kept between steps but these, so a lost executor only repeats its part of a
scan. Right vectors are reorthogonalised on the driver, twice. Where a step ends in an
invariant space (repeated or zero deviations), it goes on with a fresh direction, so all
dimensions are exhausted and multiple values are found as often as they occur.

Rows are packed once, in the order of the table, into binary blocks of about 256 KB and
written; all scans read that table. Nothing is shuffled but sums.
"""

from __future__ import annotations

from functools import partial
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .wordhash import splitmix

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
BLOCK_BYTES = 1 << 18
_EPS = np.finfo(np.float64).eps
_SUMS = "k int, s double"


class Centre(NamedTuple):
    """The mean ``(whole + rest / n)`` of ``n`` rows, exactly."""
    n: int
    whole: np.ndarray
    rest: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n


def _pack_batches(batches: Iterator[pa.RecordBatch], width: int, scale: int, shift: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> blocks: ids, rows of whole numbers as little-endian 64-bit."""
    step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    for b in batches:
        column = b.column(1)
        lens = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
        flat = np.asarray(column.flatten().cast(pa.float64()))
        at = np.cumsum(lens) - lens
        for i in range(0, b.num_rows, step):
            own = lens[i:i + step]
            x = np.zeros((len(own), width))
            x[np.arange(width)[None, :] < own[:, None]] = flat[at[i]:at[i] + own.sum()]
            x = np.floor(x * scale).astype("<i8") + shift
            ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), b.column(0).slice(i, len(own)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])


def _rows(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), dtype="<i8").reshape(-1, width)


def _moment_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums and sums of squares by dimension, exactly (as text)."""
    total, square = [0] * width, [0] * width
    for b in batches:
        for x in _rows(b.column(0), width):
            high, low = x >> 20, x & 0xFFFFF        # no product or sum of a block leaves 63 bits
            if len(x) and np.abs(high).max() < 1 << 20:
                part = [int(v) for v in x.sum(axis=0)]
                hh, hl, ll = ((p * q).sum(axis=0) for p, q in ((high, high), (high, low), (low, low)))
                squares = [(int(a) << 40) + (int(c) << 21) + int(d) for a, c, d in zip(hh, hl, ll)]
            else:
                part = [sum(map(int, x[:, k])) for k in range(width)]
                squares = [sum(int(v) ** 2 for v in x[:, k]) for k in range(width)]
            total = [p + q for p, q in zip(total, part)]
            square = [p + q for p, q in zip(square, squares)]
    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string()),
                                      pa.array(map(str, square), pa.string())], ["k", "s", "q"])


def _sums(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["k", "s"])


def _step_batches(batches: Iterator[pa.RecordBatch], centre: Centre, new: np.ndarray, old: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For ``u = X new`` and ``U = X old``: the task's part of ``X^T u``, ``U^T u`` and ``|u|^2``."""
    d, j = old.shape
    total = np.zeros(d + j + 1)
    for b in batches:
        for x in _rows(b.column(0), d):
            y = centre.apply(x)
            u = y @ new
            total[:d] += y.T @ u
            total[d:-1] += (y @ old).T @ u
            total[-1] += u @ u
    yield _sums(total)


def _spread_batches(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened rows; with their ``mean``, of the products of what is left."""
    k = axes.shape[1]
    total = np.zeros(k if mean is None else k * k)
    for b in batches:
        for x in _rows(b.column(0), len(axes)):
            z = centre.apply(x) @ axes
            total += z.sum(axis=0) if mean is None else ((z - mean).T @ (z - mean)).ravel()
    yield _sums(total)


def _deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """Per row the sum of ``(n * x - S) ** 2``, exactly (None beyond 63 bits)."""
    away = (x - centre.whole).astype(object) * centre.n - centre.rest if centre.n * float(np.abs(x - centre.whole).max(initial=0) + 1) > 1 << 62 \
        else (x - centre.whole) * centre.n - centre.rest
    top = int(np.abs(away).max(initial=0)) if away.dtype != object else max((abs(v) for v in away.ravel()), default=0)
    if away.dtype == object or top * top * x.shape[1] >= 1 << 63:
        sums = [sum(int(v) ** 2 for v in r) for r in away]
        return [s if s < 1 << 63 else None for s in sums]
    return (away * away).sum(axis=1).tolist()


def _whiten_batches(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(ids, x) -> id, component, deviation, whitened."""
    k = axes.shape[1]
    for b in batches:
        for ids, x in zip(b.column(0), _rows(b.column(1), len(axes))):
            z = centre.apply(x) @ axes
            row = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [ids.values.take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(_deviations(x, centre), pa.int64()).take(pa.array(row)), pa.array(z.ravel())],
                ["id", "component", "deviation", "whitened"])


class Bidiagonal(NamedTuple):
    """``X V = U B``: orthonormal columns ``v``, and ``B`` by its diagonal and the one above it."""
    v: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray

    def triplets(self) -> tuple[np.ndarray, np.ndarray]:
        """Singular values, falling, and the right singular vectors as columns."""
        b = np.diag(self.alpha) + np.diag(self.beta[:len(self.alpha) - 1], 1)
        _, sigma, right = np.linalg.svd(b)
        return sigma, self.v @ right.T


def _fresh(d: int, seed: int, v: list[np.ndarray]) -> np.ndarray:
    """A fixed direction orthogonal to ``v``."""
    x = splitmix(d, 101 + seed).astype(np.float64) / 2.0 ** 63 - 1
    return _orthogonal(x / np.linalg.norm(x), v)[0]


def _orthogonal(x: np.ndarray, v: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The unit direction of what of ``x`` is orthogonal to ``v``, and its length."""
    if v:
        basis = np.array(v)
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
    size = float(np.linalg.norm(x))
    return (x / size if size > 0 else x), size


def bidiagonalise(blocks: DataFrame, centre: Centre, norm: float) -> Bidiagonal:
    """Golub-Kahan-Lanczos bidiagonalisation of the centred rows of ``blocks``, one scan a
    step (two where rounding asks for it) and as many steps as dimensions; ``norm`` is the
    Frobenius norm of the rows."""
    d = len(centre.whole)
    tiny = 8 * d * _EPS * norm

    def scan(new: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        parts = blocks.select("x").mapInArrow(partial(_step_batches, centre=centre, new=new, old=old), _SUMS)
        got = np.zeros(d + old.shape[1] + 1)
        for r in parts.groupBy("k").agg(F.sum("s").alias("s")).collect():
            got[r.k] = r.s
        return got[:d], got[d:-1], float(got[-1])

    v, alpha, beta = [_fresh(d, 0, [])], [], []
    left, back = np.zeros((d, 0)), np.zeros((d, 0))         # U = X left, back = X^T U
    last, link = None, 0.0
    for j in range(d):
        new = v[j] if last is None else v[j] - link * last
        for _ in range(3):
            right, overlap, square = scan(new, left)
            new = new - left @ overlap
            right = right - back @ overlap
            size = float(np.sqrt(max(square - overlap @ overlap, 0.0)))
            if np.linalg.norm(overlap) <= 1e-6 * size or size <= tiny:
                break
        if size <= tiny:        # X v lies in the left space already: no new left vector
            alpha.append(0.0)
            last, step = None, 0.0
        else:
            alpha.append(size)
            last, right = new / size, right / size
            left, back = np.c_[left, last], np.c_[back, right]
            nxt, step = _orthogonal(right - size * v[j], v)
        if j + 1 < d:
            if step <= tiny:    # an invariant space: go on from a fresh direction
                nxt, step, last = _fresh(d, j + 1, v), 0.0, None
            v.append(nxt)
            beta.append(step)
            link = step
    return Bidiagonal(np.array(v).T, np.array(alpha), np.array(beta))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` for each row and
    component (from 1, by falling variance).

    An entry ``c`` counts as ``x = floor(scale * c) + shift``. ``deviation`` is the row's sum
    over dimensions of ``(n * x - S) ** 2``, exactly (null beyond 64 bits); ``whitened`` its
    centred projection on the component over the standard deviation along it;
    ``explained`` the component's share of the variance; ``identity_error`` the largest
    entry of the whitened rows' covariance minus the identity.

    Rows whose vector is null or holds null or non-finite entries, or entries that ``scale``
    takes beyond 62 bits, take no part. Shorter vectors count as padded with 0. Null and
    repeated ids are rows like others; of equal variances the components are any of that
    space. Directions without variance (up to rounding) are no components: a single row, or
    equal rows, give no rows, as does an empty table. Other columns are not looked at.
    """
    limit = float(1 << 62) / scale
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())
                   .where(F.coalesce(fine, F.lit(False))))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, deviation bigint, whitened double"
    spark = vectors.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    n, d = size.n, size.d
    centre, axes, share, error = None, np.zeros((d, 0)), np.zeros(0), 0.0
    if n > 1 and d:
        blocks = written(rows.mapInArrow(partial(_pack_batches, width=d, scale=scale, shift=shift), f"ids array<{kind}>, x binary"), "vector-blocks")
        parts = blocks.select("x").mapInArrow(partial(_moment_batches, width=d), "k int, s string, q string")
        dec = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        found = {r.k: (int(r.s), int(r.q)) for r in parts.groupBy("k").agg(dec("s"), dec("q")).collect()}
        sums = [found[k][0] for k in range(d)]
        centre = Centre(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64))
        square = sum(n * found[k][1] - found[k][0] ** 2 for k in range(d))       # n times the squared Frobenius norm
        if square:
            norm = float(np.sqrt(square / n))
            sigma, right = bidiagonalise(blocks, centre, norm).triplets()
            some = int((sigma[:components] > 8 * d * _EPS * norm).sum())
            axes = right[:, :some] * (np.sqrt(n) / sigma[:some])
            share = sigma[:some] ** 2 / (square / n)
            error = _identity_error(blocks, centre, axes)
    if not axes.shape[1]:
        none = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], none)
    done = blocks.mapInArrow(partial(_whiten_batches, centre=centre, axes=axes), out)
    return done.select(F.col("id").alias(id_col), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(F.lit(share.tolist()), F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(blocks: DataFrame, centre: Centre, axes: np.ndarray) -> float:
    k = axes.shape[1]

    def scan(mean: np.ndarray | None, size: int) -> np.ndarray:
        got = np.zeros(size)
        parts = blocks.select("x").mapInArrow(partial(_spread_batches, centre=centre, axes=axes, mean=mean), _SUMS)
        for r in parts.groupBy("k").agg(F.sum("s").alias("s")).collect():
            got[r.k] = r.s
        return got / centre.n

    mean = scan(None, k)
    return float(np.abs(scan(mean, k * k).reshape(k, k) - np.eye(k)).max())


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Every vector's eight whitened components, its exact deviation, and the fit's figures."""
    from ..session import read_table
    return whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
