"""Whitening of embeddings by LOBPCG: the leading eigenvectors of the covariance from products with blocks of vectors.

Entries are put on a grid (floor(scale * c) + shift, whole numbers), so that sums over rows are exact and rows can be told
apart. The covariance is taken over the distinct grid vectors (the fit list). It is never formed: every step of the
locally optimal block preconditioned conjugate gradient method has an orthonormal basis Q of iterate, residuals and
previous directions, and one pass over the fit list sums C^T (C Q) over the centred rows C. A task sums its rows, then
FANIN tasks sum the tasks, and the driver adds their FANIN blocks and solves the small Rayleigh-Ritz problem. All products
are new in every step, so the residuals that end the iteration are those of the components returned. What the driver and
a task hold is a few blocks of dimension x 3 (components + guard) doubles, whatever the rows.

Steps end when every residual |V c - e c| is at most `tolerance` times the largest eigenvalue, or when rounding lets them
fall no further; residuals above `certified` times the largest eigenvalue raise an error instead of giving a result. A last
pass takes the covariance of the whitened fit list.

Defined results for odd input: rows whose vector is null, empty or holds a null or non-finite entry are dropped, and so are
rows whose length isn't that of most rows (of equally many, the shorter); a null vec_id is an id like others; repeated rows
give rows each, while the fit list has their vector once; directions without variance (an eigenvalue of at most 1e-12 of the
largest) can't be whitened and give no component, so a table of one distinct vector gives no rows; an empty table gives no
rows; other columns are not read. Entries or sums that leave 64-bit integers raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import Scratch

#: Tasks that add up what the tasks of a pass have summed.
FANIN = 16
ROWS = 2048
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What a fit gives. sums: exact sums of the grid vectors; components: a column each; residual: |V c - e c| / e1."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    identity_error: float
    steps: int

    def centred(self, grid: np.ndarray) -> np.ndarray:
        """x - S/n with one rounding: the difference is taken in whole numbers."""
        return _deviations(grid, self.n, self.sums) / self.n

    def apply(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ (self.components / np.sqrt(self.values))


def _deviations(grid: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: with an error where it doesn't fit into 64 bits."""
    if grid.size and n * float(np.abs(grid).max()) + float(np.abs(sums).max()) >= 2.0**63:
        raise OverflowError("n times an entry leaves 64-bit integers")
    return grid * n - sums


def grid_rows(vectors: DataFrame, scale: float = 64.0, shift: int = 1_000_000, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, dim, x): x is the grid vector as little-endian 64-bit integers, of every row that isn't dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            # offsets and values() rather than flatten(): lists of null rows may own values too
            at = np.asarray(lists.offsets, dtype=np.int64)
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            present = np.asarray(lists.is_valid())
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero(present & (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]]))
            raw = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
            if raw.size and np.abs(raw).max() + abs(shift) >= 2.0**62:
                raise OverflowError("an entry leaves 64-bit integers")
            grid = raw.astype("<i8") + shift
            out = [grid[at[i] : at[i + 1]].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(good)), pa.array(np.diff(at)[good], pa.int32()), pa.array(out, pa.binary())], names=[key, "dim", "x"])

    slim = vectors.select(F.col(key), F.col(vec).cast("array<double>").alias("v"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, dim int, x binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dim)


def _summed(fit: DataFrame, dim: int, width: int, of) -> np.ndarray:
    """The sum over the fit list of of(grid matrix), an array of `width` doubles: by task, then by FANIN tasks, then here."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total += of(_matrix(batch.column(0).slice(at, ROWS), dim)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    by_task = fit.select("x").mapInArrow(rows, "sums binary")
    parts = by_task.repartition(FANIN).mapInArrow(sums, "sums binary").collect()
    return np.sum([np.frombuffer(bytes(p.sums)) for p in parts] + [np.zeros(width)], axis=0)


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of all blocks, the first kept first; directions that earlier ones hold already are left out."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
        for _ in range(2):  # twice, so that what rounding leaves of the basis goes too
            block = block - basis @ (basis.T @ block)
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-10 * max(1.0, s[0] if len(s) else 0.0)]
        basis = np.hstack([basis, block])
    return basis


def fit(grid: DataFrame, scratch: Scratch, components: int = 16, guard: int = 8, tolerance: float = 1e-14, certified: float = 1e-10, max_steps: int = 500, seed: int = 11) -> Whitening | None:
    """Fits on the distinct vectors of grid, all of one length; None if there is no variance."""
    distinct = scratch.save(grid.select("dim", "x").distinct(), "fit")
    shape = distinct.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    if not shape.n:
        return None
    n, dim = shape.n, shape.dim
    sums = _exact_sums(distinct, dim)

    def centred(x: np.ndarray) -> np.ndarray:
        return _deviations(x, n, sums) / n

    def product(q: np.ndarray) -> np.ndarray:
        return _summed(distinct, dim, q.size, lambda x: (c := centred(x)).T @ (c @ q)).reshape(q.shape) / n

    trace = float(_summed(distinct, dim, 1, lambda x: np.array([np.square(centred(x)).sum()]))[0]) / n
    if trace <= 0:
        return None
    k = min(components, dim)
    width = min(components + guard, dim)
    q, m = _orthonormal([np.random.default_rng(seed).normal(size=(dim, width))]), width
    best, waited = np.inf, 0
    for step in range(1, max_steps + 1):
        vq = product(q)
        small = q.T @ vq
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1][:m], y[:, ::-1][:, :m]
        x, residual = q @ y, vq @ y - (q @ y) * e
        error = np.linalg.norm(residual, axis=0) / e[0]
        worst = error[:k].max()
        best, waited = (worst, 0) if worst < best / 2 else (best, waited + 1)
        # At the rounding of a sum over rows the residuals stop falling.
        if worst <= tolerance or (waited >= 6 and worst <= certified):
            break
        q = _orthonormal([x, residual, q[:, m:] @ y[m:]] if q.shape[1] > m else [x, residual])
    else:
        raise ArithmeticError(f"after {max_steps} steps the largest residual is {worst:.3g} of the largest eigenvalue")
    kept = min(k, int(np.sum(e > NO_VARIANCE * e[0])))
    e, x, error = e[:kept], x[:, :kept], error[:kept]
    x = x * np.where(x[np.abs(x).argmax(axis=0), range(kept)] < 0, -1.0, 1.0)
    white = x / np.sqrt(e)

    def products(rows: np.ndarray) -> np.ndarray:
        w = centred(rows) @ white
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(distinct, dim, kept * (kept + 1), products).reshape(kept + 1, kept) / n
    off = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(kept)).max())
    return Whitening(n, sums, trace, e, x, error, off, step)


def _exact_sums(fit_list: DataFrame, dim: int) -> np.ndarray:
    """Whole-number sums for each dimension: a task's rows in Python integers beyond 62 bits, and tasks as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), dim)
                small = x.size == 0 or float(np.abs(x).max()) * len(x) < 2.0**62
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.int64())], names=["i", "s"])

    found = fit_list.select("x").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dim, dtype=np.int64)
    for r in found:
        out[r.i] = r.s
    return out


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, guard: int = 8, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error, residual."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    grid = grid_rows(vectors, scale, shift, vec, key)
    kind = grid.schema[key].dataType.simpleString()
    result = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    lengths = grid.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    model = fit(grid.where(F.col("dim") == lengths[0].dim), scratch, components, guard) if lengths else None
    if model is None:
        return spark.createDataFrame([], result)
    dim, k = lengths[0].dim, len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), dim)
                m = len(x)
                off = _deviations(x, model.n, model.sums)
                small = m == 0 or float(np.abs(off).max()) ** 2 * dim < 2.0**62
                deviation = (off * off).sum(axis=1) if small else pa.array([sum(int(v) ** 2 for v in row) for row in off], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(np.repeat(np.asarray(deviation, dtype=np.int64), k)),
                        pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                        pa.array(np.tile(model.residuals, m)),
                    ],
                    names=[f.split()[0] for f in result.split(", ")],
                )

    return grid.where(F.col("dim") == dim).select(key, "x").mapInArrow(run, result)
