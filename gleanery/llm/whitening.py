"""Whitening of vectors by the leading eigenvectors of their covariance, found by LOBPCG.

The covariance V is never built: each step multiplies it with a block of at most 3 * (COMPONENTS + GUARD) columns, in one pass over the centred
rows whose sums are added up by shuffle, so that the driver gets dimensions x columns numbers at any number of rows.  A step is a
Rayleigh-Ritz problem on the iterate, its residuals and the directions before.  The basis is made orthonormal first (columns that
add nothing are dropped), and its product with V comes from a pass of its own: no product is carried on by recurrence, so that
rounding does not add up.  The iteration ends when every asked residual |V u - e u| is at most TOLERANCE times the largest
eigenvalue, as measured by the product itself; a block that does not get there in STEPS steps raises.

Entries become integers, x = floor(64 * c) + 1000000, so sums are exact and rows are centred as n*x - S, without rounding; sums of
squares over 2^63 raise instead of wrapping round.  Components whose eigenvalue is under TOLERANCE times the largest have no variance to
divide by and are left out; vectors that are all equal have none, and give no rows.

Vectors that are null, or hold null or non-finite entries, or are of another length than most (ties: the shorter; empty ones
never count) take no part.  Rows that repeat count as often as they stand; null ids pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

COMPONENTS, GUARD, TOLERANCE, STEPS, SCALE, SHIFT = 32, 8, 1e-13, 500, 64, 1_000_000


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def participants(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    c = F.col("embedding")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & (F.size(c) > 0)
    rows = vectors.select("vec_id", c).where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size(c).alias("n")).count().orderBy(F.desc("count"), "n").first()
    x = F.transform(c, lambda v: (F.floor(v.cast("double") * F.lit(float(scale))) + F.lit(shift)).cast("bigint"))
    return rows.where(F.size(c) == (common["n"] if common else 0)).select("vec_id", x.alias("x"))


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sum of each dimension."""
    found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), np.array([r["s"] for r in found], np.int64)


def _summed(rows: DataFrame, part, cells: int) -> np.ndarray:
    """Sum over all tasks of what part(matrix of x) gives for batches (a vector of `cells` numbers)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += part(_rows(batch.column(0), len(batch.column(0)[0])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    out = np.zeros(cells)
    added = rows.select("x").mapInArrow(tasks, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out[added["cell"].to_numpy()] = added["value"].to_numpy()
    return out


def product(rows: DataFrame, n: int, s: np.ndarray, block: np.ndarray) -> np.ndarray:
    """V times block, in one pass over the centred rows."""
    d, m = block.shape

    def part(x: np.ndarray) -> np.ndarray:
        z = (n * x - s) / n  # centred by whole numbers before the division
        return (z.T @ (z @ block)).ravel()

    return _summed(rows, part, d * m).reshape(d, m) / n


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Columns that span the block outside `against`, orthonormal to rounding; those that add nothing are dropped."""
    for _ in range(2):
        if against is not None and against.shape[1]:
            block = block - against @ (against.T @ block)
        if not block.shape[1]:
            return block
        lengths = np.linalg.norm(block, axis=0)
        block = block[:, lengths > 0] / lengths[lengths > 0]
        u, w, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, w > 1e-10 * max(w.max(initial=0), 1e-300)]
    return block


def lobpcg(times, d: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residual norms) of the k largest, by falling value; times(block) is V times a block of columns."""
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    vx = times(x)
    before = np.zeros((d, 0))
    for _ in range(steps):
        e, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        order = np.argsort(-e, kind="stable")
        e, x, vx = e[order], x @ turn[:, order], vx @ turn[:, order]
        residual = vx - x * e
        norms = np.linalg.norm(residual, axis=0)
        if (norms[:k] <= tolerance * max(abs(e[0]), 1e-300)).all():
            return e[:k], x[:, :k], norms[:k]
        open_ = norms > tolerance / 4 * max(abs(e[0]), 1e-300)  # columns that have come to rest need no new direction
        more = _orthonormal(np.hstack([residual[:, open_], before]), x)
        vm = times(more)
        basis, vb = np.hstack([x, more]), np.hstack([vx, vm])
        gram = basis.T @ vb
        w, c = np.linalg.eigh((gram + gram.T) / 2)
        c = c[:, np.argsort(-w, kind="stable")[:m]]
        before = more @ c[x.shape[1] :]
        x = np.linalg.qr(basis @ c)[0]
        vx = times(x)
    raise ArithmeticError(f"no residual of {tolerance} times the largest eigenvalue within {steps} steps; reached {norms[:k].max() / max(abs(e[0]), 1e-300):.2e}")


def whiten(vectors: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue and residual for each row that takes part and each component."""
    spark = vectors.sparkSession
    rows = written(spark, participants(vectors), "whitening")
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, eigenvalue double, residual double"
    n, s = sums(rows)
    d = len(s)
    trace = float(_summed(rows, lambda x: (((n * x - s) / n) ** 2).sum(0), d).sum() / n) if n else 0.0
    if not trace:
        return spark.createDataFrame([], schema)
    e, u, norms = lobpcg(lambda block: product(rows, n, s, block), d, min(components, d), tolerance=tolerance)
    kept = e > max(tolerance, d * np.finfo(float).eps) * e[0]
    e, u, norms = e[kept], u[:, kept], norms[kept]
    k = len(e)
    down = u / np.sqrt(e)

    def square(x: np.ndarray) -> np.ndarray:
        w = ((n * x - s) / n) @ down
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    whole = _summed(rows, square, k * k + k) / n
    error = float(np.abs(whole[: k * k].reshape(k, k) - np.outer(whole[k * k :], whole[k * k :]) - np.eye(k)).max())
    explained = e / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            wide = n * _rows(batch.column(1), d) - s
            if float(np.abs(wide).max()) ** 2 * d >= 2.0**63:
                raise OverflowError("deviation is over 2^63")
            which = pa.array(np.repeat(np.arange(len(wide)), k))
            columns = [batch.column(0).take(which), np.tile(np.arange(1, k + 1, dtype=np.int32), len(wide)), np.full(len(wide) * k, n), np.repeat((wide * wide).sum(1), k), ((wide / n) @ down).ravel()]
            columns += [np.tile(v, len(wide)) for v in (explained, np.full(k, error), e, norms)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "residual"])

    return rows.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector that takes part on the 32 leading components; who takes no part is told above."""
    return whiten(table(spark, sf_dir, "embeddings"))
