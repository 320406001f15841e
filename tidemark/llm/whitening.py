"""Whitening of embeddings: exact statistics, a compensated covariance, an eigen-solve, and projections of unit variance.

Entries become integers of a grid. The fit list is every distinct vector once, a written table. Tasks add up exact sums of
it; with these every vector is centred on integers next to the mean, and each task accumulates outer products in
double-double: vectors are split into limbs so short that a block's matrix products have no rounding error, and blocks are
added with error-free transformations, high and low parts apart. High and low parts of tasks are merged row by row in two
levels. What the driver gets is a row a dimension, so its size is the dimension squared, whatever the number of vectors. There
the fraction of the mean that centring left is taken off in exact integers, and the covariance is solved by reduction
to a tridiagonal matrix and divide and conquer (LAPACK's syevd, which numpy.linalg.eigh calls), then refined against the covariance's low part
in extended precision.

Defined results: rows whose vector is null, or has null or non-finite entries, or entries beyond 2**55, are dropped; so are
rows of a length other than the commonest of the fit list (the shortest of several); repeated rows are rows of their own with equal
results, null vec_ids included; a component without variance has a null whitened and explained 0, and identity_error looks at the others; deviation
is null beyond a long; an empty table, one without a vector left, or vectors without entries give an empty result. Columns beyond the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block and bits of a limb: 2 * (LIMB - 1) bits of a product and log2(BLOCK) of a sum stay within a double's 53.
BLOCK, LIMB = 512, 22
#: Larger entries are not on the grid: it has to be a long.
LARGEST = float(1 << 55)
#: Tasks whose partial sums a first merge puts together.
MERGED = 256


def grid(entries: Column) -> Column:
    return F.transform(entries, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(OFFSET))


def usable(entries: Column) -> Column:
    return entries.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles with x = sum of limb k times 2**(LIMB * k); each at most 2**(LIMB - 1) in size."""
    found = []
    while not found or x.any():
        low = ((x + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        found.append(low.astype(float))
        x = (x - low) >> LIMB
    return found


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum."""
    s, e = two_sum(high, more)
    e += low + more_low
    high = s + e
    return high, e - (high - s)


def outer_products(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """high + low and the sum of the rows' outer products."""
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at : at + BLOCK])
        for a, left in enumerate(parts):
            for b in range(a, len(parts)):
                product = left.T @ parts[b]  # exact
                high, low = add(high, low, (product if a == b else product + product.T) * float(1 << (LIMB * (a + b))))
    return high, low


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFF_FFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "high": high, "low": low})

    wide = "decimal(38,0)"
    parts = fit.mapInArrow(per_task, "dim int, n long, high long, low long").groupBy("dim")
    rows = parts.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).orderBy("dim").collect()
    return (int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [0] * dims)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("task")
    high, low = np.zeros(len(rows["high"].iloc[0])), np.zeros(len(rows["low"].iloc[0]))
    for h, e in zip(rows["high"], rows["low"], strict=True):
        high, low = add(high, low, np.asarray(h, float), np.asarray(e, float))
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "task": [rows["task"].iloc[0] // MERGED], "high": [high], "low": [low]})


def _covariance(fit: DataFrame, dims: int, n: int, centre: np.ndarray, rest: list[int]) -> list[list[Fraction]]:
    """Exact while the products' sums have at most 106 bits. rest: sums of the vectors less centre."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
        for batch in batches:
            high, low = outer_products(matrix(batch.column(0), dims) - centre, high, low)
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "task": np.full(dims, TaskContext.get().partitionId()), "high": pa.array(list(high), doubles), "low": pa.array(list(low), doubles)})

    kind = "dim int, task long, high array<double>, low array<double>"
    parts = fit.mapInArrow(per_task, kind)
    some = parts.groupBy("dim", F.floor(F.col("task") / MERGED)).applyInPandas(_merge, kind)
    rows = sorted(some.groupBy("dim").applyInPandas(_merge, kind).collect())
    return [[Fraction(n * (int(h) + int(e)) - rest[i] * rest[j], n * n) for j, (h, e) in enumerate(zip(r["high"], r["low"], strict=True))] for i, r in enumerate(rows)]


def eigen(covariance: list[list[Fraction]], rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors as columns, the largest entry of each positive.

    The double solution q of the rounded matrix is refined: with s = q'vq and r = 1 - q'q in extended precision, q's
    correction has the entries (s_ij + e_j r_ij) / (e_j - e_i), or r_ij / 2 where two eigenvalues can't be told apart.
    """
    rounded = np.array([[float(v) for v in row] for row in covariance])
    fine = rounded.astype(np.longdouble) + np.array([[float(v - Fraction(f)) for v, f in zip(row, found, strict=True)] for row, found in zip(covariance, rounded.tolist(), strict=True)], np.longdouble)
    fine = (fine + fine.T) / 2
    values, q = np.linalg.eigh(rounded)
    values, q = values.astype(np.longdouble), q.astype(np.longdouble)
    for _ in range(rounds):
        s, r = q.T @ fine @ q, np.eye(len(q), dtype=np.longdouble) - q.T @ q
        values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= 1e3 * np.finfo(float).eps * np.abs(values).max(initial=0)
        step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        if np.abs(step).max(initial=0) > 1e-3:  # eigenvalues too close to refine
            break
        q = q + q @ step
    order = np.argsort(-values, kind="stable")
    q = (q / np.sqrt((q * q).sum(0)))[:, order].astype(float)
    largest = np.take_along_axis(q, np.abs(q).argmax(0)[None, :], 0)
    return values[order].astype(float), q * np.where(largest < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """components: unit vectors as columns; values: their eigenvalues, 0 where there is no variance; mean is centre + rest / n."""

    dims: int
    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def project(self) -> Callable[[np.ndarray], np.ndarray]:
        """From grid vectors (rows) to whitened ones; row by row in one order of additions, so equal vectors have equal results."""
        alive = self.values > 0
        scaled = np.where(alive, self.components / np.sqrt(np.where(alive, self.values, 1.0)), np.nan)
        centre, fraction = self.centre, np.array([r / self.n for r in self.rest])
        return lambda x: np.einsum("ij,jk->ik", (x - centre).astype(float) - fraction, scaled)

    def deviation(self) -> Callable[[np.ndarray], pa.Array]:
        n, centre, rest = self.n, self.centre, self.rest

        def of(x: np.ndarray) -> pa.Array:
            x = x - centre
            most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + n
            if x.shape[1] * most * most < 1 << 63:
                return pa.array(((n * x - np.array(rest)) ** 2).sum(1), pa.int64())
            exact = (sum((n * v - s) ** 2 for v, s in zip(row, rest, strict=True)) for row in x.tolist())
            return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

        return of


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """fit: a written table of distinct grid vectors x, all of dims entries."""
    n, sums = _sums(fit, dims)
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    covariance = _covariance(fit, dims, n, centre, rest)
    values, q = eigen(covariance)
    trace = float(sum(covariance[i][i] for i in range(dims)))
    none = 4 * dims * float(np.finfo(np.longdouble).eps) * max(float(values[0]), 0.0)
    values = np.where(values > none, values, 0.0)[:components]
    return Whitening(dims, n, centre, rest, values, q[:, :components], values / trace if trace else values)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity. What the mean of whitened
    vectors differs from zero is only rounding, so taking its square off the sums of products is centring them."""
    alive, dims, project = int((model.values > 0).sum()), model.dims, model.project()
    if not alive:
        return 0.0

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((alive + 1, alive))
        for batch in batches:
            w = project(matrix(batch.column(0), dims))[:, :alive]
            total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    rows = fit.mapInArrow(per_task, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.array([r["value"] for r in sorted(rows)]).reshape(alive + 1, alive) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(alive)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable vector and component."""
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "whitening")
    kind = embeddings.schema[id_column].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("v")).filter(usable(F.col("v"))).select("vec_id", grid(F.col("v")).alias("x"))
    fit = scratch.save(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    if lengths is None or not lengths["dims"]:
        return spark.createDataFrame([], result)
    dims = lengths["dims"]
    fit = fit.filter(F.size("x") == dims)
    model = fit_whitening(fit, dims, components)
    error, project, deviation = identity_error(fit, model), model.project(), model.deviation()
    n, explained = model.n, model.explained

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            x = matrix(batch.column(1), dims)
            row = np.repeat(np.arange(len(x)), k)
            w = project(x).ravel()
            made = (batch.column(0).take(pa.array(row)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(row), n), deviation(x).take(pa.array(row)), pa.array(w, mask=np.isnan(w)), np.tile(explained, len(x)), np.full(len(row), error))
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in made], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == dims).mapInArrow(per_batch, result)
