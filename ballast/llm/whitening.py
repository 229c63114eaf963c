"""Embedding whitening: rows are projected on the leading components of their covariance, at unit variance.

Vectors are put on a grid of integers, the covariance is that of the distinct ones, and its leading
eigenpairs come from ``spectrum``. Sums of integers are exact; only the matrix of one covariance, whose
size follows from the dimension, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.columns import append_columns, fresh, stored
from ballast.llm.spectrum import leading_eigenpairs

GRID_LIMIT = float(1 << 40)  # grid values beyond it are refused


@dataclass(frozen=True)
class Whitening:
    """What ``fit_whitening`` learned; ``rank`` components, fewer than asked where variance is lacking."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: list[list[float]]  # one unit vector a component
    explained: list[float]
    identity_error: float

    @property
    def rank(self) -> int:
        return len(self.values)


def usable(vector: Column) -> Column:
    """Whether a vector is not NULL or empty and all its entries are finite numbers."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def on_grid(vector: Column, steps: int) -> Column:
    """``floor(steps * entry)`` as ``array<bigint>``."""

    def place(entry: Column) -> Column:
        scaled = F.floor(entry.cast("double") * float(steps))
        too_far = F.abs(entry.cast("double") * float(steps)) > GRID_LIMIT
        return F.when(too_far, F.raise_error(F.lit("an entry lies beyond the grid")).cast("bigint")).otherwise(scaled)

    return F.transform(vector, place)


def grid_rows(df: DataFrame, vector: str, out: str, steps: int) -> DataFrame:
    """The rows with a usable vector and their grid vector ``out``."""
    column = F.col(f"`{vector}`")
    return df.where(usable(column)).withColumn(out, on_grid(column, steps))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def totals(df: DataFrame, sum_of: Callable[[np.ndarray], np.ndarray], dtype: str, exact: str) -> list:
    """``sum_of`` (a flat array) added up over all batches of vectors ``x``: by task, then by entry."""
    kind = pa.int64() if dtype == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sum_of(matrix_of(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, kind)], names=["entry", "value"])

    parts = df.select("x").mapInArrow(run, f"entry int, value {dtype}")
    rows = parts.groupBy("entry").agg(F.sum(F.col("value").cast(exact)).alias("value")).collect()  # one row an entry
    return [r["value"] for r in sorted(rows, key=lambda r: r["entry"])]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 4, steps: int = 256) -> Whitening:
    """Learn the components from every distinct grid vector, each counted once.

    Unusable vectors (see ``usable``) are left out. Vectors of different lengths raise ValueError. Components
    whose variance is nothing but rounding are not reported, so that one vector, copies of one vector or an
    empty table give rank 0.
    """
    fit = stored(grid_rows(df.select(vector), vector, "x", steps).select("x").distinct(), "vectors")
    found = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    n, size = found["n"], found["least"]
    if n == 0:
        return Whitening(0, [], [], [], [], 0.0)
    if found["least"] != found["most"]:
        raise ValueError(f"vectors have {found['least']} to {found['most']} entries")
    sums = [int(v) for v in totals(fit, lambda x: x.sum(axis=0), "bigint", "decimal(38,0)")]
    centre = np.array([s / n for s in sums])
    upper = np.triu_indices(size)

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - centre
        return (centred.T @ centred)[upper]

    covariance = np.zeros((size, size))
    covariance[upper] = np.array(totals(fit, products, "double", "double")) / n
    covariance = covariance + np.triu(covariance, 1).T
    trace = float(np.trace(covariance))
    values, vectors = leading_eigenpairs(covariance, min(components, size))
    real = int((values > 64 * size * np.finfo(float).eps * trace).sum()) if trace > 0 else 0
    model = Whitening(
        n, sums, values[:real].tolist(), vectors[:, :real].T.tolist(), (values[:real] / trace).tolist() if real else [], 0.0
    )
    if not real:
        return model
    white = add_whitened(fit, model, "x", "w", "d").select(*[F.col("w")[i].alias(f"w{i}") for i in range(real)])
    pairs = [(i, j) for i in range(real) for j in range(i, real)]
    row = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return Whitening(model.n, model.sums, model.values, model.vectors, model.explained, float(error))


def add_whitened(df: DataFrame, model: Whitening, x: str, whitened: str, deviation: str) -> DataFrame:
    """``df`` with the projections ``whitened`` and the exact ``deviation`` of its grid vectors ``x``."""
    n, sums = model.n, np.array(model.sums, object)
    centre = np.array([s / n for s in model.sums]) if n else np.zeros(0)
    basis = np.array(model.vectors).T / np.sqrt(np.array(model.values)) if model.rank else np.zeros((len(sums), 0))
    small = np.array([s for s in model.sums], np.int64) if all(abs(s) < 1 << 62 for s in model.sums) else None

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        vectors = matrix_of(batch.column(batch.schema.names.index(x)))
        reach = float(n) * float(np.abs(vectors).max(initial=0)) + max((abs(float(s)) for s in model.sums), default=0.0)
        if small is not None and reach**2 * vectors.shape[1] < 2.0**62:
            spread = ((n * vectors - small) ** 2).sum(axis=1).tolist()
        else:  # Python integers, exact at any size
            spread = ((n * vectors.astype(object) - sums) ** 2).sum(axis=1).tolist()
        white = (vectors - centre) @ basis
        offsets = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
        flat = pa.array(white.ravel(), pa.float64())
        return [pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(spread, pa.int64())]

    fields = [T.StructField(whitened, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())]
    return append_columns(df, make, fields)


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", steps: int = 256) -> DataFrame:
    """The rows with a usable vector, ``whitened`` (one number a component) and ``deviation``, the exact sum
    of squares of ``n * x - sums``; taken names get a suffix. A deviation beyond 64 bits raises."""
    x, white, spread = fresh(df, "_grid"), fresh(df, "whitened"), fresh(df, "deviation")
    rows = grid_rows(df, vector, x, steps)
    return add_whitened(rows, model, x, white, spread).drop(x)
