"""Embedding whitening by the singular value decomposition of centred rows.

Entries become integers, floor(scale * c), so sums are exact. The fit list holds each distinct
vector once; its centred rows go to MLlib's RowMatrix as a DataFrame, so the decomposition runs
on the executors and the driver gets the right vectors only. With s the singular values of the
centred rows, the covariance with divisor n has eigenvalues s * s / n. The total variance
does not come from them but from exact deviations: the sum over the fit list of
sum((n * x - S) ^ 2) is n ^ 3 times the trace, in integers.

All vectors of the decomposition are asked for up to ``EXACT_DIMS`` dimensions: MLlib then takes the
dense solver, exact to double precision, on a matrix of dims * dims in the driver. Beyond that it
asks for ``components`` only, which MLlib finds by iteration without that matrix.

Defined results: vectors that are null, hold null or non-finite entries, or have fewer entries than
the longest one (which lack some) are dropped; null and repeated keys are rows like others; a component
of no variance (its singular value below ``RCOND`` of the largest) has no direction and gives
no row, so one distinct vector, or an empty table, gives an empty result; a deviation that does
not fit in a long is null; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, arrow_map

SCALE = 256
COMPONENTS = 4
EXACT_DIMS = 2048
RCOND = 1e-6
PART = 10**18  # deviations are summed in two parts, as decimals have 38 digits


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole vectors as integers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return own.where(F.col("v").isNotNull() & F.forall("v", finite)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


@dataclass(frozen=True)
class Fit:
    """n vectors of the fit list with sums S per dimension; unit vectors in columns and eigenvalues of the covariance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.means) @ self.vectors / np.sqrt(self.values)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """sum((n * x - S) ^ 2) of each row, exact.

    Products of 64-bit integers are right modulo 2 ^ 64, whatever overflows on the way, so where
    the result is surely below 2 ^ 62 it is right in whole; other rows take Python's integers.
    """
    modulo = np.array([s & ((1 << 64) - 1) for s in sums], np.uint64)
    about = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(axis=1)
    far = np.uint64(n) * x.view(np.uint64) - modulo
    out = (far * far).sum(axis=1, dtype=np.uint64).tolist()
    for k in np.flatnonzero(about >= 2.0**62):
        out[k] = sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), sums, strict=True))
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _column_sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    at = fit_list.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    rows = sorted(at.collect())
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The leading components of a list of distinct vectors x; None if nothing varies."""
    n, sums = _column_sums(fit_list)
    if n < 2:
        return None
    dims = len(sums)
    bare = Fit(n, tuple(sums), np.eye(dims), np.ones(dims))
    means = F.array(*map(F.lit, bare.means.tolist()))
    centred = fit_list.select(array_to_vector(F.zip_with(F.col("x"), means, lambda a, m: a - m)).alias("row"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, dims).computeSVD(dims if dims <= EXACT_DIMS else components, computeU=False, rCond=RCOND)
    s = np.array(found.s.toArray())[:components]
    v = found.V.toArray()[:, : len(s)]
    return Fit(n, tuple(sums), v / np.linalg.norm(v, axis=0), s * s / n)


def _measured(fit_list: DataFrame, fit: Fit) -> tuple[np.ndarray, float]:
    """The share of each component in the total variance, and the identity error of the whitened fit list."""
    k = len(fit.values)

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = _matrix(batch.column(0), len(fit.sums))
        w = fit.whitened(x)
        parts = divmod(sum(deviations(x, fit.n, fit.sums)), PART)  # of the batch, in its first row
        totals = {name: pa.array([Decimal(part), *[None] * (len(x) - 1)], pa.decimal128(38)) for name, part in zip(("high", "low"), parts, strict=True)}
        return {**totals, **{f"w{i}": pa.array(w[:, i]) for i in range(k)}}

    own = arrow_map(fit_list.select("x"), each, ", ".join(["high decimal(38,0)", "low decimal(38,0)", *[f"w{i} double" for i in range(k)]]))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = own.agg(F.sum("high").alias("high"), F.sum("low").alias("low"), *[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    trace = (int(row["high"]) * PART + int(row["low"])) / fit.n**3
    return fit.values / trace, max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = quantised(vectors, key, vector, scale)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where(F.size("x") == dims)
    fit_list = scratch.table(rows.select("x").distinct(), "fit-list") if dims else None
    fit = fitted(fit_list, components) if fit_list is not None else None
    if fit is None or not len(fit.values):
        scratch.drop(fit_list)
        return spark.createDataFrame([], OUT)
    explained, error = _measured(fit_list, fit)
    scratch.drop(fit_list)
    return arrow_map(rows, _projection(fit, explained, error), OUT)


def _projection(fit: Fit, explained: np.ndarray, error: float) -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
    k = len(fit.values)

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = _matrix(batch.column(1), len(fit.sums))
        rows = len(x)
        exact = [d if d < 1 << 63 else None for d in deviations(x, fit.n, fit.sums)]
        at = pa.array(np.repeat(np.arange(rows), k))
        return {
            "vec_id": batch.column(0).take(at),
            "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            "n": pa.array(np.full(rows * k, fit.n, np.int64)),
            "deviation": pa.array(exact, pa.int64()).take(at),
            "whitened": pa.array(fit.whitened(x).ravel()),
            "explained": pa.array(np.tile(explained, rows)),
            "identity_error": pa.array(np.full(rows * k, error)),
        }

    return each


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every vector of the table on the four leading components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
