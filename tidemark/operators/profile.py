"""Fit a statistical profile once, then score any table against it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions.hashing import on_vectors
from tidemark.functions.arrays import doubles
from tidemark.session import stored

RIDGE = 1e-6
TINY = 1e-12


@dataclass(frozen=True)
class Profile:
    """Mean, covariance (with ridge) and its inverse; ``d x d`` numbers, never rows of data."""

    mean: np.ndarray
    covariance: np.ndarray
    precision: np.ndarray
    count: int

    @property
    def eigenvalues(self) -> np.ndarray:
        return np.linalg.eigvalsh(self.covariance)

    @property
    def condition(self) -> float:
        values = self.eigenvalues
        return float(values.max() / (values.min() + TINY))


def _moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and count, aggregated by Spark ML as trees."""
    # a NULL vector, or one with a NULL in it, is no part of a profile
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = df.filter(whole).select(array_to_vector(doubles(vector)).alias("v"))
    if rows.isEmpty():
        raise ValueError("a profile needs at least one vector")
    metrics = Summarizer.metrics("mean", "std", "count").summary(F.col("v"))
    found = rows.select(metrics.alias("m")).select("m.*").head()
    count = int(found["count"])
    mean = found["mean"].toArray()
    if count == 1:
        return mean, np.zeros((len(mean), len(mean))), count
    std = found["std"].toArray()
    correlation = Correlation.corr(rows, "v").head()[0].toArray()
    # constant features have no correlation, and covariance 0
    correlation = np.where(np.isfinite(correlation), correlation, 0.0)
    return mean, correlation * np.outer(std, std) * (count - 1) / count, count


def fit_profile(df: DataFrame, vector: str, *, ridge: float = RIDGE) -> Profile:
    """Mean, population covariance plus ridge, and its inverse (pseudo-inverse if singular).

    The moments are distributed; only the ``d x d`` matrix reaches the driver.
    """
    mean, covariance, count = _moments(df, vector)
    covariance = covariance + ridge * np.eye(len(mean))
    try:
        precision = np.linalg.inv(covariance)
    except np.linalg.LinAlgError:
        precision = np.linalg.pinv(covariance)
    return Profile(mean, covariance, precision, count)


def score_profile(
    df: DataFrame, vector: str, profile: Profile, *, limit: float = scores.DISTANCE_LIMIT
) -> DataFrame:
    """Add ``mahalanobis_distance is_ood profile_condition``; no shuffle.  A NULL vector has no distance."""
    mean, precision = profile.mean, profile.precision

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        there = vectors.notna()
        found = pd.Series(np.full(len(vectors), None), dtype="object")
        if there.any():
            gaps = np.stack(vectors[there].to_numpy()).astype(float) - mean
            squared = np.einsum("ni,ni->n", gaps @ precision, gaps)
            distances = np.sqrt(np.clip(squared, 0.0, None))
            found[there.to_numpy()] = [None if np.isnan(x) else x for x in distances]
        return found

    rows = df.withColumn("mahalanobis_distance", distance(doubles(vector)))
    return rows.withColumns(
        {
            "is_ood": scores.is_ood(F.col("mahalanobis_distance"), limit),
            "profile_condition": F.lit(profile.condition),
        }
    )


def pair_profile(
    df: DataFrame, keys: Sequence[str], x: str, y: str, *, ridge: float = RIDGE
) -> DataFrame:
    """Profiles of two features for any number of keys, in one aggregation.

    ``n mean_x mean_y var_x var_y cov_xy eig_min eig_max profile_condition``.
    """
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        (F.var_pop(x) + ridge).alias("var_x"),
        (F.var_pop(y) + ridge).alias("var_y"),
        F.covar_pop(x, y).alias("cov_xy"),
    )
    half = (F.col("var_x") + F.col("var_y")) / 2
    gap = (F.col("var_x") - F.col("var_y")) / 2
    spread = F.sqrt(gap * gap + F.col("cov_xy") * F.col("cov_xy"))
    rows = rows.withColumns({"eig_min": half - spread, "eig_max": half + spread})
    return rows.withColumn("profile_condition", F.col("eig_max") / (F.col("eig_min") + TINY))


#: Triangles that are merged in one task.
FAN = 16


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole.flatten().to_numpy(zero_copy_only=False)
    wide = len(values) // max(len(whole), 1)
    if (np.asarray(whole.value_lengths()) != wide).any():
        raise ValueError("vectors must have one common length")
    return values.reshape(len(whole), wide)


def _triangle_rows(triangle: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(triangle) + 1) * triangle.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(triangle).ravel()))


def tall_triangle(df: DataFrame, vector: str) -> np.ndarray:
    """R of the QR factorisation of all vectors: one triangle per partition, merged as a tree.

    A task holds one batch and one ``d x d`` triangle, or ``FAN`` triangles; the last triangle comes to the driver.
    Vectors that are NULL or hold a NULL are left out.
    """
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = df.filter(whole).select(doubles(vector).alias("v"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            if batch.num_rows:
                block = _stacked(batch.column(0))
                if triangle is not None and triangle.shape[1] != block.shape[1]:
                    raise ValueError("vectors must have one common length")
                triangle = np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")
        if triangle is not None:
            node = pa.array(np.full(len(triangle), TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([node, _triangle_rows(triangle)], ["node", "v"])

    def merge(part: pa.Table) -> pa.Table:
        triangle = np.linalg.qr(_stacked(part["v"]), mode="r")
        return pa.table([pa.array(np.full(len(triangle), part["node"][0].as_py())), _triangle_rows(triangle)], names=["node", "v"])

    level = stored(rows.mapInArrow(reduce, "node long, v array<double>"), "triangles")
    last = level.agg(F.max("node")).head()[0]
    if last is None:
        raise ValueError("a profile needs at least one vector")
    nodes = last + 1
    while nodes > 1:
        level = level.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").applyInArrow(merge, "node long, v array<double>")
        nodes = -(-nodes // FAN)
    # at most d rows
    return _stacked(level.select("v").toArrow()["v"])


def latent_factors(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Rows of U.S of the whole table's SVD as column ``factors``, and the singular values.

    The singular values are those of the triangle of a tall QR, so small ones keep their digits, which the squares
    of a Gram matrix lose.  U.S is the table times the right singular vectors; the sign is fixed so that the largest
    entry of each is positive.
    """
    _, singular, basis = np.linalg.svd(tall_triangle(df, vector))
    full = np.zeros(len(basis))
    full[: len(singular)] = singular
    singular, basis = full[:k], basis[:k].T
    top = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    basis = basis * np.where(top < 0, -1.0, 1.0)

    @F.pandas_udf("array<double>")
    def rotate(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="object")
        return on_vectors(vectors, lambda block: block @ basis)

    return df.withColumn("factors", rotate(doubles(vector))), singular
