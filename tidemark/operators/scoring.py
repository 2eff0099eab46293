"""Order-dependent anomaly scoring: each row against the rows of its key so far."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tidemark.functions import scores
from tidemark.functions.arrays import softmax_entropies, wide_softmax_entropies
from tidemark.plans.joins import join_per_key
from tidemark.plans.running import (
    group_moments,
    merge_moments,
    moment_names,
    pair_names,
    running_moments,
    running_sums,
    sliding_rows,
)
from tidemark.plans.segments import DEFAULT_SPLIT, Split
from tidemark.plans.wide import running_vectors

RIDGE = 1e-6
#: Order column of ``seed_baseline``: 0 for history, 1 for the batch.
BEFORE = "batch_place"


def _z_columns(value: Column, n: Column, mean: Column, m2: Column, limit: float) -> dict[str, Column]:
    std = F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
    z = F.when((n < 2) | (std == 0), 0.0).otherwise((value - mean) / std)
    return {
        "z_score": z,
        "mean": mean,
        "std": std,
        "is_z_anomalous": scores.is_z_anomalous(z, limit),
    }


def running_zscore(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    *,
    limit: float = scores.Z_LIMIT,
    include_self: bool = True,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``z_score mean std is_z_anomalous`` against all values of the key so far.

    The sample standard deviation is used; fewer than two values or no spread
    give a score of 0.  ``include_self=False`` scores against earlier rows only.
    """
    rows = running_moments(
        df, keys, order_by, [value], include_self=include_self, split=split
    )
    mean, m2 = F.col(f"_mean_{value}"), F.col(f"_m2_{value}_{value}")
    found = _z_columns(F.col(value), F.col("_n"), mean, m2, limit)
    return rows.select(*df.columns, *[c.alias(name) for name, c in found.items()])


def sliding_zscore(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    size: int,
    *,
    limit: float = scores.Z_LIMIT,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """The same scores over the last ``size`` values only."""
    moments = {"_n": F.count(value), "_mean": F.avg(value), "_var": F.var_pop(value)}
    rows = sliding_rows(df, keys, order_by, size, moments, split=split)
    found = _z_columns(F.col(value), F.col("_n"), F.col("_mean"), F.col("_var") * F.col("_n"), limit)
    return rows.select(*df.columns, *[c.alias(name) for name, c in found.items()])


def quadratic_form(
    gaps: Sequence[Column], covariance: dict[tuple[int, int], Column], ridge: float
) -> Column:
    """``g' (C + ridge I)^-1 g`` for one or two dimensions in closed form, else by numpy."""
    d = len(gaps)
    if d == 1:
        return gaps[0] * gaps[0] / (covariance[0, 0] + ridge)
    if d == 2:
        a, b, c = covariance[0, 0] + ridge, covariance[1, 1] + ridge, covariance[0, 1]
        x, y = gaps
        return (b * x * x - 2.0 * c * x * y + a * y * y) / (a * b - c * c)
    packed = F.array(*[covariance[i, j] for i in range(d) for j in range(i, d)])
    return _batch_quadratic_form(d, ridge)(F.array(*gaps), packed)


def _batch_quadratic_form(d: int, ridge: float):
    upper = np.triu_indices(d)

    @F.pandas_udf("double")
    def solve(gaps: pd.Series, packed: pd.Series) -> pd.Series:
        if not len(gaps):
            return pd.Series([], dtype="float64")
        g = np.stack(gaps.to_numpy()).astype(float)
        matrices = np.zeros((len(g), d, d))
        matrices[:, upper[0], upper[1]] = np.stack(packed.to_numpy()).astype(float)
        matrices[:, upper[1], upper[0]] = matrices[:, upper[0], upper[1]]
        matrices += ridge * np.eye(d)
        try:
            solved = np.linalg.solve(matrices, g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            solved = np.einsum("nij,nj->ni", np.linalg.pinv(matrices), g)
        return pd.Series(np.einsum("ni,ni->n", g, solved))

    return solve


def _distance(features: Sequence[str], n: Column, ridge: float, min_samples: int) -> Column:
    gaps = [F.col(c) - F.col(f"_mean_{c}") for c in features]
    place = {c: i for i, c in enumerate(features)}
    safe_n = F.greatest(n, F.lit(1.0))
    covariance = {
        (place[a], place[b]): F.col(f"_m2_{a}_{b}") / safe_n for a, b in pair_names(features)
    }
    squared = quadratic_form(gaps, covariance, ridge)
    found = F.sqrt(F.greatest(squared, F.lit(0.0)))
    return F.when(n >= max(min_samples, 1), found).otherwise(F.lit(float("inf")))


def running_mahalanobis(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    features: Sequence[str],
    *,
    limit: float = scores.DISTANCE_LIMIT,
    ridge: float = RIDGE,
    min_samples: int = 1,
    include_self: bool = True,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``mahalanobis_distance is_ood`` against the rows of the key so far.

    Population covariance plus ``ridge`` on the diagonal.  A row that is part of
    its own profile is never further away than ``sqrt(n - 1)``, and with at
    least as many features as rows it is exactly that far: use few features, or
    fit a profile first and score against it.  More than two features go through
    ``running_mahalanobis_vectors`` as one array.
    """
    if len(features) > 2 and ridge > 0:
        wide = df.withColumn("_vector", F.array(*[F.col(c).cast("double") for c in features]))
        return running_mahalanobis_vectors(
            wide, keys, order_by, "_vector", limit=limit, ridge=ridge, min_samples=min_samples, include_self=include_self,
            split=split,
        ).drop("_vector")
    rows = running_moments(
        df, keys, order_by, features, include_self=include_self, split=split
    ).withColumn("mahalanobis_distance", _distance(features, F.col("_n"), ridge, min_samples))
    return rows.select(
        *df.columns,
        "mahalanobis_distance",
        scores.is_ood(F.col("mahalanobis_distance"), limit).alias("is_ood"),
    )


def prediction_stability(
    df: DataFrame, score_column: str, *, limit: float = scores.ENTROPY_LIMIT, base: float = 2.0, wide: bool = False
) -> DataFrame:
    """Add ``entropy is_stable renyi_entropy`` of the softmax of a score array.

    ``wide`` says that the arrays have many entries.  The column may also hold the ``softmax_entropies`` themselves.
    """
    kind = df.schema[score_column].dataType
    if isinstance(kind, StructType):
        found = F.col(score_column)
    else:
        many = wide and kind == ArrayType(DoubleType(), kind.containsNull)
        found = wide_softmax_entropies(score_column, base) if many else softmax_entropies(score_column, base)
    rows = df.withColumn("_e", found)
    found = {"entropy": F.col("_e.shannon"), "renyi_entropy": F.col("_e.renyi_2")}
    found["is_stable"] = scores.is_stable(found["entropy"], limit)
    return rows.withColumns(found).drop("_e")


def cold_start(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    id_column: str,
    *,
    needed: int = scores.COLD_START_RECORDS,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``record_count``, the distinct ids of the key before each row, and ``is_cold_start``.

    The first place of each id is found by aggregation and joins the stream of
    rows as a marker, so the running count needs no distinct window and no join.
    """
    columns = df.columns
    place = F.struct(*[F.col(c) for c in order_by])
    grouping = list(dict.fromkeys([*keys, id_column]))
    first = df.groupBy(*grouping).agg(F.min(place).alias("_first"))
    markers = first.select(
        *[c for c in grouping if c not in order_by], *[F.col(f"_first.{c}").alias(c) for c in order_by]
    ).withColumn("_mark", F.lit(1))
    rows = df.withColumn("_mark", F.lit(0)).unionByName(markers, allowMissingColumns=True)
    # a marker sorts behind its own row: the row does not count itself
    rows = running_sums(
        rows, keys, [*order_by, "_mark"], {"record_count": F.col("_mark")}, split=split
    )
    rows = rows.filter(F.col("_mark") == 0)
    count = F.col("record_count").cast("bigint")
    return rows.select(*columns, count.alias("record_count"), (count < needed).alias("is_cold_start"))


def judge(rows: DataFrame) -> DataFrame:
    """Add ``is_anomalous confidence`` from the metrics; cold rows are never anomalous."""
    votes = scores.anomaly_vote(F.col("is_ood"), ~F.col("is_stable"), F.col("is_z_anomalous"))
    sure = scores.confidence(F.col("mahalanobis_distance"), F.col("entropy"), F.col("z_score"))
    cold = F.col("is_cold_start")
    return rows.withColumns(
        {
            "is_anomalous": ~cold & votes,
            "confidence": F.when(cold, scores.COLD_CONFIDENCE).otherwise(sure),
        }
    )


def _with_flat(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the mean of the features, on which the z-score works."""
    mean = sum((F.col(c) for c in features[1:]), F.col(features[0])) / len(features)
    return df.withColumn("_flat", mean)


def _review_columns(features: Sequence[str]) -> tuple[list[str], list[tuple[str, str]]]:
    return [*features, "_flat"], [*pair_names(features), ("_flat", "_flat")]


def review_moments(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """What ``review`` has to know about rows that came before: one row per key."""
    return group_moments(_with_flat(df, features), keys, *_review_columns(features))


def merge_review_moments(parts: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Merge a few ``review_moments`` tables, told apart by column ``part``, in that order.

    A key has one row per part, so its array is as short as the list of parts.
    """
    columns, pairs = _review_columns(features)
    names = moment_names(columns, pairs)
    ordered = F.array_sort(F.collect_list(F.struct("part", *names)))
    one = parts.groupBy(*keys).agg(ordered.alias("_parts"))
    none = F.struct(*[F.lit(None).cast("double").alias(n) for n in names])

    def add(acc: Column, part: Column) -> Column:
        merged = merge_moments(
            {n: acc[n] for n in names}, {n: part[n] for n in names}, columns, pairs
        )
        return F.struct(*[merged[n].alias(n) for n in names])

    rows = one.select(*keys, F.aggregate("_parts", none, add).alias("_total"))
    return rows.select(*keys, "_total.*")


def review(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    features: Sequence[str],
    score_column: str,
    *,
    id_column: str | None = None,
    distance_limit: float = scores.DISTANCE_LIMIT,
    entropy_limit: float = scores.ENTROPY_LIMIT,
    z_limit: float = scores.Z_LIMIT,
    ridge: float = RIDGE,
    needed: int = scores.COLD_START_RECORDS,
    prior: DataFrame | None = None,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """The whole verdict per row: distance, entropy, z-score, vote and confidence.

    Distance and z-score (of the mean feature) come from one window, hence one
    shuffle.  ``id_column`` names the record id where ids can repeat; without it
    every row counts as a new record.  ``prior`` holds what ``review_moments``
    gave for all earlier rows of the keys; it does not hold their ids, so it cannot go with
    ``id_column``.  A row with a NULL feature has a NULL verdict and counts for no other row.
    """
    if id_column is not None and prior is not None:
        raise ValueError("prior moments hold no record ids: leave out id_column")
    columns, pairs = _review_columns(features)
    rows = running_moments(
        _with_flat(df, features), keys, order_by, columns, pairs=pairs, split=split
    )
    if prior is not None:
        names = moment_names(columns, pairs)
        known = prior.select(*keys, *[F.col(n).alias(f"_prior{n}") for n in names])
        rows = join_per_key(rows, known, keys, order_by, split=split)
        merged = merge_moments(
            {n: F.col(f"_prior{n}") for n in names}, {n: F.col(n) for n in names}, columns, pairs
        )
        rows = rows.select(*df.columns, "_flat", *[merged[n].alias(n) for n in names])
    n = F.col("_n")
    z = _z_columns(F.col("_flat"), n, F.col("_mean__flat"), F.col("_m2__flat__flat"), z_limit)
    rows = rows.withColumns({"mahalanobis_distance": _distance(features, n, ridge, 1), **z})
    rows = rows.withColumn("is_ood", scores.is_ood(F.col("mahalanobis_distance"), distance_limit))
    return _verdicts(rows, df.columns, keys, order_by, score_column, id_column, entropy_limit, needed, split)


def _verdicts(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    order_by: Sequence[str],
    score_column: str,
    id_column: str | None,
    entropy_limit: float,
    needed: int,
    split: Split,
    wide: bool = False,
) -> DataFrame:
    """The review's columns from distance, z-score, ``_n`` and ``_flat``."""
    n = F.col("_n")
    own = F.when(F.col("_flat").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("record_count", (n - own).cast("bigint"))
    rows = rows.withColumn("is_cold_start", F.col("record_count") < needed)
    metrics = ["mahalanobis_distance", "z_score", "mean", "std", "is_z_anomalous", "is_ood"]
    if id_column is not None:
        rows = rows.select(*columns, *metrics)
        rows = cold_start(rows, keys, order_by, id_column, needed=needed, split=split)
    return finish_review(rows, columns, score_column, entropy_limit, wide)


def finish_review(
    rows: DataFrame, columns: Sequence[str], score_column: str, entropy_limit: float, wide: bool = False
) -> DataFrame:
    """Add entropies, vote and confidence to the other metrics, and put the columns of a review in order."""
    rows = prediction_stability(rows, score_column, limit=entropy_limit, wide=wide)
    rows = judge(rows)
    return rows.select(
        *columns,
        "mahalanobis_distance",
        "is_ood",
        "entropy",
        "renyi_entropy",
        "z_score",
        "mean",
        "std",
        "is_anomalous",
        "confidence",
        "is_cold_start",
        "record_count",
    )


def vector_metrics(rows: DataFrame, distance_limit: float, z_limit: float) -> DataFrame:
    """Distance and z-score columns from those of ``running_vectors``."""
    z = _z_columns(F.col("_flat"), F.col("_n"), F.col("_flat_mean"), F.col("_flat_m2"), z_limit)
    rows = rows.withColumns({"mahalanobis_distance": _wide_distance(1), **z})
    return rows.withColumn("is_ood", scores.is_ood(F.col("mahalanobis_distance"), distance_limit))


def running_mahalanobis_vectors(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    vector: str,
    *,
    limit: float = scores.DISTANCE_LIMIT,
    ridge: float = RIDGE,
    min_samples: int = 1,
    include_self: bool = True,
    prior: DataFrame | None = None,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """``running_mahalanobis`` for an array column of any length, in order and with one matrix per task.

    ``prior`` holds ``vector_moments`` of stored vectors, which come before all rows.
    """
    rows = running_vectors(
        df, keys, order_by, vector, ridge=ridge, include_self=include_self, prior=prior, split=split
    )
    found = _wide_distance(min_samples)
    return rows.select(*df.columns, found.alias("mahalanobis_distance"), scores.is_ood(found, limit).alias("is_ood"))


def _wide_distance(min_samples: int) -> Column:
    early = F.col("_flat").isNotNull() & (F.col("_n") < max(min_samples, 1))
    return F.when(early, F.lit(float("inf"))).otherwise(F.col("_distance"))


def review_vectors(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    vector: str,
    score_column: str,
    *,
    id_column: str | None = None,
    distance_limit: float = scores.DISTANCE_LIMIT,
    entropy_limit: float = scores.ENTROPY_LIMIT,
    z_limit: float = scores.Z_LIMIT,
    ridge: float = RIDGE,
    needed: int = scores.COLD_START_RECORDS,
    prior: DataFrame | None = None,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """``review`` for an array column of any length: the z-score is of the mean of its entries.

    ``prior`` holds ``vector_moments`` of stored vectors (``load_vectors``) and no ids, so it cannot go with
    ``id_column``.  A vector that is NULL or holds a NULL or non-finite entry counts for no other row.
    """
    if id_column is not None and prior is not None:
        raise ValueError("prior moments hold no record ids: leave out id_column")
    rows = running_vectors(df, keys, order_by, vector, ridge=ridge, prior=prior, split=split)
    rows = vector_metrics(rows, distance_limit, z_limit)
    return _verdicts(rows, df.columns, keys, order_by, score_column, id_column, entropy_limit, needed, split, wide=True)


def seed_baseline(batch: DataFrame, baseline: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Put history before a batch, marked ``is_baseline``, for scoring with ``review``.

    The rows of ``store`` are the history when it has any, otherwise those of
    ``baseline``.  Score the result with ``BEFORE`` as the first order column, which puts all
    history of a key before its batch whatever the other order columns say, then keep ``~is_baseline``.
    """
    history = baseline if store is None or store.isEmpty() else store
    both = history.withColumn("is_baseline", F.lit(True)).unionByName(batch.withColumn("is_baseline", F.lit(False)))
    return both.withColumn(BEFORE, F.when(F.col("is_baseline"), 0).otherwise(1))
