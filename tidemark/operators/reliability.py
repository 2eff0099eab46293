"""Beta-posterior reliability of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.beta import (
    PRIOR_ALPHA,
    PRIOR_BETA,
    beta_quantiles,
    beta_score,
    beta_variance,
)
from tidemark.plans.running import running_sums
from tidemark.plans.segments import DEFAULT_SPLIT, Split


def reliability(
    df: DataFrame,
    keys: Sequence[str],
    success: Column,
    *,
    prior_alpha: float = PRIOR_ALPHA,
    prior_beta: float = PRIOR_BETA,
) -> DataFrame:
    """``alpha beta score variance`` per key; no keys give one score for all rows."""
    hit = F.when(success, 1.0).otherwise(0.0)
    counts = df.groupBy(*keys).agg(
        F.coalesce(F.sum(hit), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(1.0 - hit), F.lit(0.0)).alias("_f")
    )
    rows = counts.withColumn("alpha", prior_alpha + F.col("_s")).withColumn(
        "beta", prior_beta + F.col("_f")
    )
    alpha, beta = F.col("alpha"), F.col("beta")
    return rows.select(
        *keys,
        alpha,
        beta,
        beta_score(alpha, beta).alias("score"),
        beta_variance(alpha, beta).alias("variance"),
    )


def credible_interval(scored: DataFrame, level: float = 0.95) -> DataFrame:
    """Add ``lower upper``, the central interval of Beta(alpha, beta) at ``level``."""
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    levels = [(1.0 - level) / 2.0, (1.0 + level) / 2.0]
    bounds = beta_quantiles(F.col("alpha"), F.col("beta"), levels)
    rows = scored.withColumn("_bounds", bounds)
    found = {"lower": F.col("_bounds")[0], "upper": F.col("_bounds")[1]}
    return rows.withColumns(found).drop("_bounds")


def running_reliability(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    success: Column,
    *,
    prior_alpha: float = PRIOR_ALPHA,
    prior_beta: float = PRIOR_BETA,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``old_score new_score`` around each outcome: the rows of a reliability log."""
    hit = F.when(success, 1).otherwise(0)
    rows = running_sums(
        df.withColumn("_hit", hit), keys, order_by, {"_s": F.col("_hit"), "_n": F.lit(1)}, split=split
    )
    s, n, own = F.col("_s"), F.col("_n"), F.col("_hit")
    both = prior_alpha + prior_beta
    return rows.select(
        *df.columns,
        ((prior_alpha + s - own) / (both + n - 1)).alias("old_score"),
        ((prior_alpha + s) / (both + n)).alias("new_score"),
    )
