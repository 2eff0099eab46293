"""Operators on tables of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import doubles, dot, l2_distance
from tidemark.plans.joins import join_per_key
from tidemark.plans.running import previous_values
from tidemark.plans.segments import DEFAULT_SPLIT, Split


def _position_sums(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Per key the sums of each position, of all squares, and the number of vectors.

    Values are combined per key and position before the shuffle; the arrays
    built from them have one entry per vector position.
    """
    values = df.select(*keys, F.posexplode(doubles(vector)).alias("pos", "x"))
    places = values.groupBy(*keys, "pos").agg(
        F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("x").alias("n")
    )
    entries = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return places.groupBy(*keys).agg(
        F.transform(entries, lambda e: e["x"]).alias("_sum"),
        F.sum("sq").alias("_sq"),
        F.max("n").alias("_n"),
    )


def vector_centroid(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector per key as column ``centroid``; shorter vectors count as padded with zeros."""
    sums = _position_sums(df, keys, vector)
    return sums.select(*keys, F.transform("_sum", lambda x: x / F.col("_n")).alias("centroid"))


def step_divergence(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    vector: str,
    *,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``divergence``, the distance to the previous vector of the key (0.0 on the first)."""
    rows = previous_values(df, keys, order_by, {"_before": doubles(vector)}, split=split)
    gap = l2_distance(doubles(vector), F.col("_before"))
    return rows.select(
        *df.columns, F.when(F.col("_before").isNull(), 0.0).otherwise(gap).alias("divergence")
    )


def group_divergence(
    df: DataFrame,
    keys: Sequence[str],
    id_column: str,
    vector: str,
    *,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``rms_divergence``, each vector's root mean square distance to the rest of its key.

    The squared distances from x to n vectors add up to ``n|x - c|^2 + sum|y - c|^2``
    with their mean c, so totals per key replace the all-pairs matrix, and an
    offset that all vectors share cancels before squaring.  All vectors must have one length.
    """
    stats = _position_sums(df, keys, vector)
    rows = join_per_key(df, stats, keys, [id_column], split=split)
    gap = F.transform(doubles(vector), lambda x, i: x - F.get("_sum", i) / F.col("_n"))
    rows = rows.select(*df.columns, "_n", gap.alias("_gap")).withColumn("_own", dot(F.col("_gap"), F.col("_gap"))).drop("_gap")
    totals = rows.groupBy(*keys).agg(F.sum("_own").alias("_all"))
    rows = join_per_key(rows, totals, keys, [id_column], split=split)
    n = F.col("_n")
    mean = (n * F.col("_own") + F.col("_all")) / F.greatest(n - 1, F.lit(1))
    return rows.select(*df.columns, F.when(n < 2, 0.0).otherwise(F.sqrt(mean)).alias("rms_divergence"))


def divergence_row(df: DataFrame, vector: str, reference: Sequence[float]) -> DataFrame:
    """One row of the divergence matrix: add the distance of every vector to ``reference``."""
    fixed = F.array(*[F.lit(float(x)) for x in reference])
    return df.withColumn("divergence", l2_distance(doubles(vector), fixed))
