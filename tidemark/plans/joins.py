"""Joins of many rows with one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.segments import DEFAULT_SPLIT, Split, hot_keys, hot_of_counts, join_keys

SALT = "_salt"


def find_hot(
    rows: DataFrame, keys: Sequence[str], split: Split = DEFAULT_SPLIT, counts: DataFrame | None = None
) -> DataFrame | None:
    """The hot keys of a table with their number of pieces as a local list, or None where there are none."""
    if split.hot_rows is None:
        return None
    found = hot_keys(rows, keys, split) if counts is None else hot_of_counts(counts, split)
    found = found.select(*keys, "_pieces")
    hot = found.collect()  # at most most_pieces rows
    if not hot:
        return None
    listed = rows.sparkSession.createDataFrame(hot, found.schema)
    return listed


def _mark(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_keys(df, hot, keys, "left", small=True)


def spread_rows(df: DataFrame, hot: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Add a salt that divides each hot key by the hash of the ``spread`` columns."""
    salt = F.pmod(F.xxhash64(*spread), F.col("_pieces")).cast("int")
    rows = _mark(df, hot, keys).withColumn(SALT, F.coalesce(salt, F.lit(0)))
    return rows.drop("_pieces")


def copy_rows(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the rows of hot keys once for every salt."""
    every = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    return _mark(df, hot, keys).withColumn(SALT, F.explode(every)).drop("_pieces")


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    *,
    how: str = "left",
    split: Split = DEFAULT_SPLIT,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``per_key`` (one row per key) to ``rows`` on ``keys``.

    Spark chooses between broadcast and shuffle by size.  Rows of a hot key are
    spread over one salt per piece (``Split``) by the hash of the ``spread`` columns, which should
    tell the rows of a key apart, and the row of that key is repeated for each.  ``counts``
    (``keys`` and ``_rows``), where they are known, spare a pass over ``rows``.
    """
    hot = find_hot(rows, keys, split, counts)
    if hot is None:
        return join_keys(rows, per_key, keys, how)
    salted = spread_rows(rows, hot, keys, spread)
    copied = copy_rows(per_key, hot, keys)
    return join_keys(salted, copied, [*keys, SALT], how).drop(SALT)
