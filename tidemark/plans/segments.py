"""Ordered work on keys of any size.

A running value needs its rows in order, and ``Window.partitionBy(key)`` puts
all rows of one key into one task.  When a key may hold a third of the table
that task never ends.  Here a *hot* key is cut into segments along its order
columns, each segment is handled by its own task, and what one segment has to
know about the earlier ones travels in a side table:

* ``segment_rows`` adds ``_seg`` (from 0 for hot keys, NULL for the others) when
  there is a hot key, and nothing otherwise;
* ``with_prefix`` adds the totals of all earlier segments of the same key;
* ``with_halo`` adds the last row before each segment.

A key is hot by its number of rows alone, and gets as many segments as it has
rows for (``Split``).  Cut points are values of the order columns in their own types, so
any type that a window can order can be cut, and results do not depend on the
cuts.  Only rows that are equal in all order columns stay together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEG = "_seg"
#: Sampled rows per segment, from which cut points are taken.
SAMPLE = 40
#: Side tables are broadcast up to this size.
SMALL_BYTES = 64 << 20
HALO = "_halo"


@dataclass(frozen=True)
class Split:
    """When to cut a key: above ``hot_rows`` rows, or above ``1 / most_pieces`` of a table with more than
    ``hot_rows * most_pieces`` rows.

    That bounds all hot keys together to ``2 * most_pieces`` segments, which is
    why their cut points may be fetched and broadcast.  ``hot_rows=None``
    switches cutting off, for tables known to be even.
    """

    hot_rows: int | None = 1_000_000
    most_pieces: int = 100_000

    def __post_init__(self) -> None:
        if self.most_pieces < 1:
            raise ValueError("most_pieces must be at least 1")

    def piece_rows(self, total: int) -> int:
        return max(self.hot_rows, math.ceil(total / self.most_pieces), 1)


DEFAULT_SPLIT = Split()


def join_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, *, small: bool = False
) -> DataFrame:
    """Join on equal keys, NULL equal to NULL; ``small`` marks a right side of proven size."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(F.broadcast(renamed) if small else renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], split: Split = DEFAULT_SPLIT) -> DataFrame:
    """Keys above the limit with ``_rows`` and ``_pieces``: at most ``most_pieces`` rows, so safe to broadcast."""
    return hot_of_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), split)


def hot_of_counts(counts: DataFrame, split: Split = DEFAULT_SPLIT) -> DataFrame:
    """The same from known counts per key, in column ``_rows``."""
    total = counts.agg(F.sum("_rows").alias("_rows")).scalar()
    limit = F.greatest(F.lit(split.hot_rows), F.ceil(total / split.most_pieces), F.lit(1))
    return counts.filter(F.col("_rows") > limit).withColumn("_pieces", F.ceil(F.col("_rows") / limit).cast("int"))


def segment_rows(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], split: Split = DEFAULT_SPLIT
) -> DataFrame:
    """Add ``_seg``, a number that rises with the order columns inside each hot key.

    Runs a count per key first.  Without hot keys the frame comes back as it
    was.  Otherwise cut points are taken from a sample of the hot keys' rows and
    fetched once, so that every use of the result sees the same cuts.  Equal
    rows share a segment, so the order inside and between segments is the
    order of the whole key.
    """
    if split.hot_rows is None:
        return df
    spark = df.sparkSession
    if keys:
        found = hot_keys(df, keys, split)
        rows = found.collect()
        hot = spark.createDataFrame(rows, found.schema)
        most = max((r["_pieces"] for r in rows), default=0)
    else:
        total = df.count()
        most = math.ceil(total / split.piece_rows(total))
    if most < 2:
        return df
    lead = F.struct(*[F.col(c) for c in order_by])
    places = df.select(*keys, lead.alias("_lead"))
    if keys:
        places = join_keys(places, hot, keys, "inner", small=True)
    else:
        places = places.withColumns({"_rows": F.lit(total), "_pieces": F.lit(most)})
    chosen = places.filter(F.rand(7) * F.col("_rows") < SAMPLE * F.col("_pieces"))
    # SAMPLE values per piece
    ordered = chosen.groupBy(*keys).agg(
        F.array_sort(F.collect_list("_lead")).alias("_all"), F.first("_pieces").alias("_pieces")
    )
    at = lambda k: F.get("_all", F.floor(k * F.size("_all") / F.col("_pieces")).cast("int"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), at)).alias("_cuts")
    picked = ordered.filter("_pieces > 1 and size(_all) > 0").select(*keys, cuts)
    local = spark.createDataFrame(picked.collect(), picked.schema)
    if keys:
        return _add_segment(join_keys(df, local, keys, "left", small=True), lead, most)
    return _add_segment(df.withColumn("_cuts", local.scalar()), lead, most)


def _add_segment(df: DataFrame, lead: Column, most: int) -> DataFrame:
    """Count the cuts below ``lead`` by bisection, one generated step per power of two."""
    rows = df.withColumn(SEG, F.lit(0))
    step = 1 << max(0, most - 1).bit_length()
    while step:
        below = F.get("_cuts", F.col(SEG) + (step - 1)) < lead
        rows = rows.withColumn(SEG, F.col(SEG) + F.when(below, step).otherwise(0))
        step //= 2
    return rows.withColumn(SEG, F.when(F.col("_cuts").isNotNull(), F.col(SEG))).drop("_cuts")


def group_columns(rows: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys, and the segment where the frame was cut."""
    return [*keys, SEG] if SEG in rows.columns else [*keys]


def segment_window(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*group_columns(rows, keys)).orderBy(*order_by)


def with_prefix(
    rows: DataFrame,
    keys: Sequence[str],
    partials: dict[str, Column],
    merge: Callable[[WindowSpec], dict[str, Column]],
    prepare: dict[str, Column] | None = None,
) -> DataFrame:
    """Add totals over the earlier segments of the same key (NULL where there are none).

    ``partials`` are aggregates per segment, ``prepare`` adds columns to them,
    and ``merge`` turns both into columns over a window of the earlier segments.
    Fixed-size values only: the side table has at most ``2 * most_pieces`` rows,
    and is broadcast when that many of its width stay small.
    """
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    merged = merge(earlier)
    if SEG not in rows.columns:
        return rows.withColumns({name: F.lit(None) for name in merged})
    side = (
        rows.filter(F.col(SEG).isNotNull())
        .groupBy(*keys, SEG)
        .agg(*[c.alias(name) for name, c in partials.items()])
    )
    if prepare:
        side = side.withColumns(prepare)
    side = side.select(*keys, SEG, *[c.alias(name) for name, c in merged.items()])
    width = 8 * (len(keys) + 1 + len(merged))
    small = 2 * DEFAULT_SPLIT.most_pieces * width <= SMALL_BYTES
    return join_keys(rows, side, [*keys, SEG], "left", small=small)


def with_halo(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Add to each segment a copy of the last row before it, marked ``_halo``.

    ``keep`` limits the copies to rows that satisfy it (the last *defined* value
    for an as-of lookup).  At most one row per segment is added.
    """
    if SEG not in rows.columns:
        return rows.withColumn(HALO, F.lit(False))
    columns = rows.columns
    row = F.struct(*[F.col(c) for c in columns])
    place = F.struct(*[F.col(c) for c in order_by])
    chosen = row if keep is None else F.when(keep, row)
    ranked = place if keep is None else F.when(keep, place)
    last = (
        rows.filter(F.col(SEG).isNotNull())
        .groupBy(*keys, SEG)
        .agg(F.max_by(chosen, ranked).alias("_last"))
    )
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    halo = (
        last.select(SEG, F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
        .filter(F.col("_before").isNotNull())
        .select(*[F.col(SEG) if c == SEG else F.col(f"_before.{c}").alias(c) for c in columns])
    )
    return rows.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))
