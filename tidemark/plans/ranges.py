"""Joins of points with the intervals that hold them, as equi-joins.

An interval of whole numbers is cut into dyadic blocks: numbers that agree but for their last ``level`` bits.  At most
two blocks of each level are needed, and a point lies in exactly one block of a level.  So "low <= point <= high" becomes
equality of level and block, which Spark hashes, sorts and splits like any other join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.segments import join_keys
from tidemark.session import joined_by_sort

LEVEL, BLOCK = "_level", "_dyadic"


def dyadic_cover(low: Column, high: Column, levels: int) -> Column:
    """Blocks ``level, block`` that make up the interval, for intervals of fewer than ``2 ** levels`` numbers from 0 on."""
    end = high.cast("long") + 1

    def at(level: Column) -> Column:
        # the part of the interval that larger blocks have to cover, in blocks of this level
        first = F.call_function("shiftright", low.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        last = F.call_function("shiftright", end, level)
        some = first < last
        left = F.when(some & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block")))
        right = F.when(some & (last % 2 == 1), F.struct(level.alias("level"), (last - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def join_in_range(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str
) -> DataFrame:
    """Every point with every interval of its keys that holds it; the two sides share the names of the keys only.

    Points and bounds are whole numbers from 0 on.  NULL points, intervals with a NULL bound and empty intervals
    pair with nothing; NULL keys equal each other.
    """
    widest = intervals.agg(F.max(F.col(high) - F.col(low) + 1)).head()[0]
    levels = max(int(widest or 1), 1).bit_length()
    pieces = F.explode(dyadic_cover(F.col(low), F.col(high), levels))
    covered = intervals.withColumn("_piece", pieces)
    covered = covered.withColumns({LEVEL: F.col("_piece.level"), BLOCK: F.col("_piece.block")}).drop("_piece")
    # only levels that some interval uses; at most one per bit
    used = sorted(row[0] for row in covered.select(LEVEL).distinct().collect())
    if not used:
        used = [0]
    own = F.array(*[
        F.struct(F.lit(k).alias("level"), F.shiftright(F.col(point).cast("long"), k).alias("block")) for k in used
    ])
    placed = points.filter(F.col(point).isNotNull()).withColumn("_piece", F.explode(own))
    placed = placed.withColumns({LEVEL: F.col("_piece.level"), BLOCK: F.col("_piece.block")}).drop("_piece")
    # a few bytes on disk may stand for many pieces
    return join_keys(joined_by_sort(placed), covered, [*keys, LEVEL, BLOCK], "inner").drop(LEVEL, BLOCK)
