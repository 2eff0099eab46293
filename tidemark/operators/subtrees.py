"""Ancestors paired with descendants, for any question about the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.ranges import join_in_range
from tidemark.sources.nodes import VOID_TAGS


def subtree_pairs(
    nodes: DataFrame, ancestors: Column, descendants: Column, *, id_column: str = "doc_id", place: str = "node_id", end: str = "dfs_end"
) -> DataFrame:
    """``id ancestor descendant``: places of all nodes below (not at) the chosen ancestors that satisfy ``descendants``.

    A subtree is a range in depth-first order.  Where a sum is asked for, ``subtree_sums`` needs no pairs.
    """
    above = nodes.filter(ancestors & (F.col(end) > F.col(place))).select(
        id_column, F.col(place).alias("ancestor"), (F.col(place) + 1).alias("_low"), F.col(end).alias("_high")
    )
    below = nodes.filter(descendants).select(id_column, F.col(place).alias("descendant"))
    found = join_in_range(below, above, [id_column], "descendant", "_low", "_high")
    return found.select(id_column, "ancestor", "descendant")


def tag_intervals(tags: DataFrame, id_column: str, void: list[str] = VOID_TAGS) -> DataFrame:
    """Opening tags that may hold others (of ``tag_nodes``), with the last place inside as ``end``; an unclosed tag holds the rest."""
    opens = F.col("is_open") & ~F.col("tag").isin(void)
    closes = ~F.col("is_open") & ~F.col("tag").isin(void)
    last = F.max("ord").over(Window.partitionBy(id_column))
    rows = tags.withColumn("_last", last).filter(opens | closes)
    # a closing tag ends the level above the depth it leaves
    rows = rows.withColumn("_of", F.when(closes, F.col("depth") + 1).otherwise(F.col("depth")))
    later = Window.partitionBy(id_column, "_of").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    closing = F.last(F.when(closes, F.col("ord")), ignorenulls=True).over(later)
    rows = rows.withColumn("end", F.coalesce(closing - 1, F.col("_last")))
    return rows.filter(opens).select(id_column, "ord", "tag", "depth", F.col("end").cast("int").alias("end"))
