"""Exact duplicates by digest, with frequent digests split off by a frequent-items sketch.

Two texts are equal when they are identical after deleting tabs, line breaks,
vertical tabs, form feeds and spaces.  Of equal texts the row with the most
code points stays, then the one with the smallest id; a null id comes last.

The frequent-items sketch (the mergeable form of Misra-Gries counters) names at
most ``HOT_DIGESTS`` digests that may be frequent.  Their winners are verified by an exact
aggregation that is combined before the shuffle, and are broadcast: the copies
of a frequent text never meet in one task.  All other digests are rare, so an
ordinary shuffle groups them.

Cases: a null text counts as empty and all empty texts are one group; of rows
repeated with the same id and text one stays; an empty table gives an empty
result; other columns are ignored by :func:`duplicate_groups` and kept as they
are, whatever their names, by :func:`drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, text_or_empty
from tidemark.session import stored

#: At most so many digests are treated as frequent, whatever the size of the table.
HOT_DIGESTS = 1000
#: Counters of the sketch; a digest with more than 1 / 2000 of the rows is certain to be named.
COUNTERS = 8192


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(text, WHITE, ""), 256))


def _short(column: str) -> Column:
    """The first 60 bits of a digest, as the sketch counts numbers."""
    return F.conv(F.substring(F.hex(column), 1, 15), 16, 10).cast("long")


def frequent(rows: DataFrame, column: str) -> DataFrame:
    """At most ``HOT_DIGESTS`` shortened digests (``_short``) that the sketch counted more than twice."""
    sketch = F.expr(f"approx_top_k(_short, {HOT_DIGESTS}, {COUNTERS})")
    found = rows.select(_short(column).alias("_short")).agg(sketch.alias("items")).select(F.explode("items").alias("i"))
    return found.where("i.count > 2").select(F.col("i.item").alias("_short"))


def _winners(rows: DataFrame) -> DataFrame:
    """Per frequent digest its size and the order key of the row that stays; at most about ``HOT_DIGESTS`` rows."""
    named = F.broadcast(frequent(rows, "_digest"))
    hot = rows.withColumn("_short", _short("_digest")).join(named, "_short", "left_semi")
    found = hot.groupBy("_digest").agg(F.min("_order").alias("_best"), F.count(F.lit(1)).alias("_size"))
    # written once: both branches below must see the same digests
    return stored(found, "frequent-digests")


def duplicate_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id keep_id group_size kept text_sha256``."""
    text = text_or_empty(text_column)
    order = F.struct(
        (-F.char_length(text)).alias("shorter"),
        F.col(id_column).isNull().alias("no_id"),
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )
    # written once, so that the row numbers cannot change, and the texts are read once
    rows = stored(df.select(digest(text).alias("_digest"), order.alias("_order")), "digests")
    winners = _winners(rows)
    hot = rows.join(F.broadcast(winners), "_digest")
    rare = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    group = Window.partitionBy("_digest")
    rare = rare.select(
        "*", F.min("_order").over(group).alias("_best"), F.count(F.lit(1)).over(group).alias("_size")
    )
    return hot.unionByName(rare).select(
        F.col("_order.id").alias("doc_id"),
        F.col("_best.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_order.row") == F.col("_best.row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows equal to a frequent winner's order key pass the broadcast; they and
    the rare rows go through one aggregation that keeps the first row per
    digest and is combined before its shuffle.
    """
    text = text_or_empty(text_column)
    order = F.struct(
        (-F.char_length(text)).alias("shorter"),
        F.col(id_column).isNull().alias("no_id"),
        F.col(id_column).alias("id"),
        F.xxhash64(text).alias("row"),
    )
    keyed = df.select(F.struct("*").alias("_row"), digest(text).alias("_digest"), order.alias("_order"))
    winners = _winners(stored(keyed.select("_digest", "_order"), "digests"))
    best = F.broadcast(winners.select("_digest", "_best"))
    left = keyed.join(best, "_digest", "left").where(F.col("_best").isNull() | (F.col("_order") == F.col("_best")))
    return left.groupBy("_digest").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
