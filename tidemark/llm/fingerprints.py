"""Document fingerprints as Merkle trees over paragraphs and sections.

A line is a paragraph and ``SECTION`` paragraphs are a section.  A paragraph's
node is the SHA-256 of its text, a section's that of its paragraphs' nodes, the
root that of the sections' nodes: equal roots mean equal texts, and where roots
differ, the sections and then the paragraphs that differ hold the edits
(:func:`differing`).  Below the paragraphs are leaves, runs of at most
``LEAF`` characters that end at a sign, as 60-bit hashes; they measure how much
of two texts agrees (:func:`likeness`).  All of it is column expressions.

Cases: a null text counts as empty, whose tree is one empty paragraph without
leaves; equal texts have likeness 1, also two empty ones; a single document is
its own next document; of documents with one id the order is by text; a null id
comes last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import stored

SECTION = 8
LEAF = 24
#: Ends at signs, so that leaves behind an insertion line up again.
LEAF_PATTERN = r"[^.,;!?|\n]{1,%d}[.,;!?|\n]*|[.,;!?|\n]+" % LEAF
#: Neighbours in the order are dealt over blocks of about so many rows, but over at most
#: twice ``MOST_BLOCKS`` blocks: so many short rows are gathered and broadcast, never more.
BLOCK_ROWS = 500
MOST_BLOCKS = 1 << 16


def _node(text: Column) -> Column:
    return F.sha2(text, 256)


def paragraphs(text: Column) -> Column:
    """The nodes of the lines."""
    return F.transform(F.split(text, "\n", -1), _node)


def sections(nodes: Column) -> Column:
    """The nodes of every ``SECTION`` paragraphs."""
    count = F.ceil(F.size(nodes) / F.lit(SECTION)).cast("int")
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda k: _node(F.array_join(F.slice(nodes, (k - 1) * SECTION + 1, F.lit(SECTION)), "")),
    )


def root(nodes: Column) -> Column:
    """The root over the sections' nodes."""
    return _node(F.array_join(nodes, ""))


def leaves(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(LEAF_PATTERN), F.lit(0)),
        lambda leaf: F.conv(F.substring(F.md5(leaf.cast("binary")), 1, 15), 16, 10).cast("long"),
    )


def differing(left: Column, right: Column) -> Column:
    """Places, from 0, at which two lists of nodes differ: first of sections, then of the paragraphs in them."""
    places = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)
    return F.filter(places, lambda k: ~F.get(left, k).eqNullSafe(F.get(right, k)))


def likeness(left: Column, right: Column) -> Column:
    """The larger of two shares: leaves equal place by place, and leaves in common (Dice), from 0 to 1."""
    same = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x))
    in_place = same / F.greatest(F.size(left), F.size(right))
    common = 2 * F.size(F.array_intersect(left, right)) / (F.size(F.array_distinct(left)) + F.size(F.array_distinct(right)))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).otherwise(F.greatest(in_place, common))


def with_next(rows: DataFrame, keys: DataFrame, values: dict[str, str]) -> DataFrame:
    """Add values of each row's next row in descending order of ``_key``; after the last row comes the first.

    ``rows`` holds ``_key``, a struct whose first field ``id`` is a long, and ``keys``
    the same keys alone.  ``values`` maps columns to the names of the next row's values.

    No window spans the table: rows are dealt over blocks of neighbouring ids,
    whose widths follow a histogram of the ids.  The first row of a block also goes, as a
    mark, to the end of the block before.
    """
    spark = rows.sparkSession
    # halves of ids: differences of any two stay within longs
    half = F.shiftright("_key.id", 1)
    low, high, total = keys.agg(F.min(half), F.max(half), F.count(F.lit(1))).head()
    low = low or 0
    width = max(1, math.ceil(((high or 0) - low + 1) / MOST_BLOCKS))
    target = max(BLOCK_ROWS, math.ceil(total / MOST_BLOCKS))
    place = half - low
    cell = F.coalesce(F.floor(place / width), F.lit(-1)).cast("long")
    # at most MOST_BLOCKS cells; each is cut into parts of about the target, few cells into one
    cells = keys.groupBy(cell.alias("_cell")).count().orderBy("_cell").collect()
    blocks, number, filled = [], 0, 0
    for at, count in cells:
        parts = math.ceil(count / target)
        if parts > 1 or filled + count > target:
            number, filled = number + 1, 0
        blocks.append((at, number, parts))
        number, filled = (number + parts, 0) if parts > 1 else (number, filled + count)
    table = F.broadcast(spark.createDataFrame(blocks, "_cell long, _first_block long, _parts long"))

    def dealt(df: DataFrame) -> DataFrame:
        part = F.coalesce(F.floor(F.pmod(place, F.lit(width)) * F.col("_parts") / width), F.lit(0)).cast("long")
        joined = df.withColumn("_cell", cell).join(table, "_cell")
        return joined.withColumn("_block", F.col("_first_block") + part).drop("_cell", "_first_block", "_parts")

    heads = sorted(dealt(keys).groupBy("_block").agg(F.max("_key").alias("_head")).collect())
    # ids fall, so the block before one is the next higher block
    before = [(block, head, heads[(k + 1) % len(heads)][0]) for k, (block, head) in enumerate(heads)]
    kind = rows.schema["_key"].dataType.simpleString()
    marks = F.broadcast(spark.createDataFrame(before, f"_block long, _head {kind}, _before long"))
    stays = F.struct(F.col("_block").alias("block"), F.lit(False).alias("mark"))
    goes = F.struct(F.col("_before").alias("block"), F.lit(True).alias("mark"))
    places = F.when(F.col("_key") == F.col("_head"), F.array(stays, goes)).otherwise(F.array(stays))
    placed = dealt(rows).join(marks, "_block").withColumn("_place", F.explode(places)).drop("_head", "_before", "_block")
    order = Window.partitionBy("_place.block").orderBy(F.col("_place.mark"), F.col("_key").desc_nulls_last())
    following = [F.lead(column).over(order).alias(name) for column, name in values.items()]
    return placed.select("*", *following).where("not _place.mark").drop("_place")


def fingerprint_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how much they agree.

    Columns: ``doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next
    changed_sections changed_paragraphs``; the last two are the places, from 0, where the edit
    shows.  The edited text is the document with its last third replaced by as many
    characters from the start of the next document in descending order of id.
    """
    text = text_or_empty(text_column)
    key = F.struct(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    # written once: the quantities and the heads of blocks are taken from the narrow keys
    keys = stored(df.select(key.alias("_key")), "order-keys")
    rows = df.select(F.col(id_column).alias("doc_id"), text.alias("_text"), key.alias("_key"), leaves(text).alias("_leaves"))
    rows = with_next(rows, keys, {"_text": "_next_text", "_leaves": "_next_leaves"})
    rows = rows.withColumn("n_chars", F.char_length("_text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - third)
    rows = rows.withColumn("_edited", F.concat(kept, F.substring("_next_text", F.lit(1), third)))
    rows = rows.select(
        "*", leaves(F.col("_edited")).alias("_edited_leaves"),
        paragraphs(F.col("_text")).alias("_lines"), paragraphs(F.col("_edited")).alias("_edited_lines"),
    )
    rows = rows.select("*", sections(F.col("_lines")).alias("_parts"), sections(F.col("_edited_lines")).alias("_edited_parts"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        root(F.col("_parts")).alias("fingerprint"), root(F.col("_edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("_leaves"), F.col("_edited_leaves")).alias("near_edited"),
        likeness(F.col("_leaves"), F.col("_next_leaves")).alias("near_next"),
        differing(F.col("_parts"), F.col("_edited_parts")).alias("changed_sections"),
        differing(F.col("_lines"), F.col("_edited_lines")).alias("changed_paragraphs"),
    )
