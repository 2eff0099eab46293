"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

A document's ids end with a closing id; only a document longer than the capacity
is cut, into full pieces and a rest.  Best-fit decreasing is run over *counts*:
one step places many pieces of one length into many equal bins, so the plan
depends on the number of lengths (``capacity`` at most), not of documents.  Pieces
are numbered within their length and take the planned slots by a join.

Cases: a null or empty text is the closing id alone; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import number_within, text_or_empty
from tidemark.llm.word_tokens import WordTokens, per_worker, texts
from tidemark.session import stored

PLAN = "length int, rank_from long, rank_to long, per_bin int, first_bin long, first_offset int"


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``histogram[length]`` pieces of each length.

    A row ``(length, rank_from, rank_to, per_bin, first_bin, first_offset)`` says:
    the pieces of these ranks go ``per_bin`` at a time into consecutive bins,
    from ``first_offset`` on.
    """
    plan = []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    bins = 0

    def leave_open(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room = capacity
                first, count = bins, -(-left // (capacity // length))
                bins += count
            per_bin = min(room // length, left)
            used = min(count, left // per_bin)
            plan.append((length, rank, rank + used * per_bin, per_bin, first, capacity - room))
            leave_open(room - per_bin * length, first, used)
            leave_open(room, first + used, count - used)
            rank += used * per_bin
            left -= used * per_bin
    return plan


def pieces(df: DataFrame, vocabulary: str, capacity: int, closing: int, id_column: str, text_column: str) -> DataFrame:
    """One row per piece: ``doc_id piece start length ids_crc32``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_worker(WordTokens, vocabulary)
        end, size = closing.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(texts(batch.column(1))):
                ids = tokens.ids(text) + end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    source.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    df: DataFrame, vocabulary: str, capacity: int = 4096, closing: int = 1,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id piece start length ids_crc32 sequence_id offset``."""
    spark = df.sparkSession
    found = pieces(df, vocabulary, capacity, closing, id_column, text_column)
    # written once: texts are encoded once, and row numbers cannot change
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # at most one row per length
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    plan = plan_best_fit(histogram, capacity)
    ranked = number_within(found, "length", "_row", "_rank", sum(histogram.values()))
    # bounded by the number of lengths, not of documents
    slots = F.broadcast(spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "_length"))
    fits = (
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    )
    nth = F.col("_rank") - F.col("rank_from")
    return ranked.join(slots, fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("per_bin")) * F.col("length")).alias("offset"),
    )
