"""All pairs of vectors within a distance, without forming all pairs.

Distances to a few pivots put every vector into a cell of a grid whose width is the distance asked for.
By the triangle inequality two vectors that near lie in the same or in neighbouring cells, so one equi-join on
cells finds every pair; the distance itself is then computed.  Equal vectors count once, under their smallest id.  A dense cell
is cut into blocks of rows, of which each two meet once; a task keeps one block and compares the rows of the other with it as
matrix products, giving pairs as it finds them.  What is shuffled is a row for each block it meets, so blocks are as few as tasks
need to share the work, until their size says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from tidemark.functions.arrays import doubles
from tidemark.plans.segments import join_keys
from tidemark.session import stored

PIVOTS = 3
#: Vectors that pivots are chosen from, the first by the hash of their id.
SAMPLE = 2_000
#: Rows of a block at least; two blocks meet in one task.
BLOCK_ROWS = 4_096
#: Blocks of a cell, as long as one does not hold more than ``BLOCK_BYTES`` of vectors.
MEETING, BLOCK_BYTES = 16, 32 << 20
#: Numbers of one slice of a matrix of distances.
SLICE = 1 << 22
#: Cells are wider than the distance by this share, so that rounding never moves a pair two cells apart.
WIDER = 1e-9


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    wide = len(values) // max(len(whole), 1)
    if (np.asarray(whole.value_lengths()) != wide).any():
        raise ValueError("vectors must have one common length")
    return values.reshape(len(whole), wide)


def _far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of a sample, each the farthest from those before."""
    chosen = [int(np.linalg.norm(sample - sample.mean(axis=0), axis=1).argmax())]
    nearest = np.linalg.norm(sample - sample[chosen[0]], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def vector_classes(df: DataFrame, id_column: str, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys id representative``: equal vectors of a key under the smallest id; NULL vectors are left out."""
    rows = df.select(*keys, F.col(id_column), doubles(vector).alias("_v")).filter("_v is not null")
    first = rows.groupBy(*keys, "_v").agg(F.min(id_column).alias("representative"))
    return join_keys(rows, first, [*keys, "_v"], "inner").select(*keys, id_column, "representative")


class _Block:
    """The rows of a block, which others meet."""

    def __init__(self, rows: pa.Table):
        self.ids, self.rows = rows["_id"], _rows(rows["_v"])
        self.squares = (self.rows * self.rows).sum(axis=1)

    def pairs(self, left: pa.Table, width: int, within: float, schema: pa.Schema) -> Iterator[pa.Table]:
        """Pairs of other rows with those of the block, at most ``within`` apart, once each and with the smaller id first.

        Two rows of one block meet twice, all others once; as many pairs are held as a slice of distances has.
        """
        a, b = _rows(left["_v"]), self.rows
        if a.shape[1] != b.shape[1]:
            raise ValueError("vectors must have one common length")
        step = max(1, SLICE // len(b))
        some = max(1, SLICE // max(a.shape[1], 1))
        for first in range(0, len(a), step):
            part = a[first : first + step]
            own = (part * part).sum(axis=1)
            rough = own[:, None] - 2.0 * (part @ b.T) + self.squares[None, :]
            # the product loses digits where vectors are long; what may be near is measured again
            spare = 1e-12 * (own[:, None] + self.squares[None, :])
            x, y = (rough <= within * within * (1 + 1e-9) + spare).nonzero()
            spans = [slice(k, k + some) for k in range(0, len(x), some)]
            far = np.concatenate([np.zeros(0), *(np.linalg.norm(part[x[s]] - b[y[s]], axis=1) for s in spans)])
            near = far <= within
            x, y, far = pa.array(x[near] + first), pa.array(y[near]), far[near]
            ids = [left["_id"].take(x), self.ids.take(y)]
            ordered = pc.less(ids[0], ids[1])
            wanted = pc.or_(ordered, pc.and_(left["_visits"].take(x), pc.not_equal(ids[0], ids[1])))
            ids = [pc.if_else(ordered, *ids), pc.if_else(ordered, *ids[::-1])]
            keys = [left[f"_k{k}"].take(x) for k in range(width)]
            yield pa.table([*keys, *ids, pa.array(far)], names=schema.names).cast(schema).filter(wanted)


def _pairs_of(left: pa.Table, right: pa.Table, width: int, within: float, schema: pa.Schema) -> pa.Table:
    """All pairs of rows and a block."""
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    return pa.concat_tables(_Block(right).pairs(left, width, within, schema))


def _blocks(rows: Column, block_rows: int, most: int) -> Column:
    """Blocks for so many rows."""
    size = F.greatest(F.lit(block_rows), F.least(F.lit(most), F.ceil(rows / MEETING)))
    return F.ceil(rows / size).cast("int")


def _meetings(placed: DataFrame, around: DataFrame, cells: DataFrame, cell: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows for each meeting ``_place _x _y``: those of block ``_x`` of a cell (``_side`` 0) and those that come to them (1).

    To a block come the blocks of its cell from itself on, and all blocks of visitors.
    """

    def rows(df: DataFrame, side: int, visits: Column) -> DataFrame:
        return df.select("_place", "_x", "_y", F.lit(side).alias("_side"), visits.alias("_visits"), *keys, "_id", "_v")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")

    def every(first: Column, end: Column) -> Column:
        return F.explode(F.sequence(first, end - 1))

    own = join_keys(placed, cells, cell, "inner").withColumn("_own", block("_blocks"))
    kept = own.withColumns({"_x": F.col("_own"), "_y": every(F.col("_own"), F.col("_blocks") + F.col("_others"))})
    home = own.withColumns({"_y": F.col("_own"), "_x": every(F.lit(0), F.col("_own") + 1)})
    # cells without rows of their own have no visitors to pair
    guests = join_keys(around, cells, cell, "inner")
    guests = guests.withColumns({"_y": F.col("_blocks") + block("_others"), "_x": every(F.lit(0), F.col("_blocks"))})
    coming = rows(home, 1, F.col("_x") != F.col("_y")).unionByName(rows(guests, 1, F.lit(True)))
    return rows(kept, 0, F.lit(False)).unionByName(coming)


def near_pairs(
    df: DataFrame, id_column: str, vector: str, within: float, *, keys: Sequence[str] = (), pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``keys first_id second_id divergence``: pairs of different vectors at most ``within`` apart, ``first_id`` smaller.

    Each vector stands once, under the smallest id that has it; ``vector_classes`` tells who shares it.  With ``keys`` only
    vectors of one key are paired.  Pivots are chosen from at most ``SAMPLE`` vectors; they change the work, not the
    answer.  Ids must not be NULL.
    """
    if not within > 0:
        raise ValueError("the distance must be positive; vector_classes finds equal vectors")
    named = [F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)]
    by = [f"_k{k}" for k in range(len(keys))]
    # floats are doubles, too, in half the space
    short = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    value = F.col(vector) if short else doubles(vector)
    rows = df.select(*named, F.col(id_column).alias("_id"), value.alias("_v")).filter("_v is not null")
    rows = stored(rows.groupBy(*by, "_v").agg(F.min("_id").alias("_id")), "single-vectors")
    sample = rows.orderBy(F.xxhash64("_id")).limit(SAMPLE).select("_v").toArrow()["_v"]
    fields = [StructField(c, df.schema[c].dataType) for c in keys]
    kind = rows.schema["_id"].dataType
    schema = StructType([*fields, StructField("first_id", kind), StructField("second_id", kind), StructField("divergence", DoubleType())])
    if not len(sample):
        return df.sparkSession.createDataFrame([], schema)
    chosen = _far_apart(_rows(sample), pivots)
    width = within * (1 + WIDER)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column(len(by)))
                far = np.stack([np.linalg.norm(v - pivot, axis=1) for pivot in chosen], axis=1)
                cells = pa.array(list(np.floor(far / width).astype(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*by, "_v", "_id", "_cell"])

    placed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(rows.mapInArrow(place, f"{placed}, _cell array<long>"), "placed-vectors")
    # of two neighbouring cells one visits the other: those after it in order
    half = [shift for shift in product((-1, 0, 1), repeat=len(chosen)) if shift > (0,) * len(chosen)]
    shifts = F.array(*[F.array(*[F.lit(s) for s in shift]) for shift in half])
    around = placed.withColumn("_shift", F.explode(shifts))
    around = around.withColumn("_cell", F.zip_with("_cell", "_shift", lambda c, s: c + s)).drop("_shift")
    cell = [*by, "_cell"]
    most = max(1, BLOCK_BYTES // (8 * max(1, chosen.shape[1])))
    sizes = placed.groupBy(*cell).agg(_blocks(F.count(F.lit(1)), block_rows, most).alias("_blocks"))
    guests = around.groupBy(*cell).agg(_blocks(F.count(F.lit(1)), block_rows, most).alias("_others"))
    cells = join_keys(sizes, guests, cell, "left").withColumn("_others", F.coalesce("_others", F.lit(0)))
    cells = stored(cells.withColumn("_place", F.monotonically_increasing_id()), "cells")
    arrow, wide, limit = to_arrow_schema(schema), len(by), float(within)
    meeting = ["_place", "_x", "_y"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(name).to_numpy() for name in meeting], axis=1)
            sides = batch.column("_side").to_numpy()
            starts = [0, *((at[1:] != at[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if last != (here := tuple(at[start].tolist())):
                    last, held, block = here, [], None
                coming = start + int((sides[start:end] == 0).sum())
                if coming > start:
                    held.append(batch.slice(start, coming - start))
                if coming < end and held:
                    block = block or _Block(pa.Table.from_batches(held))
                    left = pa.Table.from_batches([batch.slice(coming, end - coming)])
                    for found in block.pairs(left, wide, limit, arrow):
                        yield from found.to_batches()

    met = _meetings(placed, around, cells, cell, by).repartition(*meeting).sortWithinPartitions(*meeting, "_side")
    return met.mapInArrow(meet, schema)
