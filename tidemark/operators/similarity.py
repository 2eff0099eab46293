"""Nearest vectors by cosine similarity, exact, without forming pairs and without the driver.

``similarity_search`` deals the vectors into parts and the queries into blocks, both by hash; one
task meets one part with one block and keeps the k best per query (matrix products in slices), so
``k`` rows per query and part are shuffled, and the vectors are scanned once for any number of queries.

``VectorIndex`` deals the vectors by the nearest of a bounded number of centroids instead.  The angle
between query and centroid, less the widest angle inside the cell, bounds every similarity in the cell from
above; cells that cannot reach a query's k-th best so far are skipped.  The answer stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.arrays import doubles
from tidemark.session import stored

TIE_DIGITS = 12
#: Queries of a block and vectors of a part, which meet in one task.
BLOCK_ROWS, PART_ROWS = 8_192, 50_000
#: Numbers of one slice of a matrix of similarities.
SLICE = 1 << 22
#: Queries that are compared with all cells at once.
ROWS = 1_024
#: Vectors that centroids are fitted on, rounds of the fit, and the most cells.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1_024
#: Angles are compared with this much to spare.
SLACK = 1e-6


def top_k(df: DataFrame, score: str, id_column: str, k: int = 5) -> DataFrame:
    """The k rows with the highest score, ties by id."""
    return df.orderBy(F.desc(score), F.asc(id_column)).limit(k)


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; lists of different lengths raise an error."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole.flatten().to_numpy(zero_copy_only=False)
    wide = len(values) // max(len(whole), 1)
    lengths = np.asarray(whole.value_lengths())
    if (lengths != wide).any():
        raise ValueError("vectors and queries must have one common length")
    return values.reshape(len(whole), wide)


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """The rank of every id, which stands for it in comparisons."""
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return rank


def _best(similarity: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest numbers of every row, ties by the smaller rank."""
    if similarity.shape[1] > k:
        edge = np.partition(similarity, similarity.shape[1] - k, axis=1)[:, -k]
        rows, columns = (similarity >= edge[:, None]).nonzero()
    else:
        rows, columns = np.indices(similarity.shape).reshape(2, -1)
    order = np.lexsort((ranks[columns], -similarity[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def _nearest(part: pa.Table, block: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k vectors of a part (``_id _vec``) nearest to every query of a block (``_q _v``)."""
    if not part.num_rows or not block.num_rows:
        return schema.empty_table()
    vectors, queries = _unit_rows(_matrix(part["_vec"])), _unit_rows(_matrix(block["_v"]))
    if vectors.shape[1] != queries.shape[1]:
        raise ValueError("vectors and queries must have one common length")
    ranks, step = _order(part["_id"]), max(1, SLICE // len(vectors))
    rows, columns, found = [], [], []
    for first in range(0, len(queries), step):
        similarity = np.round(queries[first : first + step] @ vectors.T, TIE_DIGITS) + 0.0
        r, c = _best(similarity, ranks, k)
        rows.append(r + first)
        columns.append(c)
        found.append(similarity[r, c])
    names = block["_q"].take(pa.array(np.concatenate(rows)))
    ids = part["_id"].take(pa.array(np.concatenate(columns)))
    return pa.table([names, ids, pa.array(np.concatenate(found))], names=schema.names).cast(schema)


def _asked(queries: DataFrame, query_id: str, query_vector: str) -> DataFrame:
    asked = queries.select(F.col(query_id).alias("_q"), doubles(query_vector).alias("_v"))
    return asked.filter(F.col("_v").isNotNull())


def _kept(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    kept = vectors.select(F.col(id_column).alias("_id"), doubles(vector).alias("_vec"))
    return kept.filter(F.col("_vec").isNotNull())


def _dealt(parts: int, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")


def _meet(parts: DataFrame, blocks: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """``_q _id similarity``: the k best of every part for every query of the blocks it meets."""
    schema = StructType(
        [StructField("_q", blocks.schema["_q"].dataType), StructField("_id", parts.schema["_id"].dataType),
         StructField("similarity", DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def run(part: pa.Table, block: pa.Table) -> pa.Table:
        return _nearest(part, block, k, arrow)

    return parts.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInArrow(run, schema)


def _ranked(found: DataFrame, query_id: str, id_column: str, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("similarity"), F.asc("_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select(F.col("_q").alias(query_id), F.col("_id").alias(id_column), "similarity", "rank")


def similarity_search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_column: str,
    vector: str,
    query_id: str,
    query_vector: str,
    k: int = 5,
    max_queries: int = BLOCK_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The k vectors nearest to each query: ``query_id, id, similarity, rank``.

    A task holds about ``part_rows`` vectors and ``max_queries`` queries.  A vector without length has similarity
    0.0; ties go to the smaller id; NULL vectors and queries are left out.  Queries are told apart by ``query_id``.
    """
    kept, asked = _kept(vectors, id_column, vector), _asked(queries, query_id, query_vector)
    parts, blocks = max(1, math.ceil(kept.count() / part_rows)), max(1, math.ceil(asked.count() / max_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = kept.withColumns({"_part": _dealt(parts, "_id"), "_block": every(blocks)})
    met = asked.withColumn("_block", _dealt(blocks, "_q")).withColumn("_part", every(parts))
    return _ranked(_meet(dealt, met, ["_part", "_block"], k), query_id, id_column, k)


# -- index ---------------------------------------------------------------------------------------------------------


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a sample of unit vectors: Lloyd's rounds from evenly spread members."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        moved = _unit_rows(sums)
        centroids = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, centroids)
    return np.unique(centroids, axis=0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _bounds(queries: np.ndarray, centroids: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """The largest similarity that each cell (columns) may hold for unit queries (rows); the last one holds zeros."""
    if not len(centroids):
        return np.zeros((len(queries), 1))
    if centroids.shape[1] != queries.shape[1]:
        raise ValueError("vectors and queries must have one common length")
    angle = _angles(queries, centroids) - widest - SLACK
    bound = np.cos(np.clip(angle, 0.0, math.pi))
    bound = np.where(np.linalg.norm(queries, axis=1, keepdims=True) > 0, bound, 0.0)
    return np.hstack([bound, np.zeros((len(queries), 1))])


@dataclass(frozen=True)
class VectorIndex:
    """Vectors by cell (``_id _vec _cell _piece``) with the centroids, widest angles, sizes and pieces of the cells.

    The last cell holds the vectors without length, whose similarity is always 0.0.
    """

    rows: DataFrame
    id_column: str
    centroids: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray
    pieces: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return _bounds(queries, self.centroids, self.widest)


def build_index(
    vectors: DataFrame, *, id_column: str, vector: str, cells: int | None = None, part_rows: int = PART_ROWS
) -> VectorIndex:
    """Deal all vectors by their nearest centroid, and store them.

    Centroids are fitted on at most ``SAMPLE`` vectors, the first by the hash of their id; there are as many as
    the square root of the number of vectors says, and at most ``MOST_CELLS``.  Every vector is in the index.
    A cell is cut into pieces of about ``part_rows`` by the hash of the id.
    """
    kept = _kept(vectors, id_column, vector)
    total = kept.count()
    chosen = kept.orderBy(F.xxhash64("_id")).limit(SAMPLE).select("_vec").toArrow()["_vec"]
    sample = _unit_rows(_matrix(chosen))
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    count = min(MOST_CELLS, len(sample), cells or max(1, math.isqrt(total)))
    centroids = _fitted(sample, count) if count else np.zeros((0, sample.shape[1]))
    count = len(centroids)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit_rows(_matrix(batch.column(1)))
            cell, angle = np.full(len(unit), count, np.int32), np.zeros(len(unit))
            some = np.linalg.norm(unit, axis=1) > 0
            if some.any():
                found = _angles(unit[some], centroids)
                cell[some], angle[some] = found.argmin(axis=1), found.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], ["_id", "_vec", "_cell", "_angle"])

    kind = kept.schema["_id"].dataType.simpleString()
    dealt = stored(kept.mapInArrow(deal, f"_id {kind}, _vec array<double>, _cell int, _angle double"), "vector-cells")
    widest, sizes = np.zeros(count), np.zeros(count + 1, np.int64)
    # one row per cell, at most MOST_CELLS + 1
    for cell, n, angle in dealt.groupBy("_cell").agg(F.count(F.lit(1)), F.max("_angle")).collect():
        sizes[cell] = n
        if cell < count:
            widest[cell] = angle
    pieces = np.maximum(1, -(-sizes // part_rows))
    number = F.get(F.array(*[F.lit(int(p)) for p in pieces]), F.col("_cell"))
    rows = dealt.select("_id", "_vec", "_cell", F.pmod(F.xxhash64("_id"), number).cast("int").alias("_piece"))
    return VectorIndex(rows, id_column, centroids, widest, sizes, pieces)


def _assigned(asked: DataFrame, index: VectorIndex, k: int, first: bool) -> DataFrame:
    """``_q _v _cell _piece``: the cells a query has to look into.

    First the cells with the highest bounds that hold k vectors together; later, with the k-th best
    similarity of those in column ``_edge``, all other cells that may reach it.
    """
    centroids, widest, sizes, pieces = index.centroids, index.widest, index.sizes, index.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            bound = _bounds(_unit_rows(_matrix(batch.column(1))), centroids, widest)
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            # cells in order of their bounds, until those before hold k vectors
            opening = np.zeros(bound.shape, bool)
            np.put_along_axis(opening, order, held - sizes[order] < k, axis=1)
            wanted = opening
            if not first:
                edge = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                # fewer than k found: everything may count
                wanted = ~opening & (bound + SLACK >= np.where(np.isnan(edge), -2.0, edge)[:, None])
            rows, cells = (wanted & (sizes > 0)).nonzero()
            each = np.repeat(np.arange(len(rows)), pieces[cells])
            piece = np.arange(len(each)) - np.searchsorted(each, each)
            take = pa.array(rows[each])
            arrays = [batch.column(0).take(take), batch.column(1).take(take)]
            arrays += [pa.array(cells[each].astype(np.int32)), pa.array(piece.astype(np.int32))]
            # queries times pieces of cells: handed over in parts
            whole = pa.RecordBatch.from_arrays(arrays, ["_q", "_v", "_cell", "_piece"])
            yield from (whole.slice(at, BLOCK_ROWS) for at in range(0, whole.num_rows, BLOCK_ROWS))

    kind = asked.schema["_q"].dataType.simpleString()
    return asked.mapInArrow(run, f"_q {kind}, _v array<double>, _cell int, _piece int")


@dataclass(frozen=True)
class Answer:
    """``nearest`` (query, id, similarity, rank), and ``looked``: per query the cells it looked into, of ``cells``."""

    nearest: DataFrame
    looked: DataFrame


def search_index(
    index: VectorIndex, queries: DataFrame, *, query_id: str, query_vector: str, k: int = 5, max_queries: int = BLOCK_ROWS
) -> Answer:
    """What ``similarity_search`` finds, looking only into cells that may hold one of the k best.

    Each query first searches the cells with the highest bounds that hold k vectors; the k-th best similarity there
    rules out all cells with a lower bound.
    """
    asked = stored(_asked(queries, query_id, query_vector), "index-queries")
    blocks = max(1, math.ceil(asked.count() / max_queries))
    by = ["_cell", "_piece", "_block"]
    parts = index.rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(given: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        places = stored(_assigned(given, index, k, first).withColumn("_block", _dealt(blocks, "_q")), "index-places")
        return stored(_meet(parts, places, by, k), "index-found"), places.select("_q", "_cell").distinct()

    found, opened = searched(asked, True)
    order = Window.partitionBy("_q").orderBy(F.desc("similarity"), F.asc("_id"))
    edge = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == k)
    edge = edge.select(F.col("_q").alias("_e"), F.col("similarity").alias("_edge"))
    later = asked.join(edge, asked["_q"].eqNullSafe(edge["_e"]), "left").select("_q", "_v", "_edge")
    more, reached = searched(later, False)
    looked = opened.unionByName(reached).groupBy("_q").agg(F.count(F.lit(1)).alias("looked"))
    looked = looked.select(F.col("_q").alias(query_id), "looked", F.lit(int((index.sizes > 0).sum())).cast("long").alias("cells"))
    return Answer(_ranked(found.unionByName(more), query_id, index.id_column, k), looked)
