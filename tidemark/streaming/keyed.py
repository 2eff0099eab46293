"""The review of a stream with state per key: a batch reads and writes the state of its own keys only.

Spark keeps the state (RocksDB): per key the moments of its vectors and the record ids it has
seen.  So ids may repeat over batches, and a batch costs what its rows cost, however many keys
are known.  The rows of one key in one micro-batch are put in order in memory; limit the size of
batches (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) where a single key may fill them, or use
``stream_review``, which cuts hot keys but knows no ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import scores
from tidemark.functions.arrays import doubles
from tidemark.operators import scoring
from tidemark.plans.wide import MOMENTS, RunningVectors, vector_moments
from tidemark.streaming.batches import pace

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns have plain names on their way through the state: others would not all survive it.
X, ID = "x", "name"
METRICS = ["_n", "_distance", "_flat", "_flat_mean", "_flat_m2"]


def _place(value) -> tuple:
    """A value to sort by, NULL and NaN first."""
    missing = value is None or value != value
    return (not missing, None if missing else value)


def _usable(value) -> np.ndarray | None:
    """A vector of finite numbers, or None."""
    if value is None or not len(value):
        return None
    x = np.array(value, dtype=float)
    return x if np.isfinite(x).all() else None


class KeyedReview(StatefulProcessor):
    """Moments and ids of one key; rows are scored in order, each against the key so far."""

    def __init__(self, order_by: Sequence[str], with_ids: bool, ridge: float):
        self.order_by, self.with_ids, self.ridge = list(order_by), with_ids, ridge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n double, mean array<double>, m2 array<double>, flat_m2 double")
        self.count = handle.getValueState("count", "n long")
        self.ids = handle.getMapState("ids", "id string", "known boolean")

    def _read(self) -> tuple[RunningVectors | None, int]:
        known, count = self.moments.get(), self.count.get()
        state = None
        if known is not None:
            n, mean, m2, flat_m2 = known
            state = RunningVectors(len(mean), self.ridge, n, np.array(mean, float), np.array(m2, float))
            state.flat_m2 = flat_m2
        return state, 0 if count is None else count[0]

    def _write(self, state: RunningVectors | None, count: int) -> None:
        if state is not None:
            n, mean, m2 = state.packed()
            self.moments.update((n, mean.tolist(), m2.tolist(), state.flat_m2))
        self.count.update((count,))

    def _is_new(self, name: str, seen: set) -> bool:
        """Whether the key meets an id for the first time; ``seen`` spares asking the store twice in a batch."""
        if name in seen:
            return False
        seen.add(name)
        if self.ids.containsKey((name,)):
            return False
        self.ids.updateValue((name,), (True,))
        return True

    def _add(self, state: RunningVectors | None, x: np.ndarray) -> RunningVectors:
        if state is None:
            state = RunningVectors(len(x), self.ridge)
        if len(x) != len(state.mean):
            raise ValueError("vectors must have one common length")
        state.add(x)
        return state

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Moments of the key's stored vectors, or one of its stored ids."""
        n, mean, m2 = (initialState[c] for c in MOMENTS)
        _, count = self._read()
        if mean is None:
            self.count.update((count + self._is_new(initialState[ID], set()),))
        else:
            state = RunningVectors(len(mean), self.ridge, n, np.array(mean, float), np.array(m2, float))
            self._write(state, count if self.with_ids else int(n))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda row: [_place(row[c]) for c in self.order_by])
        names = [c for c in batch[0].__fields__ if c not in (X, ID)]
        kept = [batch[0].__fields__.index(c) for c in names]
        scored = Row(*names, *METRICS, "record_count")
        state, count = self._read()
        seen: set = set()
        found = []
        for row in batch:
            x = _usable(row[X])
            before = count
            if x is not None:
                state = self._add(state, x)
                metrics = (state.n, state.distance(x), float(x.mean()), state.flat_mean, state.flat_m2)
            elif state is None:
                metrics = (0.0, None, None, 0.0, 0.0)
            else:
                metrics = (state.n, None, None, state.flat_mean, state.flat_m2)
            found.append(scored(*(row[k] for k in kept), *metrics, before))
            count += self._is_new(row[ID], seen) if self.with_ids else x is not None
        self._write(state, count)
        yield from found


def _prepared(df: DataFrame, kept: dict[str, str], vector: str, id_column: str | None) -> DataFrame:
    """The columns ``kept`` under their new names, the vector and the id as text, NULL apart from every other."""
    name = F.lit(None) if id_column is None else F.concat(F.lit("="), F.col(id_column).cast("string"))
    found = [F.col(old).alias(new) for old, new in kept.items()]
    return df.select(*found, doubles(vector).alias(X), F.coalesce(name.cast("string"), F.lit("")).alias(ID))


def _initial_rows(known: DataFrame, by: Sequence[str], with_ids: bool) -> DataFrame:
    """What the state starts from: a row of moments per key, and a row per different id of a key where there are ids."""
    rows = vector_moments(known, by, X).withColumn(ID, F.lit(""))
    if with_ids:
        rows = rows.unionByName(known.select(*by, ID).distinct(), allowMissingColumns=True)
    return rows.select(*by, ID, *MOMENTS)


def stream_review_keyed(
    stream: DataFrame,
    folder: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    vector: str,
    score_column: str,
    *,
    id_column: str | None = None,
    stored: DataFrame | None = None,
    distance_limit: float = scores.DISTANCE_LIMIT,
    entropy_limit: float = scores.ENTROPY_LIMIT,
    z_limit: float = scores.Z_LIMIT,
    ridge: float = scoring.RIDGE,
    needed: int = scores.COLD_START_RECORDS,
    every: str | None = None,
) -> StreamingQuery:
    """``review_vectors`` of a stream, rows appended to ``folder/scored``.

    ``id_column`` names record ids, which may repeat over batches: ``record_count`` counts different ones.
    ``stored`` (keys, id and vector of ``load_vectors``) is the history of the first start; a later call with the
    same folder goes on from the state in ``folder/checkpoint``.  Rows of a key have to arrive in order from batch
    to batch; inside a batch they are sorted.  A key's state is one matrix and its ids.
    """
    spark = stream.sparkSession
    kept = {name: f"c{k}" for k, name in enumerate(stream.columns)}
    by = [kept[c] for c in keys]
    rows = _prepared(stream, kept, vector, id_column)
    schema = StructType(
        [*(StructField(f.name, f.dataType) for f in rows.schema if f.name not in (X, ID)),
         *(StructField(m, DoubleType()) for m in METRICS), StructField("record_count", LongType())]
    )
    initial = None
    if stored is not None:
        known = _prepared(stored, {c: kept[c] for c in keys}, vector, id_column)
        initial = _initial_rows(known, by, id_column is not None).groupBy(*by)
    scored = rows.groupBy(*by).transformWithState(
        KeyedReview([kept[c] for c in order_by], id_column is not None, ridge), schema, "Append", "None", initialState=initial
    )
    back = [F.col(new).cast(stream.schema[old].dataType).alias(old) for old, new in kept.items()]
    scored = scored.select(*back, *METRICS, "record_count")
    scored = scoring.vector_metrics(scored, distance_limit, z_limit)
    scored = scored.withColumn("is_cold_start", F.col("record_count") < needed)
    found = scoring.finish_review(scored, stream.columns, score_column, entropy_limit)
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKS_DB)
    try:
        return (
            found.writeStream.format("parquet")
            .option("path", f"{folder}/scored")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
            .trigger(**pace(every))
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)
