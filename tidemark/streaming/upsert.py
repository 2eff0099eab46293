"""Insert or replace from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import latest_per_key
from tidemark.streaming.batches import batches_written, pace, state_before, write_state


def stream_upsert(
    stream: DataFrame, folder: str, keys: Sequence[str], order_by: Sequence[str], *, every: str | None = None
) -> StreamingQuery:
    """Keep the latest row per key in ``folder/store``: of everything available, or ``every`` so often without end.

    A batch writes the latest rows of its own keys only; readers take the latest
    over all parts (``read_store``), and snapshots keep the parts few.
    """

    def merged(parts: DataFrame) -> DataFrame:
        return latest_per_key(parts.drop("part"), keys, order_by)

    def process(batch: DataFrame, batch_id: int) -> None:
        write_state(latest_per_key(batch, keys, order_by), f"{folder}/store", batch_id, merged)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**pace(every))
        .start()
    )


def read_store(
    spark: SparkSession, folder: str, keys: Sequence[str], order_by: Sequence[str], batches: int | None = None
) -> DataFrame:
    """The store after all micro-batches written so far, or after the first ``batches``."""
    if batches is None:
        batches = batches_written(spark, f"{folder}/store")
    parts = state_before(spark, f"{folder}/store", batches)
    if parts is None:
        raise ValueError("the store has no batch yet")
    return latest_per_key(parts.drop("part"), keys, order_by)
