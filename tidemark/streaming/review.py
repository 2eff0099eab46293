"""The review of a stream: the batch operators over each micro-batch plus state.

State is what the running scores need to know about earlier rows: count, mean
and co-moments per key.  They can be merged, so a hot key is cut into segments
inside a micro-batch as it is in a table, which a per-key state function could
not do.  Rows of a key have to arrive in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import scores
from tidemark.operators import reports, scoring
from tidemark.plans.segments import DEFAULT_SPLIT, Split
from tidemark.streaming.batches import pace, state_before, write_batch, write_state


def stream_review(
    stream: DataFrame,
    folder: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    features: Sequence[str],
    score_column: str,
    *,
    initial: DataFrame | None = None,
    split: Split = DEFAULT_SPLIT,
    every: str | None = None,
    **limits: float,
) -> StreamingQuery:
    """Score a stream: results in ``folder/scored``, state in ``folder/state``.

    It stops after everything available, or runs on ``every`` so often.

    ``initial`` holds the moments of stored vectors (``review_moments``) to go
    on from.  A later call with the same folder continues the stream.
    """
    if "id_column" in limits:
        raise ValueError("the state of a stream holds no record ids: leave out id_column")
    spark = stream.sparkSession

    def merged(parts: DataFrame) -> DataFrame:
        return scoring.merge_review_moments(parts, keys, features)

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        if batch_id == 0 and initial is not None:
            write_batch(initial, f"{folder}/initial", 0)
        known = state_before(spark, f"{folder}/state", batch_id)
        if initial is not None:
            start = _initial_part(spark, folder)
            known = start if known is None else known.unionByName(start)
        prior = None if known is None else merged(known)
        found = scoring.review(
            batch, keys, order_by, features, score_column, prior=prior, split=split, **limits
        )
        write_batch(found, f"{folder}/scored", batch_id)
        part = scoring.review_moments(batch, keys, features)
        write_state(part, f"{folder}/state", batch_id, merged)
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**pace(every))
        .start()
    )


def _initial_part(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/initial/batch_id=0").withColumn("part", F.lit(-1))


def stream_alerts(
    reviewed: DataFrame, folder: str, limit: float = scores.ALERT_CONFIDENCE, *, every: str | None = None
) -> StreamingQuery:
    """ERROR rows for low confidence, appended to ``folder/alerts``; no state."""
    return (
        reports.confidence_alerts(reviewed, limit)
        .writeStream.format("parquet")
        .option("path", f"{folder}/alerts")
        .option("checkpointLocation", f"{folder}/alerts_checkpoint")
        .outputMode("append")
        .trigger(**pace(every))
        .start()
    )
