"""Results and state of a stream as one folder per micro-batch.

A batch that is repeated after a failure overwrites its own folder, so every
batch counts exactly once.  Every ``SNAPSHOT_EVERY`` batches the state so far
is merged into a snapshot; which snapshot a batch starts from follows from its
number alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_EVERY = 20


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All rows written so far, without the batch number."""
    return spark.read.parquet(folder).drop("batch_id")


def pace(every: str | None) -> dict[str, bool | str]:
    """A trigger: all that is available, then stop; or again after every interval such as ``"10 seconds"``."""
    return {"availableNow": True} if every is None else {"processingTime": every}


def batches_written(spark: SparkSession, folder: str) -> int:
    """How many micro-batches have left their part; 0 without any."""
    try:
        parts = spark.read.parquet(f"{folder}/parts")
    except AnalysisException:
        return 0
    last = parts.agg(F.max("batch_id")).head()[0] if "batch_id" in parts.columns else None
    return 0 if last is None else int(last) + 1


def state_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The newest snapshot before a batch and the parts after it, told apart by ``part``."""
    if batch_id == 0:
        return None
    first = batch_id // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    parts = [(n, f"{folder}/parts/batch_id={n}") for n in range(first, batch_id)]
    if first:
        parts.insert(0, (first - 1, f"{folder}/snapshots/batch_id={first - 1}"))
    found = None
    for number, path in parts:
        part = spark.read.parquet(path).withColumn("part", F.lit(number))
        found = part if found is None else found.unionByName(part)
    return found


def write_state(
    part: DataFrame, folder: str, batch_id: int, merge: Callable[[DataFrame], DataFrame]
) -> None:
    """Store the part of a batch, and a snapshot of everything when one is due."""
    write_batch(part, f"{folder}/parts", batch_id)
    if (batch_id + 1) % SNAPSHOT_EVERY == 0:
        own = part.sparkSession.read.parquet(f"{folder}/parts/batch_id={batch_id}")
        own = own.withColumn("part", F.lit(batch_id))
        earlier = state_before(part.sparkSession, folder, batch_id)
        whole = own if earlier is None else earlier.unionByName(own)
        write_batch(merge(whole), f"{folder}/snapshots", batch_id)
