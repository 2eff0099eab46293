"""Insert or replace from a stream into a store in buckets: a batch rewrites only the buckets of its keys.

The bucket of a row is a hash of its key, and one folder of the store.  A batch reads the buckets it touches (the others are
pruned), puts the merged rows aside, notes that they are complete, and then replaces these buckets.  A batch
that runs again after a failure finds its note and repeats the replacement only, so buckets that were half
replaced come out whole; without the note the store was not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources.store import latest_per_key
from tidemark.streaming.batches import pace

BUCKET = "_bucket"
BUCKETS = 256


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BUCKET, IntegerType())])


def read_buckets(spark: SparkSession, folder: str, schema: StructType, touched: Sequence[int] | None = None) -> DataFrame:
    """The rows of the store, of some buckets only if they are named; read it between batches."""
    found = _read(spark, f"{folder}/store", _with_bucket(schema))
    if found is None:
        return spark.createDataFrame([], schema)
    if touched is not None:
        found = found.filter(F.col(BUCKET).isin([int(b) for b in touched]))
    return found.select(*schema.names)


def upsert_buckets(
    batch: DataFrame, batch_id: int, folder: str, keys: Sequence[str], order_by: Sequence[str], buckets: int = BUCKETS
) -> list[int]:
    """Merge a batch into the store; the buckets it touched.  The later row of each key wins.

    The number of buckets stays the same for a store.  Calls come one after another.
    """
    spark, schema = batch.sparkSession, batch.schema
    aside, note = f"{folder}/aside/{batch_id % 2}", f"{folder}/notes/{batch_id % 2}"
    noted = _read(spark, note, StructType([StructField("batch_id", IntegerType())]))
    if noted is None or noted.filter(F.col("batch_id") == batch_id).isEmpty():
        rows = latest_per_key(batch, keys, order_by).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows = rows.persist()
        # at most ``buckets`` numbers
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        known = read_buckets(spark, folder, schema, touched)
        merged = latest_per_key(known.unionByName(rows.drop(BUCKET)), keys, order_by)
        merged = merged.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged.write.mode("overwrite").parquet(aside)
        rows.unpersist()
        spark.createDataFrame([(batch_id,)], "batch_id int").coalesce(1).write.mode("overwrite").parquet(note)
    whole = spark.read.schema(_with_bucket(schema)).parquet(aside)
    (
        whole.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET).parquet(f"{folder}/store")
    )
    return sorted(r[0] for r in whole.select(BUCKET).distinct().collect())


def stream_upsert_buckets(
    stream: DataFrame,
    folder: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    *,
    buckets: int = BUCKETS,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the latest row per key in ``folder/store``, with ``upsert_buckets`` for every micro-batch."""

    def process(batch: DataFrame, batch_id: int) -> None:
        upsert_buckets(batch, batch_id, folder, keys, order_by, buckets)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**pace(every))
        .start()
    )
