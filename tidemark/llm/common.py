"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import math
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tab, line feed, vertical tab, form feed, carriage return and space.
WHITE = "\t\n\x0b\x0c\r "
BUCKET_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def number_within(df: DataFrame, group: str, row_key: str, name: str, rows: int) -> DataFrame:
    """Number the rows of every group from 0 without gaps, whatever the size of a group.

    The rows of a group are dealt by the hash of ``row_key`` (distinct per row)
    over buckets of about ``BUCKET_ROWS`` of the ``rows`` rows at most; a bucket
    is numbered by one window, and the sizes of the earlier buckets are added.
    """
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(row_key), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(row_key)
    placed = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    return placed.join(starts, [group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_place")).drop(
        "_bucket", "_place", "_start"
    )


def release_shuffles(spark: SparkSession) -> None:
    """Drop the shuffle files of finished jobs now.

    Spark's cleaner removes them when the driver collects its garbage; between the
    steps of a long operator that may come too late for the executors' disks.
    """
    for _ in range(2):  # what the first collection lets go of may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside the driver
