"""Sources of texts: folders, tables and file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_sources(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """Whole files below a folder (or one file) as ``source_id, source``."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("source"))


def from_batch(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Any table with an id and a text as ``source_id, source``."""
    return df.select(F.col(id_column).cast("string").alias("source_id"), F.col(text).alias("source"))


def source_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    *,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)
