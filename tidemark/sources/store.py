"""The keyed vector table, its log, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VECTOR_SCHEMA = (
    "vector_id STRING, embedding ARRAY<DOUBLE>, metadata STRING, reliability DOUBLE, timestamp TIMESTAMP"
)
LOG_SCHEMA = "vector_id STRING, old_score DOUBLE, new_score DOUBLE, timestamp TIMESTAMP"


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key, chosen by aggregation (combined before the shuffle)."""
    names = df.columns
    row = F.struct(*[F.col(c) for c in names])
    last = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order_by)).alias("_last"))
    return last.select([F.col(f"_last.{c}").alias(c) for c in names])


def upsert_latest(
    existing: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Insert or replace: the later row of each key wins."""
    return latest_per_key(existing.unionByName(updates), keys, order_by)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup_by_id(df: DataFrame, id_column: str, value) -> DataFrame:
    """The record of one id, or no row; the filter reaches the file scan."""
    return df.filter(F.col(id_column) == F.lit(value))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table to ``root/version=N``: an upsert never overwrites what it reads."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def _leaves(schema: StructType, parents: tuple[str, ...]) -> list[tuple[str, ...]]:
    found = []
    for field in schema.fields:
        here = (*parents, field.name)
        nested = isinstance(field.dataType, StructType)
        found += _leaves(field.dataType, here) if nested else [here]
    return found


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as top-level columns ``parent_child``, in order."""

    def column(path: tuple[str, ...]) -> Column:
        found = F.col(f"`{path[0]}`")
        for name in path[1:]:
            found = found.getField(name)
        return found.alias(separator.join(path))

    return df.select(*[column(path) for path in _leaves(df.schema, ())])


def write_csv(df: DataFrame, path: str) -> None:
    """Flattened rows with a header."""
    flatten_struct(df).write.mode("errorifexists").option("header", True).csv(path)


def metadata_to_json(df: DataFrame, columns: Sequence[str], name: str = "metadata") -> DataFrame:
    """Pack columns into one JSON text."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.to_json(F.struct(*columns)).alias(name))


def parse_metadata(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Unpack a JSON text into the columns of a DDL schema."""
    rows = df.withColumn("_json", F.from_json(column, schema))
    return rows.select(*[c for c in df.columns if c != column], "_json.*")
