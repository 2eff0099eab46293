"""Shared pieces of the query catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
NUDGE = 1e-9


@dataclass(frozen=True)
class Query:
    """A registered query and, where SQL can say the same, its SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*names: str, digits: int = DIGITS) -> list[Column]:
    """Rounded columns.

    Means of prices with two decimals often end in an exact 5, which two engines
    may round differently, so both sides move off that edge by ``NUDGE`` first.
    """
    return [F.round(F.col(n) + NUDGE, digits).alias(n.split(".")[-1]) for n in names]


def r(expression: str, name: str, digits: int = DIGITS) -> str:
    """SQL for the same rounded column; adding 0.0 turns a negative zero into zero."""
    return f"round({expression} + {NUDGE}, {digits}) + 0.0 AS {name}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number inside ``props`` as column ``k``."""
    return table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("double")
    )


EVENTS_SQL = "SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events"
