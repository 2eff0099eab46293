"""Queries that run the events table as a stream.

The events arrive in three slices of time.  Each slice is written to the input
folder of the stream, then the stream is started, takes what is new and stops:
three micro-batches over the same checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.catalog import reports, scoring
from tidemark.catalog.common import Query, rounded
from tidemark.session import run_folder
from tidemark.sources.files import source_stream
from tidemark.streaming.batches import read_batches
from tidemark.streaming.buckets import read_buckets
from tidemark.streaming.buckets import stream_upsert_buckets as start_buckets
from tidemark.streaming.keyed import stream_review_keyed as start_keyed
from tidemark.streaming.review import stream_alerts as start_alerts
from tidemark.streaming.review import stream_review as start_review
from tidemark.streaming.upsert import read_store
from tidemark.streaming.upsert import stream_upsert as start_upsert

SLICES = 3


def _slices(rows: DataFrame) -> Iterator[DataFrame]:
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cuts = rows.agg(F.percentile_approx("ts", shares)).head()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows
        if low is not None:
            part = part.filter(F.col("ts") >= F.lit(low))
        if high is not None:
            part = part.filter(F.col("ts") < F.lit(high))
        yield part


def _arrive(
    spark: SparkSession, sf_dir: str, folder: str, start: Callable[[DataFrame], StreamingQuery], rows: DataFrame | None = None
) -> None:
    rows = scoring.scored_events(spark, sf_dir) if rows is None else rows
    for part in _slices(rows):
        part.write.mode("append").parquet(f"{folder}/input")
        start(source_stream(spark, f"{folder}/input", rows.schema)).awaitTermination()


def _reviewed(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    def start(stream: DataFrame) -> StreamingQuery:
        return start_review(
            stream, folder, scoring.KEYS, scoring.ORDER, scoring.FEATURES, "score_array"
        )

    _arrive(spark, sf_dir, folder, start)
    return read_batches(spark, f"{folder}/scored")


def stream_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir, run_folder(spark, "review"))
    return found.select(
        "event_id", "record_count", *scoring.FLAGS, *rounded(*scoring.METRICS, digits=4)
    )


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair", F.array(*scoring.FEATURES))


def _keyed_columns(found: DataFrame) -> DataFrame:
    return found.select("event_id", "record_count", *scoring.FLAGS, *rounded(*scoring.METRICS, digits=4))


def stream_review_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per user; the event type is the record id, and repeats over the batches."""
    folder = run_folder(spark, "keyed-review")

    def start(stream: DataFrame) -> StreamingQuery:
        return start_keyed(
            _pairs(stream), folder, scoring.KEYS, scoring.ORDER, "pair", "score_array", id_column="event_type"
        )

    _arrive(spark, sf_dir, folder, start)
    return _keyed_columns(spark.read.parquet(f"{folder}/scored"))


def stream_review_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups are the stored vectors that the state of each user starts from; the others arrive."""
    folder = run_folder(spark, "stored-review")
    rows = scoring.scored_events(spark, sf_dir)
    stored = _pairs(rows.filter(F.col("event_type") == "signup"))

    def start(stream: DataFrame) -> StreamingQuery:
        return start_keyed(_pairs(stream), folder, scoring.KEYS, scoring.ORDER, "pair", "score_array", stored=stored)

    _arrive(spark, sf_dir, folder, start, rows.filter(F.col("event_type") != "signup"))
    return _keyed_columns(spark.read.parquet(f"{folder}/scored"))


def source_stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrives: the events themselves, appended as they come."""
    folder = run_folder(spark, "arrivals")

    def start(stream: DataFrame) -> StreamingQuery:
        sink = stream.select("event_id", "event_type", "value").writeStream.format("parquet")
        sink = sink.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        return sink.trigger(availableNow=True).start()

    _arrive(spark, sf_dir, folder, start)
    return spark.read.parquet(f"{folder}/out")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on the stream of reviewed events."""
    folder = run_folder(spark, "alerts")
    schema = _reviewed(spark, sf_dir, folder).schema
    reviewed = source_stream(spark, f"{folder}/scored", schema)
    start_alerts(reviewed, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/alerts").select("event_id", "level", "message", "threshold")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "upsert")
    _arrive(spark, sf_dir, folder, lambda stream: start_upsert(stream, folder, ["user_id"], scoring.ORDER))
    found = read_store(spark, folder, ["user_id"], scoring.ORDER)
    return found.select("user_id", "event_id", "event_type", "value", "props")


def stream_upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store in buckets; each batch rewrites the buckets of its users."""
    folder = run_folder(spark, "buckets")
    _arrive(spark, sf_dir, folder, lambda stream: start_buckets(stream, folder, ["user_id"], scoring.ORDER, buckets=16))
    found = read_buckets(spark, folder, scoring.scored_events(spark, sf_dir).schema)
    return found.select("user_id", "event_id", "event_type", "value", "props")


QUERIES = {
    "source_stream": Query(source_stream_rows, "SELECT event_id, event_type, value FROM events"),
    "stream_review": Query(stream_review, scoring.REVIEW_SQL),
    "stream_review_keyed": Query(stream_review_keyed, scoring.REVIEW_BY_TYPE_SQL),
    "stream_review_stored": Query(stream_review_stored, scoring.BASELINE_REVIEW_SQL),
    "stream_alerts": Query(stream_alerts, reports.CONFIDENCE_ALERTS_SQL),
    "stream_upsert": Query(stream_upsert, reports.UPSERT_LATEST_SQL),
    "stream_upsert_buckets": Query(stream_upsert_buckets, reports.UPSERT_LATEST_SQL),
}
