"""Queries over the order-dependent scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.common import EVENTS_SQL, Query, events, r, rounded, table
from tidemark.operators import scoring

KEYS = ["user_id"]
ORDER = ["ts", "event_id"]
FEATURES = ["value", "k"]
METRICS = ["mahalanobis_distance", "entropy", "renyi_entropy", "z_score", "mean", "std", "confidence"]
FLAGS = ["is_ood", "is_anomalous", "is_cold_start"]

OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def running_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    found = scoring.running_zscore(rows, KEYS, ORDER, "value")
    return found.select("event_id", "is_z_anomalous", *rounded("z_score", "mean", "std"))


def _zscore_sql(over: str) -> str:
    return f"""
WITH m AS (
  SELECT event_id, value, count(*) {over} AS n, avg(value) {over} AS mean,
         coalesce(stddev_samp(value) {over}, 0.0) AS std
  FROM events),
s AS (SELECT *, CASE WHEN n < 2 OR std = 0 THEN 0.0 ELSE (value - mean) / std END AS z FROM m)
SELECT event_id, abs(z) > 2.5 AS is_z_anomalous, {r('z', 'z_score')}, {r('mean', 'mean')}, {r('std', 'std')}
FROM s"""


def zscore_of_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    found = scoring.running_zscore(rows, KEYS, ORDER, "value", include_self=False)
    return found.select("event_id", "is_z_anomalous", *rounded("z_score", "mean", "std"))


_EARLIER = (
    "OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
ZSCORE_OF_EARLIER_SQL = _zscore_sql(_EARLIER).replace(
    f"avg(value) {_EARLIER} AS mean", f"coalesce(avg(value) {_EARLIER}, 0.0) AS mean"
)


def sliding_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    found = scoring.sliding_zscore(rows, KEYS, ORDER, "value", 20)
    return found.select("event_id", "is_z_anomalous", *rounded("z_score", "mean", "std"))


def running_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_partkey", "l_extendedprice",
        "l_quantity", "l_discount",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    found = scoring.running_mahalanobis(rows, ["l_suppkey"], order, ["l_quantity", "l_discount"])
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "is_ood", *rounded("mahalanobis_distance", digits=4)
    )


_SHIPPED = (
    "OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, "
    "l_extendedprice ROWS UNBOUNDED PRECEDING)"
)
RUNNING_MAHALANOBIS_SQL = f"""
WITH m AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         l_quantity - avg(l_quantity) {_SHIPPED} AS x, l_discount - avg(l_discount) {_SHIPPED} AS y,
         var_pop(l_quantity) {_SHIPPED} + 1e-6 AS a, var_pop(l_discount) {_SHIPPED} + 1e-6 AS b,
         covar_pop(l_quantity, l_discount) {_SHIPPED} AS c
  FROM lineitem),
s AS (
  SELECT *, sqrt(greatest((b * x * x - 2.0 * c * x * y + a * y * y) / (a * b - c * c), 0.0)) AS d FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, d > 3.0 AS is_ood, {r('d', 'mahalanobis_distance', 4)} FROM s"""


def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = scoring.cold_start(rows, KEYS, ORDER, "event_type")
    return found.select("event_id", "record_count", "is_cold_start")


COLD_START_SQL = """
WITH f AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
            THEN 1 ELSE 0 END AS is_first
  FROM events),
c AS (
  SELECT event_id, CAST(coalesce(sum(is_first) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_count
  FROM f)
SELECT event_id, record_count, record_count < 3 AS is_cold_start FROM c"""


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score array for the entropy part."""
    return events(spark, sf_dir).withColumn(
        "score_array", F.array(F.col("value") / 100, F.col("k") / 100, F.lit(0.5), F.lit(0.0))
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.review(scored_events(spark, sf_dir), KEYS, ORDER, FEATURES, "score_array")


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_events(spark, sf_dir).select(
        "event_id", "record_count", *FLAGS, *rounded(*METRICS, digits=4)
    )


def review_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir)
    found = scoring.review(rows, KEYS, ORDER, FEATURES, "score_array", id_column="event_type")
    return found.select("event_id", "record_count", *FLAGS, *rounded(*METRICS, digits=4))


def review_ctes(source: str = EVENTS_SQL, count: str | None = None) -> str:
    """SQL of the review up to relation ``reviewed``; ``count`` replaces the record count."""
    count = count or "n - 1"
    return f"""
e AS ({source}),
m AS (
  SELECT e.*, (value + k) / 2 AS flat, count(*) {OVER} AS n,
         value - avg(value) {OVER} AS dx, k - avg(k) {OVER} AS dy,
         var_pop(value) {OVER} + 1e-6 AS vx, var_pop(k) {OVER} + 1e-6 AS vy, covar_pop(value, k) {OVER} AS vxy,
         avg((value + k) / 2) {OVER} AS mean, coalesce(stddev_samp((value + k) / 2) {OVER}, 0.0) AS std,
         exp(value / 100) + exp(k / 100) + exp(0.5) + 1.0 AS w
  FROM e),
p AS (
  SELECT *, exp(value / 100) / w AS p1, exp(k / 100) / w AS p2, exp(0.5) / w AS p3, 1.0 / w AS p4,
         sqrt(greatest((vy * dx * dx - 2.0 * vxy * dx * dy + vx * dy * dy) / (vx * vy - vxy * vxy), 0.0))
           AS mahalanobis_distance,
         CASE WHEN n < 2 OR std = 0 THEN 0.0 ELSE (flat - mean) / std END AS z_score,
         CAST({count} AS BIGINT) AS record_count
  FROM m),
h AS (
  SELECT *, -(p1 * log2(p1) + p2 * log2(p2) + p3 * log2(p3) + p4 * log2(p4)) AS entropy,
         -log2(p1 * p1 + p2 * p2 + p3 * p3 + p4 * p4) AS renyi_entropy,
         mahalanobis_distance > 3.0 AS is_ood, record_count < 3 AS is_cold_start
  FROM p),
reviewed AS (
  SELECT *, NOT is_cold_start AND CAST(is_ood AS INT) + CAST(entropy > 4.0 AS INT)
              + CAST(abs(z_score) > 2.5 AS INT) >= 2 AS is_anomalous,
         CASE WHEN is_cold_start THEN 0.5 ELSE 1.0 / (1.0 + 0.1 * least(mahalanobis_distance, 50.0)
              + 0.05 * entropy + 0.2 * abs(z_score)) END AS confidence
  FROM h)"""


_REVIEW_COLUMNS = ", ".join(["event_id", "record_count", *FLAGS, *[r(m, m, 4) for m in METRICS]])
REVIEW_SQL = f"WITH {review_ctes()} SELECT {_REVIEW_COLUMNS} FROM reviewed"

_TYPED_SQL = f"""
SELECT e0.*, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
             THEN 1 ELSE 0 END AS is_first FROM ({EVENTS_SQL}) e0"""
REVIEW_BY_TYPE_SQL = f"""WITH {review_ctes(_TYPED_SQL, f"sum(is_first) {OVER} - is_first")}
SELECT {_REVIEW_COLUMNS} FROM reviewed"""


def baseline_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups are the trusted history; everything else is scored against it and itself."""
    rows = scored_events(spark, sf_dir)
    known = rows.filter(F.col("event_type") == "signup")
    batch = rows.filter(F.col("event_type") != "signup")
    seeded = scoring.seed_baseline(batch, known)
    found = scoring.review(seeded, KEYS, [scoring.BEFORE, *ORDER], FEATURES, "score_array")
    return found.filter(~F.col("is_baseline")).select(
        "event_id", "record_count", *FLAGS, *rounded(*METRICS, digits=4)
    )


_HISTORY_FIRST = REVIEW_SQL.replace("ORDER BY ts", "ORDER BY event_type <> 'signup', ts")
BASELINE_REVIEW_SQL = f"{_HISTORY_FIRST} WHERE event_type <> 'signup'"


QUERIES = {
    "running_zscore": Query(running_zscore, _zscore_sql(OVER)),
    "zscore_of_earlier": Query(zscore_of_earlier, ZSCORE_OF_EARLIER_SQL),
    "sliding_zscore": Query(
        sliding_zscore, _zscore_sql("OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)")
    ),
    "running_mahalanobis": Query(running_mahalanobis, RUNNING_MAHALANOBIS_SQL),
    "cold_start": Query(cold_start, COLD_START_SQL),
    "review": Query(review, REVIEW_SQL),
    "review_by_type": Query(review_by_type, REVIEW_BY_TYPE_SQL),
    "seed_baseline": Query(baseline_review, BASELINE_REVIEW_SQL),
}
