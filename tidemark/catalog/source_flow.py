"""Queries over the review of sources from end to end.

Every customer is a source of its nation.  Customers that owe money were reviewed before: their vectors are the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.common import Query, table
from tidemark.catalog.structure import customer_sources
from tidemark.functions import scores
from tidemark.operators import source_review
from tidemark.session import joined_by_sort, stored_wide as stored
from tidemark.sources.store import flatten_struct, parse_metadata, upsert_latest

KEYS, ORDER, ROW = ["c_nationkey"], ["c_custkey"], "_row"
METADATA = (
    "mahalanobis DOUBLE, entropy DOUBLE, z_score DOUBLE, confidence DOUBLE, "
    "security_flags STRUCT<sql_injection: BOOLEAN, hardcoded_secrets: BOOLEAN, eval_exec: BOOLEAN>"
)


def _vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = customer_sources(spark, sf_dir).withColumnRenamed("doc_id", "c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(joined_by_sort(texts), ["c_custkey"])
    rows = rows.select(*[c for c in rows.columns if c != "text"], F.col("c_custkey").alias("source_id"), F.col("text").alias("source"))
    found = source_review.vectorise(rows).withColumn("dim", F.size("embedding"))
    return stored(found.withColumn(ROW, F.monotonically_increasing_id()), "vectorised")


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The store before, and the records of the sources that came after, each with the length ``dim`` of its vector."""
    rows = _vectorised(spark, sf_dir)
    owing = rows.filter("c_acctbal < 0")
    first = source_review.review_sources(owing, ORDER, keys=KEYS, row_id=ROW)
    store = source_review.store_rows(first, F.timestamp_seconds(F.lit(0)), keep=KEYS)
    store = stored(store, "store")
    records = source_review.review_sources(rows.filter("c_acctbal >= 0"), ORDER, keys=KEYS, store=store, row_id=ROW)
    return store, records


def review_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after the store: counts, flags, and whether confidence and vote follow from the metrics."""
    _, records = _reviewed(spark, sf_dir)
    sure = scores.confidence(F.col("mahalanobis_distance"), F.col("entropy"), F.col("z_score"))
    votes = scores.anomaly_vote(F.col("is_ood"), F.col("entropy") > scores.ENTROPY_LIMIT, F.abs("z_score") > scores.Z_LIMIT)
    cold = F.col("is_cold_start")
    follows = (F.abs(F.col("confidence") - F.when(cold, scores.COLD_CONFIDENCE).otherwise(sure)) < 1e-12) & (
        F.col("is_anomalous") == (~cold & votes)
    )
    # a source is part of its own profile, so it is never further than sqrt(n - 1)
    bounded = F.col("mahalanobis_distance") <= F.sqrt(F.col("record_count")) + 1e-6
    found = records.select(
        "c_custkey", "record_count", "is_cold_start", "security_flags", "dim",
        (follows & bounded).alias("verdict_follows"),
    )
    return flatten_struct(found.withColumn("dim", F.when(F.col("dim") > 0, F.col("dim"))))


REVIEW_SOURCES_SQL = """
WITH c AS (
  SELECT *, c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') AS parses FROM customer),
n AS (
  SELECT *, coalesce(sum(CAST(parses AS INT)) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal >= 0, c_custkey
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c)
SELECT c_custkey, CAST(seen AS BIGINT) AS record_count, seen < 3 AS is_cold_start,
       c_mktsegment = 'BUILDING' AS security_flags_sql_injection,
       c_mktsegment = 'FURNITURE' AS security_flags_hardcoded_secrets,
       c_mktsegment = 'BUILDING' AS security_flags_eval_exec,
       CASE WHEN parses THEN 1408 END AS dim, CASE WHEN parses THEN true WHEN seen < 3 THEN NULL END AS verdict_follows
FROM n WHERE c_acctbal >= 0"""


def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store afterwards: whose row it is, whether its JSON holds the verdict, and its flags."""
    store, records = _reviewed(spark, sf_dir)
    records = stored(records, "records")
    new = source_review.store_rows(records, F.timestamp_seconds(F.lit(60)), keep=KEYS)
    # reviewed again later: the last row of an id wins
    again = source_review.store_rows(records.filter("c_acctbal > 9000"), F.timestamp_seconds(F.lit(120)), keep=KEYS)
    kept = upsert_latest(store, new.unionByName(again), ["vector_id"], ["timestamp"])
    rows = parse_metadata(kept, "metadata", METADATA)
    whole = F.col("mahalanobis").isNotNull() & F.col("entropy").isNotNull() & F.col("confidence").between(0, 1)
    rows = rows.select(
        F.col("vector_id").cast("long").alias("vector_id"), "reliability", F.unix_seconds("timestamp").alias("reviewed_at"),
        F.size("embedding").alias("dim"), whole.alias("holds_verdict"), "security_flags",
    )
    return flatten_struct(rows)


STORED_SOURCES_SQL = """
SELECT c_custkey AS vector_id, 0.5::DOUBLE AS reliability,
       CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 120 ELSE 60 END AS BIGINT) AS reviewed_at,
       1408 AS dim, true AS holds_verdict, c_mktsegment = 'BUILDING' AS security_flags_sql_injection,
       c_mktsegment = 'FURNITURE' AS security_flags_hardcoded_secrets,
       c_mktsegment = 'BUILDING' AS security_flags_eval_exec
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"""


QUERIES = {
    "review_sources": Query(review_sources, REVIEW_SOURCES_SQL),
    "stored_sources": Query(stored_sources, STORED_SOURCES_SQL),
}
