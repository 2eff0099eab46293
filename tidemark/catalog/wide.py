"""Queries over running scores of whole vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.common import Query, r, rounded, table
from tidemark.catalog.scoring import FLAGS, METRICS
from tidemark.functions import arrays
from tidemark.operators import scoring
from tidemark.plans.wide import vector_moments
from tidemark.sources.store import load_vectors

KEYS, ORDER = ["label"], ["vec_id"]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors ``v``, and the first two entries as ``pair``, for which SQL has a closed form."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles("embedding").alias("v"))
    return rows.withColumn("pair", F.slice("v", 1, 2))


def running_distance_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.running_mahalanobis_vectors(embeddings(spark, sf_dir).drop("v"), KEYS, ORDER, "pair")
    return found.select("vec_id", "is_ood", *rounded("mahalanobis_distance", digits=4))


def running_distance_of_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against earlier vectors only, from the fifth on."""
    found = scoring.running_mahalanobis_vectors(
        embeddings(spark, sf_dir).drop("v"), KEYS, ORDER, "pair", include_self=False, min_samples=4
    )
    found = found.filter(F.col("mahalanobis_distance") < float("inf"))
    return found.select("vec_id", "is_ood", *rounded("mahalanobis_distance", digits=4))


def running_distance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 entries; a vector of a label with fewer than 64 before it is always ``sqrt(n - 1)`` away."""
    found = scoring.running_mahalanobis_vectors(embeddings(spark, sf_dir).drop("pair"), KEYS, ORDER, "v")
    return found.select("vec_id", "is_ood", *rounded("mahalanobis_distance", digits=4))


def review_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.review_vectors(embeddings(spark, sf_dir), KEYS, ORDER, "pair", "v")
    return found.select("vec_id", "record_count", *FLAGS, *rounded(*METRICS, digits=4))


def review_after_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose third entry is not positive, reviewed after the stored ones, of which it is positive."""
    known = F.col("embedding")[2] > 0
    stored = load_vectors(spark, f"{sf_dir}/embeddings.parquet").filter(known)
    prior = vector_moments(stored.withColumn("pair", F.slice("embedding", 1, 2)), KEYS, "pair")
    batch = embeddings(spark, sf_dir).filter(~(F.col("v")[2] > 0))
    found = scoring.review_vectors(batch, KEYS, ORDER, "pair", "v", prior=prior)
    return found.select("vec_id", "record_count", *FLAGS, *rounded(*METRICS, digits=4))


def _moments_sql(over: str) -> str:
    return f"""
e AS (SELECT vec_id, label, embedding[3] > 0 AS known, CAST(embedding[1] AS DOUBLE) AS a,
             CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (
  SELECT *, count(*) {over} AS n, a - avg(a) {over} AS x, b - avg(b) {over} AS y, (a + b) / 2 AS flat,
         var_pop(a) {over} + 1e-6 AS va, var_pop(b) {over} + 1e-6 AS vb, covar_pop(a, b) {over} AS vab,
         avg((a + b) / 2) {over} AS mean, coalesce(stddev_samp((a + b) / 2) {over}, 0.0) AS std
  FROM e),
d AS (
  SELECT *, sqrt(greatest((vb * x * x - 2.0 * vab * x * y + va * y * y) / (va * vb - vab * vab), 0.0))
            AS mahalanobis_distance FROM m)"""


_OVER = "OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_KNOWN_FIRST = "OVER (PARTITION BY label ORDER BY NOT known, vec_id ROWS UNBOUNDED PRECEDING)"
_DISTANCE = f"SELECT vec_id, mahalanobis_distance > 3.0 AS is_ood, {r('mahalanobis_distance', 'mahalanobis_distance', 4)} FROM d"


def _review_sql(over: str, where: str = "") -> str:
    columns = ", ".join(["vec_id", "record_count", *FLAGS, *[r(m, m, 4) for m in METRICS]])
    return f"""
WITH {_moments_sql(over)},
u AS (SELECT vec_id, unnest(v) AS z FROM e),
w AS (SELECT vec_id, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM u),
h AS (SELECT vec_id, -sum(p * log2(p)) AS entropy, -log2(sum(p * p)) AS renyi_entropy FROM w GROUP BY vec_id),
s AS (
  SELECT d.*, h.* EXCLUDE (vec_id), mahalanobis_distance > 3.0 AS is_ood, n - 1 AS record_count, n - 1 < 3 AS is_cold_start,
         CASE WHEN n < 2 OR std = 0 THEN 0.0 ELSE (flat - mean) / std END AS z_score
  FROM d JOIN h USING (vec_id)),
reviewed AS (
  SELECT *, NOT is_cold_start AND CAST(is_ood AS INT) + CAST(entropy > 4.0 AS INT)
              + CAST(abs(z_score) > 2.5 AS INT) >= 2 AS is_anomalous,
         CASE WHEN is_cold_start THEN 0.5 ELSE 1.0 / (1.0 + 0.1 * least(mahalanobis_distance, 50.0)
              + 0.05 * entropy + 0.2 * abs(z_score)) END AS confidence
  FROM s)
SELECT {columns} FROM reviewed {where}"""


QUERIES = {
    "running_distance_vectors": Query(running_distance_vectors, f"WITH {_moments_sql(_OVER)} {_DISTANCE}"),
    "running_distance_of_earlier": Query(
        running_distance_of_earlier, f"WITH {_moments_sql(_BEFORE)} {_DISTANCE} WHERE n >= 4"
    ),
    "running_distance_wide": Query(running_distance_wide),
    "review_vectors": Query(review_vectors, _review_sql(_OVER)),
    "review_after_store": Query(review_after_store, _review_sql(_KNOWN_FIRST, "WHERE NOT known")),
}
