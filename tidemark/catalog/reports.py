"""Queries over summaries, stores, scans and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import scoring
from tidemark.catalog.common import Query, r, rounded, table
from tidemark.functions.scores import anomaly_vote as vote
from tidemark.operators import hunks, patterns, reports, snapshots
from tidemark.operators.reliability import running_reliability
from tidemark.operators.scoring import running_mahalanobis
from tidemark.session import run_folder
from tidemark.sources import files, store

STATS = ["mean", "median", "std", "min", "max"]


def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.distribution_summary(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])
    return found.select("c_mktsegment", *rounded(*STATS))


def _summary_sql(value: str) -> str:
    return ", ".join(
        [
            r(f"avg({value})", "mean"), r(f"median({value})", "median"), r(f"stddev_pop({value})", "std"),
            r(f"min({value})", "min"), r(f"max({value})", "max"),
        ]
    )


def distribution_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution_summary(table(spark, sf_dir, "events"), "value").select(*rounded(*STATS))


def value_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.value_entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return found.select("user_id", *rounded("entropy"))


VALUE_ENTROPY_SQL = f"""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type),
p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, {r('-sum(p * log2(p + 1e-12))', 'entropy')} FROM p GROUP BY user_id"""


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.review_summary(scoring.review_events(spark, sf_dir))
    return found.select("total", "anomalies", *rounded("avg_confidence"))


REVIEW_SUMMARY_SQL = f"""WITH {scoring.review_ctes()}
SELECT count(*) AS total, count(*) FILTER (is_anomalous) AS anomalies, {r('avg(confidence)', 'avg_confidence')}
FROM reviewed"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = scoring.review_events(spark, sf_dir)
    for name in ("mahalanobis_distance", "entropy", "z_score", "confidence"):
        reviewed = reviewed.withColumn(name, F.col(name) + 1e-9)
    return reports.report_rows(reviewed, "event_id")


REPORT_ROWS_SQL = f"""WITH {scoring.review_ctes()}
SELECT CAST(event_id AS VARCHAR) AS source_id,
       {', '.join(r(m, m, 4) for m in ('mahalanobis_distance', 'entropy', 'z_score', 'confidence'))},
       CASE WHEN is_anomalous THEN 'ANOMALY' ELSE 'NORMAL' END AS status
FROM reviewed"""


def confidence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.confidence_alerts(scoring.review_events(spark, sf_dir))
    return found.select("event_id", "level", "message", "threshold")


CONFIDENCE_ALERTS_SQL = f"""WITH {scoring.review_ctes()}
SELECT event_id, 'ERROR' AS level, 'Confidence dropped to ' || printf('%.4f', confidence) AS message,
       CAST(0.8 AS DOUBLE) AS threshold
FROM reviewed WHERE confidence < 0.8"""


def anomaly_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each combination of votes occurs, and its verdict."""
    reviewed = scoring.review_events(spark, sf_dir)
    votes = {
        "vote_distance": F.col("is_ood"),
        "vote_entropy": F.col("entropy") > 1.9,
        "vote_z": F.abs("z_score") > 1.5,
    }
    rows = reviewed.select(*[c.alias(n) for n, c in votes.items()])
    rows = rows.withColumn("is_anomalous", vote(*[F.col(n) for n in votes]))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))


ANOMALY_VOTE_SQL = f"""WITH {scoring.review_ctes()},
v AS (SELECT is_ood AS vote_distance, entropy > 1.9 AS vote_entropy, abs(z_score) > 1.5 AS vote_z FROM reviewed)
SELECT vote_distance, vote_entropy, vote_z,
       (vote_distance AND vote_entropy) OR (vote_distance AND vote_z) OR (vote_entropy AND vote_z) AS is_anomalous,
       count(*) AS rows
FROM v GROUP BY ALL"""


def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 40).alias("metric")
    )
    found = reports.metric_status(rows, "metric")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "status")


METRIC_STATUS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_discount * 40 < 2.0 THEN 'OK' WHEN l_discount * 40 < 3.0 THEN 'WARN' ELSE 'CRIT' END AS status
FROM lineitem"""


def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    found = reports.recent_logs(rows, ["ts", "event_id"])
    clock = F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 12, 8)
    return found.select("event_id", "event_type", clock.alias("clock"))


RECENT_LOGS_SQL = """
SELECT event_id, event_type, strftime(ts, '%H:%M:%S') AS clock FROM events ORDER BY ts DESC, event_id DESC LIMIT 25"""


def recent_logs_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return reports.recent_logs(rows, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


RECENT_LOGS_PER_USER_SQL = """
SELECT event_id, user_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25"""


def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id")
    found = reports.metric_statistics(rows, "event_type", "value", ["ts", "event_id"])
    return found.select("event_type", "current", *rounded("rolling_mean", "variance"))


METRIC_STATISTICS_SQL = f"""
SELECT event_type, max_by(value, ts) AS current, {r('avg(value)', 'rolling_mean')},
       {r('var_samp(value)', 'variance')}
FROM events GROUP BY event_type"""


def from_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.from_batch(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("source_id", F.md5("source").alias("digest"), F.length("source").alias("chars"))


FROM_BATCH_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS source_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM documents"""


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups open a record per user; every later event replaces it."""
    rows = table(spark, sf_dir, "events")
    existing = rows.filter(F.col("event_type") == "signup")
    updates = rows.filter(F.col("event_type") != "signup")
    found = store.upsert_latest(existing, updates, ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "event_id", "event_type", "value", "props")


UPSERT_LATEST_SQL = """
SELECT user_id, event_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def load_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.load_vectors(spark, f"{sf_dir}/embeddings.parquet")
    values = rows.select("vec_id", "label", F.explode("embedding").alias("x"))
    found = values.groupBy("vec_id", "label").agg(F.sum(F.col("x").cast("double")).alias("total"))
    return found.select("vec_id", "label", *rounded("total"))


LOAD_VECTORS_SQL = f"""
SELECT vec_id, label, {r('sum(CAST(x AS DOUBLE))', 'total')}
FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id, label"""


def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))
    return store.lookup_by_id(rows, "vec_id", 42)


LOOKUP_SQL = "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id = 42"


def parse_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return store.parse_metadata(rows, "props", "k INT")


PARSE_METADATA_SQL = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"


def metadata_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return store.metadata_to_json(rows, ["o_orderstatus", "o_custkey"])


METADATA_TO_JSON_SQL = """
SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}' AS metadata
FROM orders"""


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("price")).alias("customer"),
        ).alias("o"),
    )


def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.flatten_struct(nested_orders(spark, sf_dir))


FLATTEN_STRUCT_SQL = """
SELECT o_orderkey, o_orderstatus AS o_status, o_custkey AS o_customer_key, o_totalprice AS o_customer_price
FROM orders"""


def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability log, appended once for failures and once for successes, and read back."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = running_reliability(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    log = found.withColumn("vector_id", F.col("user_id").cast("string"))
    path = run_folder(spark, "log")
    for failed in (True, False):
        part = log.filter((F.col("event_type") == "error") == failed)
        store.append_log(part.select("vector_id", "old_score", "new_score", "ts"), path)
    return spark.read.parquet(path).select("vector_id", *rounded("old_score", "new_score", digits=9), "ts")


def write_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows written as JSON lines and read back."""
    rows = nested_orders(spark, sf_dir)
    path = run_folder(spark, "json")
    store.write_json(rows, path)
    return store.flatten_struct(spark.read.schema(rows.schema).json(path))


def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows written as flat CSV with a header and read back."""
    rows = nested_orders(spark, sf_dir)
    path = run_folder(spark, "csv")
    store.write_csv(rows, path)
    return spark.read.schema(store.flatten_struct(rows).schema).option("header", True).csv(path)


def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as one file each, then found and read whole."""
    folder = run_folder(spark, "texts")
    texts = table(spark, sf_dir, "benchmark").select("text")
    texts.write.option("maxRecordsPerFile", 1).text(folder)
    found = files.scan_sources(spark, folder, "*.txt")
    body = F.expr("substring(source, 1, length(source) - 1)")
    return found.select(F.md5(body).alias("digest"), F.length(body).alias("chars"))


APPEND_LOG_SQL = f"""
WITH s AS (
  SELECT user_id, ts, event_id,
         (1.0 + count(*) FILTER (event_type <> 'error') OVER w) / CAST(2 + count(*) OVER w AS DOUBLE) AS score
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT CAST(user_id AS VARCHAR) AS vector_id, ts,
       {r('coalesce(lag(score) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.5)', 'old_score', 9)},
       {r('score', 'new_score', 9)} FROM s"""


def suspicious_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in all documents, by pattern and match."""
    wanted = patterns.SECRET_PATTERNS | patterns.TOKEN_PATTERN
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = patterns.suspicious_text(rows, "doc_id", "text", wanted)
    return found.groupBy("doc_id", "pattern", "match").agg(F.count(F.lit(1)).alias("copies"))


def _extract_sql(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, '{name}' AS pattern, unnest(regexp_extract_all(text, '(?i){quoted}')) AS match FROM documents"


_ALL_PATTERNS = patterns.SECRET_PATTERNS | patterns.TOKEN_PATTERN
SUSPICIOUS_TEXT_SQL = f"""
SELECT doc_id, pattern, match, count(*) AS copies
FROM ({' UNION ALL '.join(_extract_sql(n, p) for n, p in _ALL_PATTERNS.items())}) GROUP BY ALL"""


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = patterns.SECRET_PATTERNS | patterns.TOKEN_PATTERN
    found = patterns.text_flags(table(spark, sf_dir, "documents"), "doc_id", "text", wanted)
    return store.flatten_struct(found)


_ANY_SQL = " OR ".join(
    "regexp_matches(text, '(?i){}')".format(p.replace("'", "''")) for p in _ALL_PATTERNS.values()
)
TEXT_FLAGS_SQL = f"""
SELECT doc_id, false AS security_flags_sql_injection, {_ANY_SQL} AS security_flags_hardcoded_secrets,
       false AS security_flags_eval_exec FROM documents"""


def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the tracking and the dangerous functions in every page."""
    names = ["track", *patterns.DANGEROUS_CALLS]
    return patterns.call_counts(table(spark, sf_dir, "pages"), "page_id", "html", names)


CALL_COUNTS_SQL = r"""
SELECT page_id, name, count(*) AS calls
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:^|[^\w.])(track|eval|exec)\s*\(', 1)) AS name FROM pages)
GROUP BY page_id, name"""


def document_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents.

    The base lacks the toxic ones; the target lacks those of low quality and has
    its access tokens masked.
    """
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("doc_id"), F.lit("."), F.col("lang")).alias("path"), "text"
    )
    labels = table(spark, sf_dir, "labels")
    base = hunks.without(rows, labels.filter("toxic = 1").select("doc_id"), "doc_id")
    kept = hunks.without(rows, labels.filter("quality = 0").select("doc_id"), "doc_id")
    masked = F.regexp_replace("text", r'token\s*=\s*"[0-9a-f]{40}"', 'token = "***"')
    return base.select("path", "text"), kept.select("path", masked.alias("text"))


_VERSIONS_SQL = r"""
d AS (SELECT doc_id, doc_id || '.' || lang AS path, text FROM documents),
base AS (SELECT path, text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
target AS (
  SELECT path, regexp_replace(text, 'token\s*=\s*"[0-9a-f]{40}"', 'token = "***"', 'g') AS text
  FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = document_versions(spark, sf_dir)
    found = snapshots.snapshot_diff(base, target, "path", "text", suffix=".en")
    return found.select("path", "change_type", F.md5("new_content").alias("new_digest"))


SNAPSHOT_DIFF_SQL = f"""
WITH {_VERSIONS_SQL}
SELECT path, CASE WHEN b.text IS NULL THEN 'added' WHEN t.text IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
       md5(t.text) AS new_digest
FROM (SELECT * FROM base WHERE path LIKE '%.en') b FULL JOIN (SELECT * FROM target WHERE path LIKE '%.en') t USING (path)
WHERE b.text IS DISTINCT FROM t.text"""


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = document_versions(spark, sf_dir)
    found = snapshots.line_diff(base, target, "path", "text", suffix="")
    return found.select("path", F.md5("line").alias("line_digest"), "copies")


LINE_DIFF_SQL = f"""
WITH {_VERSIONS_SQL},
l AS (
  SELECT path, unnest(string_split(text, chr(10))) AS line, 1 AS s FROM target
  UNION ALL SELECT path, unnest(string_split(text, chr(10))), -1 FROM base)
SELECT path, md5(line) AS line_digest, CAST(sum(s) AS BIGINT) AS copies
FROM l GROUP BY path, line HAVING sum(s) <> 0"""


def line_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines the shortest edit script of every changed text takes out and puts in."""
    base, target = document_versions(spark, sf_dir)
    found = hunks.line_hunks(base, target, "path", "text", suffix="")
    return found.select("path", "hunk", "old_start", "new_start", "place", "op", F.md5("line").alias("line_digest"))


def patched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old texts after their hunks."""
    base, target = document_versions(spark, sf_dir)
    found = hunks.apply_hunks(base, hunks.line_hunks(base, target, "path", "text", suffix=""), "path", "text")
    return found.select("path", F.md5("text").alias("digest"))


PATCHED_TEXTS_SQL = f"""
WITH {_VERSIONS_SQL}
SELECT path, md5(t.text) AS digest FROM base b FULL JOIN target t USING (path) WHERE b.text IS DISTINCT FROM t.text"""


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the widest distance among errors against that among all other events."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    scored = running_mahalanobis(rows, ["user_id"], ["ts", "event_id"], ["value", "k"])

    def widest(part: DataFrame) -> DataFrame:
        return part.groupBy("user_id").agg(F.max("mahalanobis_distance").alias("distance"))

    base = widest(scored.filter(F.col("event_type") != "error"))
    target = widest(scored.filter(F.col("event_type") == "error"))
    found = snapshots.drift(base, target, ["user_id"], "distance")
    return found.select("user_id", "drift_detected", *rounded("base_distance", "new_distance", digits=4))


DRIFT_SQL = f"""WITH {scoring.review_ctes()},
w AS (
  SELECT user_id, max(mahalanobis_distance) FILTER (event_type <> 'error') AS b,
         max(mahalanobis_distance) FILTER (event_type = 'error') AS n
  FROM reviewed GROUP BY user_id)
SELECT user_id, n > b * 1.5 AS drift_detected, {r('b', 'base_distance', 4)}, {r('n', 'new_distance', 4)}
FROM w WHERE b IS NOT NULL AND n IS NOT NULL"""


QUERIES = {
    "distribution_summary": Query(
        distribution_summary,
        f"SELECT c_mktsegment, {_summary_sql('c_acctbal')} FROM customer GROUP BY c_mktsegment",
    ),
    "distribution_overall": Query(distribution_overall, f"SELECT {_summary_sql('value')} FROM events"),
    "value_entropy": Query(value_entropy, VALUE_ENTROPY_SQL),
    "review_summary": Query(review_summary, REVIEW_SUMMARY_SQL),
    "report_rows": Query(report_rows, REPORT_ROWS_SQL),
    "confidence_alerts": Query(confidence_alerts, CONFIDENCE_ALERTS_SQL),
    "anomaly_vote": Query(anomaly_vote, ANOMALY_VOTE_SQL),
    "metric_status": Query(metric_status, METRIC_STATUS_SQL),
    "recent_logs": Query(recent_logs, RECENT_LOGS_SQL),
    "recent_logs_per_user": Query(recent_logs_per_user, RECENT_LOGS_PER_USER_SQL),
    "metric_statistics": Query(metric_statistics, METRIC_STATISTICS_SQL),
    "from_batch": Query(from_batch, FROM_BATCH_SQL),
    "upsert_latest": Query(upsert_latest, UPSERT_LATEST_SQL),
    "load_vectors": Query(load_vectors, LOAD_VECTORS_SQL),
    "lookup_by_id": Query(lookup_by_id, LOOKUP_SQL),
    "parse_metadata": Query(parse_metadata, PARSE_METADATA_SQL),
    "metadata_to_json": Query(metadata_to_json, METADATA_TO_JSON_SQL),
    "flatten_struct": Query(flatten_struct, FLATTEN_STRUCT_SQL),
    "write_json": Query(write_json, FLATTEN_STRUCT_SQL),
    "write_csv": Query(write_csv, FLATTEN_STRUCT_SQL),
    "scan_sources": Query(
        scan_sources, "SELECT md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM benchmark"
    ),
    "append_log": Query(append_log, APPEND_LOG_SQL),
    "suspicious_text": Query(suspicious_text, SUSPICIOUS_TEXT_SQL),
    "text_flags": Query(text_flags, TEXT_FLAGS_SQL),
    "call_counts": Query(call_counts, CALL_COUNTS_SQL),
    "snapshot_diff": Query(snapshot_diff, SNAPSHOT_DIFF_SQL),
    "line_diff": Query(line_diff, LINE_DIFF_SQL),
    "line_hunks": Query(line_hunks),
    "patched_texts": Query(patched_texts, PATCHED_TEXTS_SQL),
    "drift": Query(drift, DRIFT_SQL),
}
