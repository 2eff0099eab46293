"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of parquet tables, ``BENCH_CPUS`` the local
cores, ``BENCH_QUERIES`` (comma separated) replaces the headline list, ``all``
for every query.  Each query runs once to warm up, then the median of
``BENCH_RUNS`` full runs into the noop sink counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import all_queries  # noqa: E402

HEADLINE = [
    "review",
    "running_zscore",
    "sliding_zscore",
    "running_mahalanobis",
    "cold_start",
    "score_profile",
    "similarity_search",
    "pairwise_divergence",
    "vector_centroid",
    "prediction_stability",
    "random_projection",
    "running_reliability",
    "credible_interval",
    "distribution_overall",
    "value_entropy",
    "upsert_latest",
    "snapshot_diff",
    "suspicious_text",
    "tag_nodes",
    "name_encoding",
    "degrees",
    "pagerank_users",
    "pagerank",
    "count_usages",
    "cyclomatic_complexity",
    "scan_flags",
    "stream_upsert",
    "complexity_vector",
    "source_vectors",
    "latent_factors",
    "line_diff",
    "stream_review",
    "review_by_type",
    "running_reliability_overall",
]


def session(cpus: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-bench-"),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_once(spark: SparkSession, query, sf_dir: str) -> tuple[float, float]:
    """Seconds of the whole run, and of the jobs that ran before its action."""
    start = time.perf_counter()
    found = query.run(spark, sf_dir)
    made = time.perf_counter()
    found.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, made - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    known = all_queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = session(cpus)
    seconds, before = {}, {}
    for name in names:
        run_once(spark, known[name], sf_dir)
        taken = [run_once(spark, known[name], sf_dir) for _ in range(runs)]
        seconds[name], before[name] = (round(statistics.median(part), 3) for part in zip(*taken))
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    result = {
        "metric": "total query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "before_action": before,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
