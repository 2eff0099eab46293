"""What the physical plans must and must not contain."""

import pytest

from tidemark.catalog import all_queries

QUERIES = all_queries()
EAGER = {"stream_review", "stream_review_keyed", "stream_review_stored", "stream_alerts", "stream_upsert", "stream_upsert_buckets", "source_stream", "pagerank", "pagerank_forward"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairing_of_everything(name, spark, sf_dir):
    text = plan(QUERIES[name].run(spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name", ["review", "running_zscore", "sliding_zscore", "running_mahalanobis", "running_reliability"]
)
def test_one_shuffle(name, spark, sf_dir):
    text = plan(QUERIES[name].run(spark, sf_dir))
    assert text.count("Exchange ") == 1
    assert "hashpartitioning" in text


@pytest.mark.parametrize("name", ["score_profile", "prediction_stability", "random_projection", "metric_status"])
def test_no_shuffle(name, spark, sf_dir):
    assert "Exchange" not in plan(QUERIES[name].run(spark, sf_dir))


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["lookup_by_id"].run(spark, sf_dir))
    assert "EqualTo(vec_id,42)" in text
    text = plan(QUERIES["running_zscore"].run(spark, sf_dir))
    assert "props" not in text and "event_type" not in text


def test_top_k_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"].run(spark, sf_dir))
    assert "WindowGroupLimit" in plan(QUERIES["recent_logs_per_user"].run(spark, sf_dir))
