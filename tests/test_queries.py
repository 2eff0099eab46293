"""Every registered query against its SQL in DuckDB; the ordered ones also with hot keys cut."""

import pytest
from compare import connect, differences

from tidemark.catalog import all_queries

QUERIES = all_queries()
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in QUERIES.items() if not q.sql)
SPLIT = [
    "running_zscore", "zscore_of_earlier", "sliding_zscore", "running_mahalanobis", "cold_start",
    "review", "review_by_type", "step_divergence", "pairwise_divergence", "running_reliability",
    "running_reliability_overall", "distribution_summary", "distribution_overall", "value_entropy",
    "resolve_symbol", "flow_edges", "stream_review",
]


# the smallest tables hold no match
LARGER = {"suspicious_text": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(name, spark, sf_dir, duck):
    query = QUERIES[name]
    if name in LARGER:
        sf_dir, duck = LARGER[name], connect(LARGER[name])
    assert differences(query.run(spark, sf_dir), duck, query.sql) == []


@pytest.mark.parametrize("name", SPLIT)
def test_equals_sql_with_hot_keys(name, spark, sf_dir, duck, split_everything):
    query = QUERIES[name]
    assert differences(query.run(spark, sf_dir), duck, query.sql) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(name, spark, sf_dir):
    assert QUERIES[name].run(spark, sf_dir).count() > 0


def test_entry_file():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
