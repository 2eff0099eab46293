"""Stored tables of repeating values: small files, many rows.  Spark must not plan to send them through the driver."""

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import source_flow, structure
from tidemark.operators import features, patterns, source_review
from tidemark.sources.nodes import source_nodes


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def sf(spark, tmp_path):
    kinds = F.array(*[F.lit(k) for k in structure.SOURCES])
    rows = spark.range(40).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey"),
        (F.col("id") - 10).cast("double").alias("c_acctbal"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("c_mktsegment"),
    )
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_nodes_are_not_broadcast(spark, sf):
    assert "BroadcastHashJoin" not in plan(structure.subtree_calls(spark, sf))
    nodes = structure.customer_nodes(spark, sf)
    assert "BroadcastHashJoin" not in plan(features.complexity_vector(nodes))
    assert "BroadcastHashJoin" not in plan(features.symbol_vector(nodes))


def test_sources_are_not_broadcast(spark, sf, monkeypatch):
    seen = []

    def keep(df, name):
        seen.append((name, plan(df)))
        return df.localCheckpoint()

    monkeypatch.setattr(source_flow, "stored", keep)
    source_flow._vectorised(spark, sf)
    # the sources beside their texts, and the parts of their vectors
    assert [name for name, _ in seen] == ["vectorised"] and "BroadcastHashJoin" not in seen[0][1]
    texts = structure.customer_sources(spark, sf)
    nodes = structure.customer_nodes(spark, sf)
    assert "BroadcastHashJoin" not in plan(patterns.scan_flags(texts, nodes))


def test_the_hint_changes_no_value(spark, sf):
    texts = structure.customer_sources(spark, sf)
    plain = features.source_vectors(source_nodes(texts), iterations=5)
    hinted = features.source_vectors(structure.customer_nodes(spark, sf), iterations=5)
    one, two = ({r.doc_id: r.embedding for r in d.collect()} for d in (plain, hinted))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    rows = texts.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source"))
    found = source_review.vectorise(rows).collect()
    assert len(found) == 40 and sum(r.embedding is not None for r in found) == len(one)
