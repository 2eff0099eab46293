"""A stream gives what the table gives."""

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import scoring as queries
from tidemark.operators import scoring
from tidemark.sources.files import source_stream
from tidemark.streaming import batches
from tidemark.streaming.batches import read_batches
from tidemark.streaming.review import stream_review
from tidemark.streaming.upsert import read_store, stream_upsert

METRICS = ["mahalanobis_distance", "z_score", "confidence"]


@pytest.fixture
def slices(spark, sf_dir):
    rows = queries.scored_events(spark, sf_dir)
    cuts = [None, *rows.agg(F.percentile_approx("ts", [0.2, 0.4, 0.6, 0.8])).head()[0], None]
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        part = rows if low is None else rows.filter(F.col("ts") >= F.lit(low))
        parts.append(part if high is None else part.filter(F.col("ts") < F.lit(high)))
    return parts


def summary(df):
    columns = [F.round(F.col(c) + 1e-9, 4).alias(c) for c in METRICS]
    return sorted(tuple(r) for r in df.select("event_id", "record_count", "is_anomalous", *columns).collect())


def run(spark, parts, folder, **options):
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/input")
        stream = source_stream(spark, f"{folder}/input", schema)
        stream_review(
            stream, folder, queries.KEYS, queries.ORDER, queries.FEATURES, "score_array", **options
        ).awaitTermination()
    return read_batches(spark, f"{folder}/scored")


def test_stream_equals_batch_with_snapshots(spark, sf_dir, slices, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "SNAPSHOT_EVERY", 2)
    found = run(spark, slices, str(tmp_path))
    assert summary(found) == summary(queries.review_events(spark, sf_dir))


def test_stream_goes_on_from_stored_vectors(spark, sf_dir, slices, tmp_path):
    known, rest = slices[0], slices[1:3]
    initial = scoring.review_moments(known, queries.KEYS, queries.FEATURES)
    found = run(spark, rest, str(tmp_path), initial=initial)
    expected = queries.review_events(spark, sf_dir)
    last = rest[-1].agg(F.max("ts")).head()[0]
    first = rest[0].agg(F.min("ts")).head()[0]
    expected = expected.filter((F.col("ts") >= F.lit(first)) & (F.col("ts") <= F.lit(last)))
    assert summary(found) == summary(expected)


def test_repeated_batch_counts_once(spark, slices, tmp_path):
    """A batch that runs again after a failure replaces what it wrote."""
    folder = str(tmp_path / "state")
    moments = [scoring.review_moments(p, queries.KEYS, queries.FEATURES) for p in slices[:2]]

    def merge(parts):
        return scoring.merge_review_moments(parts, queries.KEYS, queries.FEATURES)

    batches.write_state(moments[0], folder, 0, merge)
    batches.write_state(moments[1], folder, 1, merge)
    batches.write_state(moments[1], folder, 1, merge)
    merged = merge(batches.state_before(spark, folder, 2))
    expected = slices[0].count() + slices[1].count()
    assert merged.agg(F.sum("_n")).head()[0] == expected


def test_upsert_stream(spark, slices, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "SNAPSHOT_EVERY", 2)
    folder, schema = str(tmp_path), slices[0].schema
    for part in slices:
        part.write.mode("append").parquet(f"{folder}/input")
        stream = source_stream(spark, f"{folder}/input", schema)
        stream_upsert(stream, folder, ["user_id"], queries.ORDER).awaitTermination()
    found = read_store(spark, folder, ["user_id"], queries.ORDER)
    whole = slices[0]
    for part in slices[1:]:
        whole = whole.unionByName(part)
    latest = whole.groupBy("user_id").agg(F.max_by("event_id", F.struct(*queries.ORDER)))
    assert sorted(map(tuple, found.select("user_id", "event_id").collect())) == sorted(map(tuple, latest.collect()))
