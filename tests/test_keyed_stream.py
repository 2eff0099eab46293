"""The stream with state per key against the batch operators."""

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tidemark.catalog.streams import QUERIES
from tidemark.operators import scoring
from tidemark.sources.files import source_stream
from tidemark.streaming.keyed import ID, PROVIDER_KEY, X, _initial_rows, stream_review_keyed


@pytest.mark.parametrize("name", ["stream_review_keyed", "stream_review_stored"])
def test_equals_sql(name, spark, sf_dir):
    assert differences(QUERIES[name].run(spark, sf_dir), connect(sf_dir), QUERIES[name].sql) == []


def table(spark, count=240, d=5):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(count):
        x = rng.normal(size=d).tolist()
        x = {30: None, 31: [], 32: [float("inf")] * d, 33: [1.0] * (d - 1) + [None]}.get(i, x)
        key = None if i % 10 == 0 else i % 3
        rows.append((key, f"k{i % 2}", i, 2**60 + i % 11 if i % 7 else None, x, [0.1, float(i % 5)], None if i % 4 else i))
    schema = "_a int, b string, o long, id long, `x y` array<double>, s array<double>, n short"
    return spark.createDataFrame(rows, schema)


def run(spark, df, folder, cuts, **more):
    progress = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        df.filter(f"o >= {low} and o < {high}").orderBy(F.rand(1)).write.mode("append").parquet(f"{folder}/in")
        stream = source_stream(spark, f"{folder}/in", df.schema)
        query = stream_review_keyed(stream, folder, ["_a", "b"], ["o"], "x y", "s", **more)
        query.awaitTermination()
        progress.append(query.lastProgress)
    return spark.read.parquet(f"{folder}/scored"), progress


def same(one, two):
    assert one.columns == two.columns
    left, right = ({r.o: r for r in d.collect()} for d in (one, two))
    assert set(left) == set(right)
    for o, x in left.items():
        for name, u, v in zip(one.columns, x, right[o]):
            if isinstance(u, float) and v is not None:
                assert u == pytest.approx(v, abs=1e-6), (o, name)
            elif not isinstance(u, list):
                assert u == v, (o, name)


def test_equals_the_batch_and_continues(spark, tmp_path):
    df = table(spark)
    before = spark.conf.get(PROVIDER_KEY, None)
    found, _ = run(spark, df, str(tmp_path / "ids"), [0, 60, 61, 150, 240], id_column="id")
    assert spark.conf.get(PROVIDER_KEY, None) == before
    assert found.schema.simpleString().startswith(df.schema.simpleString()[:-1])
    same(found, scoring.review_vectors(df, ["_a", "b"], ["o"], "x y", "s", id_column="id"))


def test_without_ids_every_vector_counts(spark, tmp_path):
    df = table(spark)
    found, _ = run(spark, df, str(tmp_path / "none"), [0, 100, 240])
    same(found, scoring.review_vectors(df, ["_a", "b"], ["o"], "x y", "s"))


def test_stored_vectors_come_first_once(spark, tmp_path):
    df = table(spark)
    known = df.filter("o < 80")
    found, _ = run(spark, df.filter("o >= 80"), str(tmp_path / "stored"), [80, 120, 240], stored=known, id_column="id")
    same(found, scoring.review_vectors(df, ["_a", "b"], ["o"], "x y", "s", id_column="id").filter("o >= 80"))


def test_a_batch_touches_its_own_keys(spark, tmp_path):
    """Many keys are known; a batch of one key writes the state of that key only."""
    rows = spark.range(400).select(
        F.lit(0).alias("_a"), (F.col("id") % 200).cast("string").alias("b"), F.col("id").alias("o"), F.col("id").alias("id"),
        F.array(F.col("id") / 7, F.col("id") % 3 + F.lit(0.5)).alias("x y"), F.array(F.lit(0.5)).alias("s"),
    )
    later = rows.filter("o < 3").withColumns({"b": F.lit("5"), "o": F.col("o") + 400})
    found, progress = run(spark, rows.union(later), str(tmp_path / "own"), [0, 400, 403], id_column="id")
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    # moments, number of ids, and one entry per new id
    assert updated[0] >= 200 * 2 + 400 and updated[1] <= 2 + 3
    assert found.filter("o >= 400").agg(F.min("record_count"), F.max("record_count")).head() == (2, 4)


def test_no_rows(spark, tmp_path):
    df = table(spark)
    found, _ = run(spark, df, str(tmp_path / "empty"), [1000, 1001, 1002])
    assert found.count() == 0


def test_state_starts_from_one_row_per_key(spark):
    """Stored vectors reach the state as moments; different ids come one by one."""
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.array(F.col("id") / 7, F.lit(1.0)).alias(X), (F.col("id") % 12).cast("string").alias(ID))
    assert _initial_rows(rows, ["k"], False).count() == 3
    assert _initial_rows(rows, ["k"], True).count() == 3 + 12
