"""Running scores of whole vectors against numpy, with and without cut keys."""

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tidemark.catalog.wide import QUERIES
from tidemark.operators import scoring
from tidemark.plans import wide
from tidemark.plans.segments import Split

WHOLE = Split(hot_rows=None)
RIDGE = 1e-6


def plain(rows, ridge=RIDGE, include_self=True, prior=()):
    """``{id: (n, distance)}`` by a new solution for every row."""
    out, seen = {}, list(prior)
    for i, x in rows:
        if include_self and x is not None:
            seen.append(x)
        if x is None:
            out[i] = (len(seen), None)
        elif not seen:
            out[i] = (0, None)
        else:
            a = np.array(seen)
            gap = np.array(x) - a.mean(axis=0)
            c = (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) / len(a) + ridge * np.eye(a.shape[1])
            out[i] = (len(seen), float(np.sqrt(max(gap @ np.linalg.solve(c, gap), 0.0))))
        if not include_self and x is not None:
            seen.append(x)
    return out


def made(count, d, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(d, d))
    return (rng.normal(size=(count, d)) @ mixed * scale + rng.normal(size=d)).tolist()


def same(found, expected, rel=1e-6):
    assert set(found) == set(expected)
    for i, (n, far) in expected.items():
        assert found[i][0] == n
        assert found[i][1] == (None if far is None else pytest.approx(far, rel=rel, abs=1e-6))


@pytest.mark.parametrize("d, count, ridge", [(1, 200, 1e-6), (2, 400, 1e-6), (8, 1500, 1e-6), (64, 700, 1e-6), (5, 600, 0.5), (3, 3000, 10.0)])
def test_updates_follow_a_new_inverse(d, count, ridge):
    rows = made(count, d, d)
    for include_self in (True, False):
        state, found = wide.RunningVectors(d, ridge), {}
        for i, x in enumerate(rows):
            x = np.array(x)
            if include_self:
                state.add(x)
            found[i] = (state.n, state.distance(x) if state.n else None)
            if not include_self:
                state.add(x)
        same(found, plain(enumerate(rows), ridge, include_self))
        assert state.flat_mean == pytest.approx(np.mean(rows))
        flat = np.mean(rows, axis=1)
        assert state.flat_m2 == pytest.approx(((flat - flat.mean()) ** 2).sum())


def test_own_profile_is_never_further_than_the_root(spark):
    """With as many features as rows the distance is sqrt(n - 1), whatever the data."""
    state = wide.RunningVectors(64, RIDGE)
    for n, x in enumerate(made(40, 64), 1):
        state.add(np.array(x))
        assert state.distance(np.array(x)) == pytest.approx((n - 1) ** 0.5, abs=1e-3)


def vectors(spark, d=6, count=400):
    rows = made(count, d, 4)
    rows[17], rows[18] = None, [1.0] * (d - 1) + [None]
    rows[19], rows[20] = [float("nan")] * d, []
    rows[21] = rows[22]
    data = [(i, None if i % 9 == 0 else ("hot" if i % 3 else f"k{i % 5}"), x) for i, x in enumerate(rows)]
    return spark.createDataFrame(data, "i long, k string, x array<double>")


def expected_of(df, keys, **more):
    groups, out = {}, {}
    for row in sorted(df.collect(), key=lambda row: row.i):
        bad = not row.x or any(v is None or not np.isfinite(v) for v in row.x)
        groups.setdefault(row.k if keys else 0, []).append((row.i, None if bad else row.x))
    for rows in groups.values():
        out |= plain(rows, **more)
    return out


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("hot_rows", [None, 60, 1])
def test_keys_of_any_size(spark, keys, include_self, hot_rows):
    df = vectors(spark)
    found = wide.running_vectors(
        df, keys, ["i"], "x", ridge=RIDGE, include_self=include_self, split=Split(hot_rows=hot_rows)
    )
    assert found.columns[: len(df.columns)] == df.columns
    got = {row.i: (row["_n"], row["_distance"]) for row in found.collect()}
    same(got, expected_of(df, keys, include_self=include_self))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("hot_rows", [None, 30])
def test_stored_vectors_come_first(spark, keys, hot_rows):
    df, split = vectors(spark), Split(hot_rows=hot_rows)
    prior = wide.vector_moments(df.filter("i < 150"), keys, "x", split=split)
    assert prior.columns == [*keys, *wide.MOMENTS]
    found = wide.running_vectors(df.filter("i >= 150"), keys, ["i"], "x", ridge=RIDGE, prior=prior, split=split)
    got = {row.i: (row["_n"], row["_distance"]) for row in found.collect()}
    whole = expected_of(df, keys)
    same(got, {i: whole[i] for i in got})
    assert len(got) == 250


def test_moments(spark):
    df = vectors(spark)
    for split in (WHOLE, Split(hot_rows=10)):
        for row in wide.vector_moments(df, ["k"], "x", split=split).collect():
            own = [r.x for r in df.collect() if r.k == row.k and r.x and all(v is not None and np.isfinite(v) for v in r.x)]
            a = np.array(own)
            assert row["_n"] == len(a)
            assert np.allclose(row["_mean"], a.mean(axis=0))
            m2 = (a - a.mean(axis=0)).T @ (a - a.mean(axis=0))
            assert np.allclose(row["_m2"], m2[np.triu_indices(6)])


def test_odd_tables(spark):
    df = vectors(spark)
    none = df.filter("1 = 0")
    assert scoring.running_mahalanobis_vectors(none, ["k"], ["i"], "x").count() == 0
    assert wide.vector_moments(none, ["k"], "x").count() == 0
    first = scoring.running_mahalanobis_vectors(df, ["k"], ["i"], "x", include_self=False).collect()
    early = [r for r in first if r.mahalanobis_distance == float("inf")]
    assert len(early) == len({r.k for r in first}) and all(r.is_ood for r in early)
    with pytest.raises(ValueError):
        scoring.running_mahalanobis_vectors(df, ["k"], ["i"], "x", ridge=0.0)
    mixed = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0, 2.0])], df.schema)
    with pytest.raises(Exception, match="one common length"):
        scoring.running_mahalanobis_vectors(mixed, ["k"], ["i"], "x").collect()


def test_wide_query_with_cut_keys(spark, sf_dir, split_everything):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    found = {r.vec_id: r.mahalanobis_distance for r in QUERIES["running_distance_wide"].run(spark, sf_dir).collect()}
    for label in {r.label for r in rows}:
        own = plain([(r.vec_id, [float(v) for v in r.embedding]) for r in rows if r.label == label])
        for i, (_, far) in own.items():
            assert found[i] == pytest.approx(far, abs=2e-4)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_queries_with_cut_keys(name, spark, sf_dir, split_everything):
    assert differences(QUERIES[name].run(spark, sf_dir), connect(sf_dir), QUERIES[name].sql) == []


def test_review_of_vectors_equals_review_of_columns(spark):
    df = vectors(spark, d=2).filter("x is not null").withColumn("s", F.array(F.lit(0.3), F.col("i") / 400))
    df = df.withColumns({"a": F.get("x", F.lit(0)), "b": F.get("x", F.lit(1))}).filter("not isnan(a) and b is not null")
    for more in ({}, {"id_column": "o"}):
        rows = df.withColumn("o", F.col("i") % 7)
        one = scoring.review(rows, ["k"], ["i"], ["a", "b"], "s", **more)
        two = scoring.review_vectors(rows, ["k"], ["i"], "x", "s", **more)
        assert one.columns == two.columns
        left, right = (sorted(map(tuple, d.drop("x").collect()), key=lambda r: r[0]) for d in (one, two))
        for x, y in zip(left, right, strict=True):
            assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
            assert np.allclose([v for v in x if isinstance(v, float)], [v for v in y if isinstance(v, float)], atol=1e-7)
