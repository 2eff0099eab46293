"""Small hand-computed values and bounds."""

import math
import random
import statistics
from collections import defaultdict
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, beta, scores
from tidemark.functions.hashing import gaussian_weights
from tidemark.functions.images import double_image
from tidemark.operators import profile, reliability, reports, scoring, similarity, vectors
from tidemark.plans.segments import DEFAULT_SPLIT, Split


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_entropies(spark):
    p = vec(0.5, 0.25, 0.25)
    assert one(spark, arrays.shannon_entropy(p)) == pytest.approx(1.5)
    assert one(spark, arrays.renyi_entropy(p)) == pytest.approx(1.415037, abs=1e-6)
    assert one(spark, arrays.renyi_entropy(p, 1.0)) == pytest.approx(1.5)
    # tiny probabilities are dropped and the rest is rescaled
    assert one(spark, arrays.shannon_entropy(vec(1.0, 1.0, 1e-13))) == pytest.approx(1.0)


def test_entropy_bounds(spark):
    random.seed(5)
    rows = [([random.gauss(0, 3) for _ in range(n)],) for n in range(2, 12)]
    df = spark.createDataFrame(rows, "s array<double>")
    found = scoring.prediction_stability(df, "s").collect()
    for row in found:
        assert 0 <= row.renyi_entropy <= row.entropy + 1e-9 <= math.log2(len(row.s)) + 2e-9


def test_softmax_is_stable_for_large_scores(spark):
    assert one(spark, arrays.softmax(vec(1000, 1000))) == pytest.approx([0.5, 0.5])


def test_vectors(spark):
    assert one(spark, arrays.cosine(vec(0, 0), vec(1, 2))) == 0.0
    assert one(spark, arrays.cosine(vec(2, 0), vec(5, 0))) == pytest.approx(1.0)
    # common length only
    assert one(spark, arrays.l2_distance(vec(3, 4, 9), vec(0, 0))) == pytest.approx(5.0)
    assert one(spark, arrays.fit_length(vec(1, 2, 3), 2)) == [1.0, 2.0]
    assert one(spark, arrays.fit_length(vec(1), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, arrays.to_rows(vec(1, 2, 3), 2, 2)) == [[1.0, 2.0], [3.0, 0.0]]
    assert one(spark, arrays.frobenius_sum(vec(3, 4), vec(0, 2))) == pytest.approx(7.0)


def test_plane_eigenvalues_equal_numpy(spark):
    rng = np.random.default_rng(1)
    planes = rng.normal(size=(3, 70))
    columns = [vec(*row) for row in planes]
    entries = arrays.plane_covariance(columns)
    expected = np.cov(planes[:, :64])
    assert one(spark, entries["trace"]) == pytest.approx(np.trace(expected))
    df = spark.range(1).select(*[c.alias(n) for n, c in entries.items()])
    got = df.select(F.array(*arrays.symmetric_eigenvalues({n: F.col(n) for n in entries}))).head()[0]
    assert got == pytest.approx(np.linalg.eigvalsh(expected))
    flat = {n: F.lit(2.0 if n in ("c00", "c11", "c22") else 0.0) for n in entries}
    assert one(spark, F.array(*arrays.symmetric_eigenvalues(flat))) == [2.0, 2.0, 2.0]


def test_scores(spark):
    assert one(spark, scores.confidence(F.lit(2.0), F.lit(3.0), F.lit(1.0))) == pytest.approx(0.645161, abs=1e-6)
    # distances count up to 50, infinity included
    capped = one(spark, scores.confidence(F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))
    assert capped == pytest.approx(1 / 6)
    votes = [((True, False, False), False), ((True, True, False), True), ((False, True, True), True),
             ((None, True, True), True), ((None, True, False), False)]
    for vote, expected in votes:
        assert one(spark, scores.anomaly_vote(*[F.lit(v).cast("boolean") for v in vote])) is expected
    for value, word in [(1.99, "OK"), (2.0, "WARN"), (2.99, "WARN"), (3.0, "CRIT")]:
        assert one(spark, scores.metric_status(F.lit(value))) == word


# recorded: distance, entropy, z-score, confidence of three reviews
RECORDED = [
    (2.8284199093547255, 3.1746685161026216, -0.4338776960534691, 0.654299980057634),
    (2.999987845463496, 3.0478785203364995, 1.2356126171475932, 0.5884030810660561),
    (3.1622646340785936, 3.2637827121733642, 1.8348708643121316, 0.5415974542484404),
]


def test_recorded_confidences(spark):
    df = spark.createDataFrame(RECORDED, "d double, h double, z double, c double")
    got = df.select(scores.confidence(F.col("d"), F.col("h"), F.col("z")), "c").collect()
    assert all(a == b for a, b in got)
    for n, row in zip((9, 10, 11), RECORDED):
        assert row[0] == pytest.approx(math.sqrt(n - 1), abs=3e-5)


def stream(spark, values, key="a"):
    rows = [(key, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, i int, v double")


def test_running_zscore_values(spark):
    got = scoring.running_zscore(stream(spark, [1, 2, 3, 4]), ["k"], ["i"], "v").orderBy("i").collect()
    assert [r.z_score for r in got] == pytest.approx([0, 0.707107, 1.0, 1.161895], abs=1e-6)
    assert [r["mean"] for r in got] == pytest.approx([1, 1.5, 2, 2.5])
    assert [r["std"] for r in got] == pytest.approx([0, 0.707107, 1, 1.290994], abs=1e-6)


def test_zscore_edge_cases(spark):
    flat = scoring.running_zscore(stream(spark, [0.1] * 30), ["k"], ["i"], "v")
    assert {r.z_score for r in flat.collect()} == {0.0}
    lone = scoring.running_zscore(stream(spark, [7]), ["k"], ["i"], "v").head()
    assert (lone.z_score, lone["mean"], lone["std"]) == (0.0, 7.0, 0.0)
    first = scoring.running_zscore(stream(spark, [7, 9]), ["k"], ["i"], "v", include_self=False)
    assert [r.z_score for r in first.orderBy("i").collect()] == [0.0, 0.0]
    assert scoring.running_zscore(stream(spark, [1]).limit(0), ["k"], ["i"], "v").count() == 0


def test_self_inclusive_bounds(spark):
    random.seed(3)
    values = [random.gauss(0, 1) for _ in range(40)] + [500.0]
    got = scoring.running_zscore(stream(spark, values), ["k"], ["i"], "v").orderBy("i").collect()
    for n, row in enumerate(got, start=1):
        assert abs(row.z_score) <= (n - 1) / math.sqrt(n) + 1e-9
    rows = [(0, i, *[random.gauss(0, 1) for _ in range(6)]) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double, c double, d double, e double, f double")
    got = scoring.running_mahalanobis(df, ["k"], ["i"], list("abcdef")).orderBy("i").collect()
    # six dimensions hold seven affinely independent points: the distance says nothing
    for n, row in enumerate(got, start=1):
        assert row.mahalanobis_distance == pytest.approx(math.sqrt(n - 1), abs=1e-3)
        assert not row.is_ood


@pytest.mark.parametrize("features", [["a"], ["a", "b"], ["a", "b", "c"]])
@pytest.mark.parametrize("hot_rows", [None, 10])
def test_running_mahalanobis_equals_numpy(spark, features, hot_rows):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [100, -3, 0]
    df = spark.createDataFrame([(0, i, *map(float, row)) for i, row in enumerate(data)], "k int, i int, a double, b double, c double")
    got = scoring.running_mahalanobis(df, ["k"], ["i"], features, min_samples=3, split=Split(hot_rows=hot_rows))
    got = got.orderBy("i").collect()
    x = data[:, : len(features)]
    assert [got[i].mahalanobis_distance for i in range(2)] == [math.inf] * 2
    for n in range(3, 61):
        seen = x[:n]
        cov = np.cov(seen.T, bias=True).reshape(len(features), -1) + 1e-6 * np.eye(len(features))
        gap = seen[-1] - seen.mean(axis=0)
        expected = math.sqrt(gap @ np.linalg.inv(cov) @ gap)
        assert got[n - 1].mahalanobis_distance == pytest.approx(expected, rel=1e-6)


def test_profile_equals_numpy(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 4
    data[:, 4] = 1.5  # a constant feature
    df = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(data)], "i int, v array<double>")
    fitted = profile.fit_profile(df, "v")
    cov = np.cov(data.T, bias=True) + 1e-6 * np.eye(5)
    assert fitted.mean == pytest.approx(data.mean(axis=0))
    assert np.allclose(fitted.covariance, cov, atol=1e-10)
    values = np.linalg.eigvalsh(cov)
    assert fitted.condition == pytest.approx(values.max() / (values.min() + 1e-12), rel=1e-4)
    got = profile.score_profile(df, "v", fitted).orderBy("i").collect()
    gaps = data - data.mean(axis=0)
    expected = np.sqrt(np.einsum("ni,ij,nj->n", gaps, np.linalg.inv(cov), gaps))
    assert [r.mahalanobis_distance for r in got] == pytest.approx(list(expected), rel=1e-6)
    factors, singular = profile.latent_factors(df, "v", 3)
    _, s, vt = np.linalg.svd(data, full_matrices=False)
    assert list(singular) == pytest.approx(list(s[:3]))
    us = np.array([r.factors for r in factors.orderBy("i").collect()])
    assert np.allclose(np.abs(us), np.abs(data @ vt[:3].T), atol=1e-6)


def test_profile_of_one_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert profile.score_profile(df, "v", profile.fit_profile(df, "v")).head().mahalanobis_distance == 0.0
    with pytest.raises(ValueError):
        profile.fit_profile(df.limit(0), "v")


def test_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 8))
    data[50:150] = data[7]  # a group of copies
    data[3] = 0.0
    asked = np.vstack([rng.normal(size=(6, 8)), data[7]])
    store = spark.createDataFrame([(f"v{i:03d}", list(map(float, r))) for i, r in enumerate(data)], "id string, v array<double>")
    queries = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(asked)], "q int, w array<double>")

    def search(**options):
        found = similarity.similarity_search(
            store.repartition(5), queries, id_column="id", vector="v", query_id="q", query_vector="w", k=9, **options
        )
        return sorted((r.q, r["rank"], r.id, round(r.similarity, 9)) for r in found.collect())

    got = search()
    norms = np.linalg.norm(data, axis=1)
    for q, vector in enumerate(asked):
        dots = data @ vector
        sims = np.divide(dots, norms * np.linalg.norm(vector), out=np.zeros(len(data)), where=norms > 0)
        best = sorted(range(len(data)), key=lambda i: (-round(sims[i], 12), i))[:9]
        expected = [(q, n + 1, f"v{i:03d}", round(float(sims[i]), 9)) for n, i in enumerate(best)]
        assert [row for row in got if row[0] == q] == expected
    # more queries than travel at once: several passes, same result
    assert search(max_queries=3) == got


def test_divergence(spark):
    rows = [(i, "g", [float(i), 2.0 * i]) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, g string, v array<double>")
    got = {r.i: r.rms_divergence for r in vectors.group_divergence(df, ["g"], "i", "v").collect()}
    for i, _, x in rows:
        squares = [math.dist(x, y) ** 2 for j, _, y in rows if j != i]
        assert got[i] == pytest.approx(math.sqrt(sum(squares) / 5))
    row = vectors.divergence_row(df, "v", [0.0, 0.0]).orderBy("i").collect()
    assert row[3].divergence == pytest.approx(math.hypot(3, 6))
    ragged = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0])], "g int, v array<double>")
    assert vectors.vector_centroid(ragged, ["g"], "v").head().centroid == [2.0, 1.5]


def exact_beta_cdf(x, a, b):
    n = a + b - 1
    return sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))


def test_beta(spark):
    rows = [(True,)] * 3 + [(False,)]
    df = spark.createDataFrame(rows, "ok boolean")
    scored = reliability.reliability(df, [], F.col("ok"))
    got = scored.head()
    assert (got.alpha, got.beta) == (4.0, 2.0)
    assert got.score == pytest.approx(0.666667, abs=1e-6)
    assert got.variance == pytest.approx(0.031746, abs=1e-6)


def test_quantiles_against_closed_forms(spark):
    levels = [0.001, 0.025, 0.5, 0.975]
    whole, many = [(1, 1), (4, 2), (1, 30), (200, 3)], [1, 3, 40, 5000, 10**9]
    counts = whole + [(1, n) for n in many] + [(n, 1) for n in many] + [(6 * 10**8, 4 * 10**8), (0.5, 0.5), (None, 2)]
    df = spark.createDataFrame([(None if a is None else float(a), float(b)) for a, b in counts], "a double, b double")
    rows = df.select("a", "b", beta.beta_quantiles(F.col("a"), F.col("b"), levels).alias("q")).collect()
    got = {(r.a, r.b): r.q for r in rows}
    assert set(got[(None, 2)] or [None]) == {None}
    for a, b in whole:
        assert [exact_beta_cdf(x, a, b) for x in got[(a, b)]] == pytest.approx(levels, abs=1e-11)
    for n in many:
        assert got[(1, n)] == pytest.approx([-math.expm1(math.log1p(-p) / n) for p in levels], rel=1e-10)
        assert got[(n, 1)] == pytest.approx([p ** (1 / n) for p in levels], rel=1e-10)
    # a billion outcomes are nearly normal; the arcsine law
    sd = math.sqrt(0.24 / 1e9)
    assert got[(6e8, 4e8)][1::2] == pytest.approx([0.6 - 1.959964 * sd, 0.6 + 1.959964 * sd], abs=1e-4 * sd)
    assert got[(0.5, 0.5)] == pytest.approx([math.sin(math.pi * p / 2) ** 2 for p in levels], abs=1e-11)


def test_both_ways_of_the_integral_meet(spark):
    points = [(x, c) for x in (0.48, 0.5, 0.51) for c in (1000.0, 1001.0)]
    df = spark.createDataFrame(points, "x double, c double")
    for r in df.withColumn("mass", beta.beta_cdf(F.col("x"), F.col("c"), F.col("c"))).collect():
        c, x = int(r.c), Decimal(r.x)
        with localcontext(prec=40):
            terms = (math.comb(2 * c - 1, j) * x**j * (1 - x) ** (2 * c - 1 - j) for j in range(c, 2 * c))
            assert r.mass == pytest.approx(float(sum(terms)), abs=1e-11)


def test_images_keep_order(spark):
    rng = np.random.default_rng(5)
    edges = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 1 - 2.0**-53]
    values = edges + rng.integers(0, 2**64, 3000, dtype=np.uint64).view(np.float64).tolist()
    values += [2.0**k * (1 - 2.0**-53) for k in range(-1000, 1000, 13)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for row in df.select("v", double_image(F.col("v")).alias("i")).collect():
        if row.v is None:
            assert row.i is None
        elif math.isnan(row.v):
            assert row.i == 2047 * 2**52 + 1
        else:
            bits = int(np.array(abs(row.v)).view(np.int64))
            assert row.i == (-bits if row.v < 0 else bits)


@pytest.mark.parametrize("kind", ["float", "decimal(15,2)", "decimal(30,2)"])
def test_medians_by_selection(spark, kind):
    rng = np.random.default_rng(6)
    made = [rng.normal(0, 1e5, 700), rng.integers(-4, 5, 900) * 1.0, rng.random(400) * 1e-3]
    rows = [(k, float(v)) for k, n in (("a", 901), ("b", 500), (None, 500)) for v in rng.choice(np.concatenate(made), n)]
    rows += [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").select("k", F.col("v").cast(kind).alias("v"))
    values = defaultdict(list)
    for row in df.collect():
        if row.v is not None:
            values[row.k].append(float(row.v))
    split = Split(hot_rows=200) if kind == "float" else DEFAULT_SPLIT
    got = {r.k: float(r["median"]) for r in reports.distribution_summary(df, "v", ["k"], split=split).collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in values.items()}, rel=1e-12)


def test_median_without_keys(spark):
    values = np.random.default_rng(7).normal(0, 1e5, 800).tolist() + [math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert reports.distribution_summary(df, "v").head()["median"] == statistics.median(values)


def test_summary_edges(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert reports.distribution_summary(none, "v").count() == 0
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", 2.0), ("b", 2.0), ("b", 9.0)], "k string, v double")
    got = {r.k: (r["mean"], r["median"], r["std"], r["min"], r["max"]) for r in reports.distribution_summary(df, "v", ["k"]).collect()}
    assert got["a"] == (2.5, 2.5, 1.5, 1.0, 4.0)
    assert got["b"][1] == 2.0
    empty = spark.createDataFrame([], "is_anomalous boolean, confidence double")
    assert tuple(reports.review_summary(empty).head()) == (0, 0, 0.0)


def test_report_rows_fill_gaps(spark):
    df = spark.createDataFrame([(None, None, True), ("m", 0.123456, None)], "source_id string, confidence double, is_anomalous boolean")
    got = sorted(tuple(r) for r in reports.report_rows(df, "source_id").collect())
    assert got == [("N/A", 0.0, 0.0, 0.0, 0.0, "ANOMALY"), ("m", 0.0, 0.0, 0.0, 0.1235, "NORMAL")]


def test_baseline_or_store(spark):
    batch, base, kept = (stream(spark, [1, 2], k) for k in ("batch", "base", "kept"))
    seeded = scoring.seed_baseline(batch, base, kept.limit(0))
    assert {r.k for r in seeded.filter("is_baseline").collect()} == {"base"}
    seeded = scoring.seed_baseline(batch, base, kept)
    assert {r.k for r in seeded.filter("is_baseline").collect()} == {"kept"}


def test_weights_are_repeatable():
    a = gaussian_weights(64, 32, 1.0, "x")
    assert np.array_equal(a, gaussian_weights.__wrapped__(64, 32, 1.0, "x"))
    assert abs(a.mean()) < 0.1 and abs(a.std() - 1) < 0.1
