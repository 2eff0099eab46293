"""Cutting a key must not change any result, whatever the order column's type, its ties and its NULLs."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, scoring, vectors
from tidemark.operators.graph import pagerank
from tidemark.plans.running import latest_defined, previous_values, running_sums
from tidemark.plans.segments import Split, segment_rows

WHOLE = Split(hot_rows=None)
ORDERS = {
    "text": "concat('id-', lpad(cast(i as string), 5, '0'))",
    "digits": "cast(i * 7 % 300 as string)",
    "time": "timestamp_seconds(1700000000 + i)",
    "ties": "cast(i % 3 as int)",
    "one value": "5",
    "nulls": "if(i % 4 != 0, cast(i as double), null)",
}


def table(spark, order):
    rows = spark.range(600).withColumnRenamed("id", "i")
    key = F.when(F.col("i") % 5 == 0, F.col("i") % 7).otherwise(F.lit(99))
    value = F.when(F.col("i") % 11 != 0, (F.col("i") * 37 % 101).cast("double"))
    return rows.select("i", key.alias("k"), F.expr(ORDERS[order]).alias("o"), value.alias("v"))


def same(one, two, columns=("i",)):
    def plain(df):
        return sorted(
            (tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr
        )

    assert plain(one) == plain(two)


@pytest.mark.parametrize("order", sorted(ORDERS))
@pytest.mark.parametrize("hot_rows", [100, 1])
def test_cut_keys_give_the_same(spark, order, hot_rows):
    df, split = table(spark, order), Split(hot_rows=hot_rows)
    for keys in (["k"], []):
        for run in (
            lambda s: scoring.running_zscore(df, keys, ["o", "i"], "v", split=s),
            lambda s: previous_values(df, keys, ["o", "i"], {"p": F.col("i")}, split=s),
            lambda s: latest_defined(df, keys, ["o", "i"], "last", F.col("v"), split=s),
        ):
            same(run(split), run(WHOLE))


def test_pieces_follow_the_rows(spark):
    df = table(spark, "text")
    cut = segment_rows(df, ["k"], ["o", "i"], Split(hot_rows=1))
    assert cut.where("k = 99").select("_seg").distinct().count() > 256
    # ordered by one single value, the second column cuts
    assert segment_rows(table(spark, "one value"), [], ["o", "i"], Split(hot_rows=50)).select("_seg").distinct().count() > 8
    few = segment_rows(df, ["k"], ["o", "i"], Split(hot_rows=1, most_pieces=10))
    assert few.where("k = 99").select("_seg").distinct().count() <= 10


def test_null_values_count_nowhere(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 4.0)], "i long, v double")
    one = scoring.running_zscore(df, [], ["i"], "v").orderBy("i").collect()
    two = scoring.sliding_zscore(df, [], ["i"], "v", 10).orderBy("i").collect()
    for a, b in zip(one, two):
        assert (a.z_score is None) == (b.z_score is None)
        assert a.z_score is None or abs(a.z_score - b.z_score) < 1e-9
    assert abs(one[3].z_score - 1.0910894511799618) < 1e-9


def test_history_comes_first(spark):
    fields = "i long, k string, x double, y double, s array<double>"
    old = [(10, "a", 1.0, 2.0, [1.0, 2.0]), (11, "a", 2.0, 1.0, [1.0, 2.0])]
    new = [(1, "a", 1.5, 1.5, [1.0, 2.0]), (2, "a", 9.0, 9.0, [1.0, 2.0])]
    both = scoring.seed_baseline(spark.createDataFrame(new, fields), spark.createDataFrame(old, fields))
    found = scoring.review(both, ["k"], [scoring.BEFORE, "i"], ["x", "y"], "s").where("not is_baseline")
    assert [r.record_count for r in found.orderBy("i").collect()] == [2, 3]


def test_prior_and_ids_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 1.0, [1.0])], "i long, k string, x double, s array<double>")
    prior = scoring.review_moments(df, ["k"], ["x"])
    with pytest.raises(ValueError):
        scoring.review(df, ["k"], ["i"], ["x"], "s", id_column="i", prior=prior)


def test_divergence_ignores_a_shared_offset(spark):
    rows = [(j, [1e8 + j, 1e8]) for j in range(5)]
    df = spark.createDataFrame(rows, "i long, v array<double>").withColumn("k", F.lit("a"))
    found = vectors.group_divergence(df, ["k"], "i", "v")
    for r in found.collect():
        right = (sum((r.i - j) ** 2 for j in range(5)) / 4) ** 0.5
        assert abs(r.rms_divergence - right) < 1e-6


def test_null_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [2.0, 1.0]), (3, [3.0, 5.0]), (4, [None, 1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>").coalesce(1)
    fitted = profile.fit_profile(df, "v")
    assert fitted.count == 3
    found = {r.i: r.mahalanobis_distance for r in profile.score_profile(df, "v", fitted).collect()}
    assert found[1] is None and found[0] > 0
    factors = {r.i: r.factors for r in profile.latent_factors(df, "v", 1)[0].collect()}
    assert factors[1] is None and len(factors[0]) == 1


def test_null_graph_keys_are_no_graph(spark):
    edges = spark.createDataFrame([("g", 1, 2), (None, 1, 2), ("g", None, 2)], "g string, source long, target long")
    nodes = spark.createDataFrame([("g", 1), ("g", 2), (None, 1), ("g", None)], "g string, node long")
    ways = [{(r.g, r.node): r.rank for r in pagerank(edges, nodes, ["g"], small_graph=n).collect()} for n in (100, 1)]
    assert ways[0].keys() == ways[1].keys() == {("g", 1), ("g", 2)}
    assert all(abs(ways[0][k] - ways[1][k]) < 1e-9 for k in ways[0])
