"""The review of sources from end to end on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.arrays import softmax_entropies, wide_softmax_entropies
from tidemark.functions.hashing import gaussian_weights, random_projection
from tidemark.operators import source_review, symbols
from tidemark.plans.wide import vector_moments
from tidemark.sources.store import VECTOR_SCHEMA

BODIES = ["x = {0}\ny = x + {0}\n", "def f{0}(a):\n    return a * {0}\n", "for i in range({0}):\n    if i:\n        print(i)\n"]
TEXTS = [(f"s{i:02d}", BODIES[i % 3].format(i), i) for i in range(24)]
TEXTS += [("s50", "def broken(:\n", 50), ("s51", None, 51), ("s52", "password = 'hunter-hunter'\neval(x)\n", 52), ("s53", "", 53)]


@pytest.fixture(scope="module")
def vectorised(spark):
    df = spark.createDataFrame(TEXTS, "source_id string, source string, n int")
    return source_review.vectorise(df).cache()


def test_vectors_and_flags(vectorised):
    rows = {r.source_id: r for r in vectorised.collect()}
    assert len(rows) == len(TEXTS)
    assert rows["s50"].embedding is None and rows["s51"].embedding is None
    assert all(len(r.embedding) == 1408 for i, r in rows.items() if i not in ("s50", "s51"))
    assert tuple(rows["s52"].security_flags) == (False, True, True)
    assert tuple(rows["s50"].security_flags) == (False, False, False)


def test_records_equal_numpy(vectorised):
    found = source_review.review_sources(vectorised, ["n"]).orderBy("n").collect()
    rows = vectorised.orderBy("n").select("source_id", "embedding", random_projection(1408, 16, "review")("embedding").alias("p")).collect()
    seen = []
    for record, row in zip(found, rows, strict=True):
        assert record.source_id == row.source_id and record.record_count == len(seen)
        if row.p is None:
            assert record.mahalanobis_distance is None and record.entropy is None
            continue
        seen.append(row.p)
        a = np.array(seen)
        gap = a[-1] - a.mean(axis=0)
        c = (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) / len(a) + 1e-6 * np.eye(16)
        assert record.mahalanobis_distance == pytest.approx(np.sqrt(gap @ np.linalg.solve(c, gap)), abs=1e-6)
        w = np.exp(np.array(row.embedding) - max(row.embedding))
        p = w / w.sum()
        assert record.entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-6)
        assert record.is_cold_start == (len(seen) <= 3)


def test_store_and_history(spark, vectorised):
    first = source_review.review_sources(vectorised.filter("n < 10"), ["n"])
    store = source_review.store_rows(first, F.timestamp_seconds(F.lit(7)))
    assert [(f.name, f.dataType) for f in store.schema] == [
        (f.name, f.dataType) for f in spark.createDataFrame([], VECTOR_SCHEMA).schema
    ]
    row = store.filter("vector_id = 's05'").head()
    record = first.filter("source_id = 's05'").head()
    held = json.loads(row.metadata)
    assert held["mahalanobis"] == pytest.approx(record.mahalanobis_distance) and held["security_flags"]["eval_exec"] is False
    assert row.reliability == 0.5
    after = {r.n: r for r in source_review.review_sources(vectorised.filter("n >= 10"), ["n"], store=store).collect()}
    whole = {r.n: r for r in source_review.review_sources(vectorised, ["n"]).collect()}
    for n, r in after.items():
        assert r.record_count == whole[n].record_count
        if r.mahalanobis_distance is not None:
            assert r.mahalanobis_distance == pytest.approx(whole[n].mahalanobis_distance, abs=1e-6)
            assert r.z_score == pytest.approx(whole[n].z_score, abs=1e-6)
    # the whole vector, too
    wide = source_review.review_sources(vectorised.filter("n < 3"), ["n"], dim=None).orderBy("n").collect()
    assert [round(r.mahalanobis_distance, 2) for r in wide] == pytest.approx([k**0.5 for k in range(3)], abs=0.02)


def test_drift_of_versions(spark):
    base = spark.createDataFrame([(f"{i}.py", BODIES[0].format(i)) for i in range(12)] + [("bad.py", "x = (")], "path string, text string")
    odd = "\n".join(BODIES[2].format(k) + BODIES[1].format(k) for k in range(40))
    changed = F.when(F.col("path") == "3.py", odd).when(F.col("path") == "4.py", F.concat("text", F.lit("\n# same code\n")))
    target = base.withColumn("text", F.coalesce(changed, "text")).filter("path != '5.py'")
    target = target.unionByName(spark.createDataFrame([("new.py", "x = 1")], base.schema))
    found = {r.path: r for r in source_review.source_drift(base, target, "path", "text").collect()}
    assert set(found) == {"3.py", "4.py"}
    assert found["3.py"].drift_detected and found["3.py"].new_distance > 1.5 * found["3.py"].base_distance
    assert not found["4.py"].drift_detected and found["4.py"].new_distance == pytest.approx(found["4.py"].base_distance)


def test_search_by_text(spark, vectorised):
    store = source_review.store_rows(source_review.review_sources(vectorised, ["n"]), F.timestamp_seconds(F.lit(0)))
    asked = spark.createDataFrame([("q1", TEXTS[4][1]), ("q2", "def broken("), ("q3", TEXTS[8][1])], "source_id string, source string")
    found = source_review.search_sources(store, asked, k=3).collect()
    assert {(r.source_id, r["rank"]) for r in found} == {(q, n) for q in ("q1", "q3") for n in (1, 2, 3)}
    best = {r.source_id: r for r in found if r["rank"] == 1}
    assert best["q1"].vector_id == "s04" and best["q1"].similarity == pytest.approx(1.0)
    # sources that differ in numbers only have one vector: the smallest id comes first
    assert best["q3"].vector_id == "s02" and best["q3"].similarity == pytest.approx(1.0)


def test_no_sources(spark):
    none = source_review.vectorise(spark.createDataFrame([], "source_id string, source string, n int"))
    assert source_review.review_sources(none, ["n"]).count() == 0
    assert vector_moments(none.withColumn("v", F.col("embedding")), [], "v").count() == 0


def test_entropies_of_wide_arrays(spark):
    """Whole arrays at a time give what the column expression gives, with its cases."""
    inf = float("inf")
    rows = [None, [], [1.0, None], [1.0, float("nan")], [inf, 1.0], [-inf, 2.0, 1.0], [-inf], [0.0, 40.0], [3.0], [700.0, -700.0, 699.0]]
    rows.append([float(x) for x in np.random.default_rng(3).normal(size=1408)])
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s array<double>").repartition(1)
    found = df.select("i", softmax_entropies("s").alias("a"), wide_softmax_entropies("s").alias("b")).orderBy("i").collect()
    assert sum(r.b.shannon is not None for r in found) == 5
    for r in found:
        one, two = (list(x) if x is not None else [None, None] for x in (r.a, r.b))
        assert [v is None for v in one] == [v is None for v in two]
        assert two == one or two == pytest.approx(one, abs=1e-9)


def test_vectors_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Parsed sources meet their flags before Python sees them, and only what is scored is put in order."""
    texts = [(f"s{i % 20:02d}", None if i == 7 else t, i) for i, (_, t, _) in enumerate(TEXTS)]
    df = spark.createDataFrame(texts[:20], "source_id string, source string, n int")
    rows = source_review.vectorise(df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert "Exchange" not in above and "Join" not in above
    rows.withColumn("dim", F.size("embedding")).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/v")
    # rows of one id, and rows that are alike but for their number
    kept = spark.read.parquet(f"{tmp_path}/v")
    kept = kept.unionByName(kept.filter("n < 6").withColumn("at", F.col("at") - 1_000_000))
    store = source_review.store_rows(source_review.review_sources(kept.filter("n < 4"), ["n"]), F.timestamp_seconds(F.lit(7)))
    for keys in ([], ["source_id"]):
        stored = None if keys else store
        plain = source_review.review_sources(kept, ["n", "at"], keys=keys, store=stored)
        apart = source_review.review_sources(kept, ["n", "at"], keys=keys, store=stored, row_id="at")
        assert apart.columns == plain.columns
        for one, two in zip(plain.orderBy("at").collect(), apart.orderBy("at").collect(), strict=True):
            for a, b in zip(one, two, strict=True):
                assert a == b or a == pytest.approx(b, abs=1e-9)
        plan = apart.select("source_id", "dim", "record_count")._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Join") :]
        left = below[: below.index("MapInArrow")]
        assert "embedding" not in left


def test_slots_are_mapped_once(spark):
    """The map of a source's slots is made once, not once for each of its slots."""
    df = spark.createDataFrame([(1, 0, 0.5), (1, 3, 2.5), (2, 1, -1.0), (2, 9, 7.0)], "doc_id int, slot int, value double")
    found = symbols.slots_to_array(df, "doc_id", 4, "v")
    assert {r.doc_id: r.v for r in found.collect()} == {1: [0.5, 0.0, 0.0, 2.5], 2: [0.0, -1.0, 0.0, 0.0]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(map_from_entries" not in plan


def test_projection_of_odd_vectors(spark):
    rows = [(0, None), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 0.0]), (4, [0.0, None])]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(1)
    found = {r.i: r.p for r in df.select("i", random_projection(2, 3, "odd")("v").alias("p")).collect()}
    kernel, bias = gaussian_weights(2, 3, 0.01, "odd-kernel"), gaussian_weights(1, 3, 0.001, "odd-bias")[0]
    assert found[0] is None and found[2] is None and found[1] == pytest.approx(np.tanh(np.array([1.0, 2.0]) @ kernel + bias))
    assert all(np.isnan(x) for i in (3, 4) for x in found[i])
    with pytest.raises(Exception, match="must have 2 values"):
        df.select(random_projection(2, 3, "odd")(F.array(F.lit(1.0)))).collect()
