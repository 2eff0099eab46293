"""Exact nearest vectors in parts and from the index, against brute force."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tidemark.operators import similarity

NAMES = {"id_column": "id", "vector": "v"}
ASKED = {"query_id": "q", "query_vector": "w"}


def frames(spark, data, asked):
    store = [(f"v{i:04d}", None if r is None else [float(x) for x in r]) for i, r in enumerate(data)]
    queries = [(i if i else None, None if r is None else [float(x) for x in r]) for i, r in enumerate(asked)]
    return (
        spark.createDataFrame(store, "id string, v array<double>").repartition(4),
        spark.createDataFrame(queries, "q int, w array<double>").repartition(3),
    )


def brute(data, asked, k):
    kept = [i for i, r in enumerate(data) if r is not None]
    whole = np.array([data[i] for i in kept], float).reshape(len(kept), -1)
    norms = np.linalg.norm(whole, axis=1)
    out = []
    for q, vector in enumerate(asked):
        if vector is None or not kept:
            continue
        scale = norms * np.linalg.norm(vector)
        sims = np.round(np.divide(whole @ np.array(vector, float), scale, out=np.zeros(len(kept)), where=scale > 0), 12)
        best = sorted(range(len(kept)), key=lambda j: (-sims[j], kept[j]))[:k]
        out += [(q or None, n + 1, f"v{kept[j]:04d}", round(float(sims[j]), 9) + 0.0) for n, j in enumerate(best)]
    return sorted(out, key=repr)


def plain(found):
    return sorted(((r.q, r["rank"], r.id, round(r.similarity, 9) + 0.0) for r in found.collect()), key=repr)


def clustered(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6)) * 4
    data = list(np.vstack([c + rng.normal(size=(60, 6)) * 0.15 for c in centres]))
    data[100:170] = [data[100]] * 70  # a group of copies over two clusters
    data[5], data[6], data[7] = np.zeros(6), None, np.zeros(6)
    asked = [data[k] for k in range(0, len(data), 20)] + [rng.normal(size=6), np.zeros(6), None, data[100]]
    return data, asked


@pytest.mark.parametrize("k", [1, 7, 200])
@pytest.mark.parametrize("sizes", [{}, {"max_queries": 5, "part_rows": 90}])
def test_search_equals_brute_force(spark, k, sizes):
    data, asked = clustered()
    store, queries = frames(spark, data, asked)
    assert plain(similarity.similarity_search(store, queries, k=k, **NAMES, **ASKED, **sizes)) == brute(data, asked, k)


def test_search_collects_nothing(spark, monkeypatch):
    data, asked = clustered()
    store, queries = frames(spark, data, asked)
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    found = similarity.similarity_search(store, queries, k=3, **NAMES, **ASKED, max_queries=5)
    monkeypatch.undo()
    assert plain(found) == brute(data, asked, 3)


@pytest.mark.parametrize("k, cells, part_rows", [(5, None, 50_000), (5, 12, 25), (100, 12, 50_000), (1000, 3, 100)])
def test_index_equals_brute_force(spark, monkeypatch, k, cells, part_rows):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    data, asked = clustered()
    store, queries = frames(spark, data, asked)
    index = similarity.build_index(store, cells=cells, part_rows=part_rows, **NAMES)
    assert index.sizes.sum() == len(data) - 1 and index.sizes[-1] == 2
    answer = similarity.search_index(index, queries, k=k, **ASKED, max_queries=7)
    assert plain(answer.nearest) == brute(data, asked, k)
    looked = answer.looked.collect()
    assert len(looked) == len(asked) - 1
    share = sum(r.looked for r in looked) / sum(r.cells for r in looked)
    assert share < 0.5 if k == 5 else share <= 1.0


def test_bounds_hold(spark):
    data, asked = clustered()
    store, _ = frames(spark, data, asked)
    index = similarity.build_index(store, cells=9, **NAMES)
    queries = similarity._unit_rows(np.array([a for a in asked if a is not None], float))
    bounds = index.bounds(queries)
    for row in index.rows.collect():
        v = np.array(row["_vec"])
        unit = v / np.linalg.norm(v) if v.any() else v
        assert (queries @ unit <= bounds[:, row["_cell"]] + 1e-12).all()


def test_empty_sides_and_lengths(spark):
    data, asked = clustered()
    store, queries = frames(spark, data, asked)
    for s, q in ((store.limit(0), queries), (store, queries.limit(0)), (store.filter("v is null"), queries)):
        assert similarity.similarity_search(s, q, **NAMES, **ASKED).count() == 0
        answer = similarity.search_index(similarity.build_index(s, **NAMES), q, **ASKED)
        assert answer.nearest.count() == 0
    zeros = store.filter("id in ('v0005', 'v0007')")
    answer = similarity.search_index(similarity.build_index(zeros, **NAMES), queries, **ASKED)
    assert answer.nearest.filter("similarity = 0.0").count() == 2 * (len(asked) - 1)
    short = spark.createDataFrame([(1, [1.0, 2.0])], "q int, w array<double>")
    with pytest.raises(Exception, match="one common length"):
        similarity.similarity_search(store, short, **NAMES, **ASKED).collect()
