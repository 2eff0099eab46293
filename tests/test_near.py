"""Pairs within a distance against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import near


def table(spark, seed=1, d=4):
    rng = np.random.default_rng(seed)
    data = np.vstack([rng.normal(size=(150, d)), rng.normal(size=(120, d)) * 0.05 + 2.0, rng.normal(size=(40, d)) * 30])
    data[200:230] = data[199]  # equal vectors
    data[5] = data[4] + np.eye(d)[0] * 0.5  # on the border
    rows = [(1000 - i, None if i % 6 == 0 else f"g{i % 2}", [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(5000, "g0", None), (5001, None, None)]
    return spark.createDataFrame(rows, "id long, _k0 string, v array<double>").repartition(3)


def brute(df, within, keyed):
    least = {}
    for r in df.collect():
        if r.v is not None:
            name = (r["_k0"] if keyed else 0, tuple(r.v))
            least[name] = min(r.id, least.get(name, r.id))
    out = set()
    items = [(k, i, np.array(v)) for (k, v), i in least.items()]
    for k, i, v in items:
        for other, j, w in items:
            if k == other and i < j and np.linalg.norm(v - w) <= within:
                out.add((k, i, j, round(float(np.linalg.norm(v - w)), 9)))
    return out


@pytest.mark.parametrize("within", [0.01, 0.5, 3.0])
@pytest.mark.parametrize("more", [{}, {"pivots": 1, "block_rows": 7}, {"pivots": 2, "block_rows": 40}])
def test_pairs_equal_brute_force(spark, within, more):
    df = table(spark)
    for keys in ([], ["_k0"]):
        found = near.near_pairs(df, "id", "v", within, keys=keys, **more)
        assert found.columns == [*keys, "first_id", "second_id", "divergence"]
        got = [(r["_k0"] if keys else 0, r.first_id, r.second_id, round(r.divergence, 9)) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(df, within, bool(keys))


def test_classes(spark):
    df = table(spark)
    found = near.vector_classes(df, "id", "v").collect()
    assert len(found) == 310
    assert sum(r.representative != r.id for r in found) == 30
    assert {r.representative for r in found if 771 <= r.id <= 801} == {771}


def test_small_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(near, "SLICE", 50)
    df = table(spark)
    found = near.near_pairs(df, "id", "v", 0.5, block_rows=5).collect()
    assert {(r.first_id, r.second_id) for r in found} == {(i, j) for _, i, j, _ in brute(df, 0.5, False)}


def test_odd_tables(spark):
    df = table(spark)
    assert near.near_pairs(df.limit(0), "id", "v", 1.0).count() == 0
    assert near.near_pairs(df.filter("id = 1000"), "id", "v", 1.0).count() == 0
    with pytest.raises(ValueError):
        near.near_pairs(df, "id", "v", 0.0)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="one common length"):
        near.near_pairs(mixed, "id", "v", 1.0).collect()


def test_neighbours_meet_once():
    """A row that visits a neighbouring cell gives its pairs there whichever id is smaller; rows of one cell meet twice."""
    schema = pa.schema([("first_id", pa.int64()), ("second_id", pa.int64()), ("divergence", pa.float64())])
    own = pa.table({"_id": [1, 2, 3], "_v": [[0.0, 0.0], [0.5, 0.0], [9.0, 9.0]]})
    guests = pa.table({"_id": [2, 2], "_v": [[0.0, 0.1], [0.0, 0.1]], "_visits": [True, False]})
    found = near._pairs_of(guests, own, 0, 1.0, schema).to_pydict()
    assert list(zip(found["first_id"], found["second_id"])) == [(1, 2)]
    same_cell = guests.set_column(2, "_visits", pa.array([False, False]))
    assert near._pairs_of(same_cell, own, 0, 1.0, schema).num_rows == 0


def test_blocks_meet_once(spark, monkeypatch):
    """A dense cell is dealt once for each block it has, not for each block of either side, and floats stay floats."""
    kept, dealt = {}, []

    def keep(df, name):
        kept[name] = df.schema
        return df.localCheckpoint()

    meetings = getattr(near, "_meetings", None)
    monkeypatch.setattr(near, "stored", keep)
    if meetings:
        monkeypatch.setattr(near, "_meetings", lambda *given: dealt.append(meetings(*given)) or dealt[-1])
    rng = np.random.default_rng(4)
    data = rng.normal(size=(640, 3)).astype(np.float32) * 0.01
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = near.near_pairs(df, "id", "v", 0.02, pivots=1, block_rows=8).collect()
    want = {(i, j) for i in range(640) for j in range(i) if np.linalg.norm(data[i].astype(float) - data[j].astype(float)) <= 0.02}
    assert {(r.second_id, r.first_id) for r in found} == want and len(found) == len(want)
    assert kept["single-vectors"]["_v"].dataType.elementType.simpleString() == "float"
    # at most 16 blocks of own rows and 16 of visitors in a cell
    assert dealt and dealt[0].count() <= 640 * (16 + 16 + 1 + 16)
