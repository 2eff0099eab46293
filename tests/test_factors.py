"""Singular values and factors of a tall table by merged triangles."""

import numpy as np
import pytest

from tidemark.operators import profile


def frame(spark, data, parts):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(data)], "i long, v array<double>").repartition(parts)


@pytest.mark.parametrize("rows, d, parts, fan", [(300, 6, 40, 3), (5, 8, 3, 16), (1, 4, 1, 16), (64, 64, 9, 2)])
def test_equals_numpy(spark, monkeypatch, rows, d, parts, fan):
    monkeypatch.setattr(profile, "FAN", fan)
    data = np.random.default_rng(rows).normal(size=(rows, d)) * np.logspace(0, -5, d)
    found, singular = profile.latent_factors(frame(spark, data, parts), "v", d)
    u, s, vt = np.linalg.svd(data)
    assert np.allclose(singular[: len(s)], s, rtol=1e-10)
    us = np.array([r.factors for r in found.orderBy("i").collect()])
    # columns up to sign
    assert np.allclose(np.abs(us)[:, : len(s)], np.abs(data @ vt[: len(s)].T), atol=1e-9)
    assert np.allclose(np.linalg.norm(us, axis=1), np.linalg.norm(data, axis=1))


def test_small_singular_values_survive(spark):
    """1e-10 of the largest: its square is below what a Gram matrix in doubles can tell from zero."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(200, 5)))
    w, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    wanted = np.array([1e3, 1.0, 1e-3, 1e-5, 1e-7])
    _, singular = profile.latent_factors(frame(spark, q * wanted @ w, 7), "v", 5)
    assert np.allclose(singular, wanted, rtol=1e-4)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0])], "i int, v array<double>")
    found, singular = profile.latent_factors(df.filter("i != 3"), "v", 2)
    assert singular == pytest.approx([5.0, 0.0])
    assert {r.i: r.factors is None for r in found.collect()} == {1: False, 2: True, 4: False}
    assert profile.tall_triangle(df, "v").shape[1] == 2
    with pytest.raises(ValueError):
        profile.latent_factors(df.limit(0), "v", 1)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema).coalesce(1)
    with pytest.raises(Exception, match="one common length"):
        profile.latent_factors(mixed, "v", 1)
