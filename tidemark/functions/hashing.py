"""Repeatable hashing, so that vectors of different runs can be compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def name_bucket(name: Column, buckets: int) -> Column:
    """The first 32 bits of md5(name), modulo ``buckets``."""
    bits = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")
    return F.pmod(bits, F.lit(buckets))


def positional_encoding(types: Column, dim: int = 512) -> Column:
    """Value ``sin(0.1 * bucket) * cos(0.05 * i)`` for each of the first ``dim`` types."""

    def value(name: Column, i: Column) -> Column:
        return F.sin(name_bucket(name, dim) * 0.1) * F.cos(i * 0.05)

    return F.transform(F.slice(types, 1, dim), value)


@lru_cache(maxsize=16)
def gaussian_weights(rows: int, columns: int, scale: float, label: str) -> np.ndarray:
    """Normal weights drawn from md5 of ``label:row:column`` (Box-Muller)."""
    digests = [
        hashlib.md5(f"{label}:{i}:{j}".encode()).digest()[:8] for i in range(rows) for j in range(columns)
    ]
    bits = np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, 2)
    u = (bits + 0.5) / 2.0**32
    draws = np.sqrt(-2.0 * np.log(u[:, 0])) * np.cos(2.0 * np.pi * u[:, 1])
    return scale * draws.reshape(rows, columns)


def random_projection(
    dim_in: int, dim_out: int, label: str = "syntax"
) -> Callable[[Column], Column]:
    """``tanh(v K + b)`` with a fixed kernel and bias; vectors must have ``dim_in`` values."""
    kernel = gaussian_weights(dim_in, dim_out, 0.01, f"{label}-kernel")
    bias = gaussian_weights(1, dim_out, 0.001, f"{label}-bias")[0]

    @F.arrow_udf("array<double>")
    def project(vectors: pa.Array) -> pa.Array:
        there = vectors.drop_null()
        if not len(there):
            return pa.nulls(len(vectors), pa.list_(pa.float64()))
        values = there.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        if (there.value_lengths().to_numpy() != dim_in).any():
            raise ValueError(f"vectors must have {dim_in} values")
        found = np.tanh(values.reshape(len(there), dim_in) @ kernel + bias)
        ends = np.append(0, np.cumsum(vectors.is_valid().to_numpy(zero_copy_only=False)) * dim_out)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel()), mask=vectors.is_null())

    return project


def on_vectors(vectors: pd.Series, work: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """Rows of ``work`` on the stacked vectors; NULL for a NULL vector."""
    there = vectors.notna().to_numpy()
    found = [None] * len(vectors)
    if there.any():
        for at, row in zip(there.nonzero()[0], work(np.stack(vectors[there].to_numpy()).astype(np.float64))):
            found[at] = row
    return pd.Series(found, dtype="object")
