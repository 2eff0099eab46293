"""Vector math on ``ARRAY<DOUBLE>`` columns, evaluated inside the JVM; entropies of wide ones in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TINY = 1e-12


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it in ``body``.

    A lambda evaluates everything in its body for each element, so totals and
    maxima of the same array have to be bound outside of it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column | str) -> Column:
    return _col(vector).cast("array<double>")


def total(vector: Column | str) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x)


def vector_mean(vector: Column | str) -> Column:
    return total(vector) / F.size(_col(vector))


def dot(left: Column | str, right: Column | str) -> Column:
    return total(F.zip_with(_col(left), _col(right), lambda a, b: a * b))


def norm(vector: Column | str) -> Column:
    v = _col(vector)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def frobenius_sum(*planes: Column | str) -> Column:
    """Sum of the Frobenius norms of several planes held as flat arrays."""
    first, *rest = [norm(p) for p in planes]
    for n in rest:
        first = first + n
    return first


def l2_distance(left: Column | str, right: Column | str) -> Column:
    """Euclidean distance over the common length of two vectors."""
    gaps = F.zip_with(_col(left), _col(right), lambda a, b: F.coalesce(a - b, F.lit(0.0)))
    return norm(gaps)


def cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine similarity, 0.0 when either vector has no length."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(0.0)


def concat_vectors(*parts: Column | str) -> Column:
    return F.concat(*[doubles(p) for p in parts])


def fit_length(vector: Column | str, length: int) -> Column:
    """Pad with zeros or cut to exactly ``length`` values."""
    padded = F.concat(doubles(vector), F.array_repeat(F.lit(0.0), length))
    return F.slice(padded, 1, length)


def to_rows(vector: Column | str, rows: int, columns: int) -> Column:
    """Reshape a vector to ``rows`` arrays of ``columns`` values."""
    starts = F.sequence(F.lit(1), F.lit(rows * columns), F.lit(columns))

    def cut(fitted: Column) -> Column:
        return F.transform(starts, lambda start: F.slice(fitted, start, F.lit(columns)))

    return let(fit_length(vector, rows * columns), cut)


def softmax(scores: Column | str) -> Column:
    s = _col(scores)

    def scaled(weights: Column) -> Column:
        return let(total(weights), lambda t: F.transform(weights, lambda w: w / t))

    return let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), scaled))


def _normalised(probabilities: Column | str, body: Callable[[Column], Column]) -> Column:
    """Drop values up to 1e-12, rescale the rest to sum to one, then apply ``body``."""

    def rescaled(kept: Column) -> Column:
        return let(total(kept), lambda t: body(F.transform(kept, lambda p: p / t)))

    return let(F.filter(_col(probabilities), lambda p: p > TINY), rescaled)


def shannon_entropy(probabilities: Column | str, base: float = 2.0) -> Column:
    def bits(kept: Column) -> Column:
        nats = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + p * F.log(p))
        return -nats / math.log(base)

    return _normalised(probabilities, bits)


def renyi_entropy(probabilities: Column | str, alpha: float = 2.0, base: float = 2.0) -> Column:
    """Renyi entropy of order ``alpha``; order 1 is the Shannon entropy."""
    if alpha == 1.0:
        return shannon_entropy(probabilities, base)

    def bits(kept: Column) -> Column:
        moment = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + F.pow(p, F.lit(alpha)))
        return F.log(moment) / ((1.0 - alpha) * math.log(base))

    return _normalised(probabilities, bits)


def softmax_entropies(scores: Column | str, base: float = 2.0) -> Column:
    """Shannon and order-2 Renyi entropy of the softmax as ``struct<shannon, renyi_2>``.

    The same values as ``shannon_entropy(softmax(s))`` and ``renyi_entropy``, but
    from the unscaled weights in one pass: with ``z = sum(w)`` they are
    ``ln z - sum(w ln w) / z`` and ``2 ln z - ln sum(w^2)``.
    """
    s = _col(scores)
    unit = math.log(base)

    def entropies(weights: Column) -> Column:
        def add(floor: Column) -> Callable[[Column, Column], Column]:
            def step(acc: Column, w: Column) -> Column:
                kept = F.struct(
                    (acc["z"] + w).alias("z"),
                    (acc["h"] + w * F.log(w)).alias("h"),
                    (acc["q"] + w * w).alias("q"),
                )
                return F.when(w > floor, kept).otherwise(acc)

            return step

        def finish(acc: Column) -> Column:
            log_z = F.log(acc["z"])
            return F.struct(
                ((log_z - acc["h"] / acc["z"]) / unit).alias("shannon"),
                ((2.0 * log_z - F.log(acc["q"])) / unit).alias("renyi_2"),
            )

        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("z", "h", "q")])
        return let(
            total(weights) * TINY, lambda floor: F.aggregate(weights, zero, add(floor), finish)
        )

    return let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), entropies))


@F.arrow_udf(StructType([StructField("shannon", DoubleType()), StructField("renyi_2", DoubleType())]))
def _wide_entropies(scores: pa.Array) -> pa.Array:
    found = [np.full(len(scores), np.nan) for _ in range(2)]
    ends = scores.offsets.to_numpy()
    values = scores.values.to_numpy(zero_copy_only=False)
    valid = scores.is_valid().to_numpy(zero_copy_only=False)
    for k in valid.nonzero()[0]:
        x = values[ends[k] : ends[k + 1]]
        top = x.max() if len(x) else np.nan  # NaN where an entry is NaN or NULL
        if not np.isfinite(top):
            continue
        w = np.exp(x - top)
        w = w[w > w.sum() * TINY]
        log_z = np.log(w.sum())
        found[0][k] = log_z - (w * np.log(w)).sum() / w.sum()
        found[1][k] = 2.0 * log_z - np.log((w * w).sum())
    return pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in found], ["shannon", "renyi_2"])


def wide_softmax_entropies(scores: Column | str, base: float = 2.0) -> Column:
    """``softmax_entropies`` of arrays of doubles with many entries: a task takes whole arrays at a time."""
    unit = math.log(base)
    found = _wide_entropies(_col(scores))
    return F.struct((found["shannon"] / unit).alias("shannon"), (found["renyi_2"] / unit).alias("renyi_2"))


def plane_covariance(planes: list[Column | str], first: int = 64) -> dict[str, Column]:
    """Sample covariances of three planes over their first ``first`` positions.

    Returns the six entries ``c00 c01 c02 c11 c12 c22`` and their ``trace``.
    """
    def centre(plane: Column) -> Column:
        return let(vector_mean(plane), lambda m: F.transform(plane, lambda x: x - m))

    cut = [F.slice(doubles(p), 1, first) for p in planes]
    centred = [centre(p) for p in cut]
    entries = {}
    for i in range(3):
        for j in range(i, 3):
            entries[f"c{i}{j}"] = dot(centred[i], centred[j]) / (F.size(cut[i]) - 1)
    entries["trace"] = entries["c00"] + entries["c11"] + entries["c22"]
    return entries


def symmetric_eigenvalues(c: dict[str, Column]) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix in rising order, in closed form."""
    mid = (c["c00"] + c["c11"] + c["c22"]) / 3
    off = c["c01"] * c["c01"] + c["c02"] * c["c02"] + c["c12"] * c["c12"]
    a, b, d = c["c00"] - mid, c["c11"] - mid, c["c22"] - mid
    spread = F.sqrt((a * a + b * b + d * d + 2 * off) / 6)
    det = (
        a * (b * d - c["c12"] * c["c12"])
        - c["c01"] * (c["c01"] * d - c["c12"] * c["c02"])
        + c["c02"] * (c["c01"] * c["c12"] - b * c["c02"])
    )
    ratio = F.least(F.greatest(det / (2 * spread * spread * spread), F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(ratio) / 3
    high = mid + 2 * spread * F.cos(angle)
    low = mid + 2 * spread * F.cos(angle + 2 * math.pi / 3)
    flat = spread <= 0
    return [
        F.when(flat, mid).otherwise(low),
        F.when(flat, mid).otherwise(3 * mid - high - low),
        F.when(flat, mid).otherwise(high),
    ]
