"""Running moments of wide vectors, row by row, with memory for one matrix per task.

A running covariance of ``d`` features as window columns takes ``d (d + 1) / 2`` of them,
and a new inverse for every row ``d`` to the third steps.  Here the rows of a key (of one
segment of a hot key) pass through a task in order, and ``RunningVectors`` keeps mean,
centred products and an inverse that follows them by rank-one updates: ``d * d`` steps a row.
What a segment has to know of the earlier ones, or of stored vectors, arrives as one row of
moments that sorts before the segment's own rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.functions.arrays import doubles
from tidemark.plans.joins import SALT, find_hot, spread_rows
from tidemark.plans.segments import DEFAULT_SPLIT, SEG, Split, group_columns, join_keys, segment_rows

#: Number, mean and upper triangle of the centred products.
MOMENTS = ["_n", "_mean", "_m2"]
MOMENT_FIELDS = [
    StructField("_n", DoubleType()),
    StructField("_mean", ArrayType(DoubleType())),
    StructField("_m2", ArrayType(DoubleType())),
]
#: 0 for a row of moments, 1 for a row of the table.
KIND = "_kind"
X = "_x"
#: The inverse is taken anew after so many rank-one updates per feature, and before the number of
#: rows has grown by a share of one in ``GROWTH``.
UPDATES, GROWTH = 4, 8
#: A series ends when its terms are below this share of the sum.
ENOUGH = 1e-16


class RunningVectors:
    """Mean and centred products of the vectors so far, and the distance of a vector from them."""

    def __init__(self, d: int, ridge: float, n: float = 0.0, mean: np.ndarray | None = None, m2: np.ndarray | None = None):
        self.ridge, self.n = ridge, float(n)
        self.mean = np.zeros(d) if mean is None else np.array(mean, float)
        self.products = np.zeros((d, d))
        if m2 is not None:
            upper = np.triu_indices(d)
            self.products[upper] = m2
            self.products.T[upper] = m2
        self.flat_m2 = float(self.products.sum()) / (d * d)
        self.inverse: np.ndarray | None = None
        self.base, self.updates = 0.0, 0

    def packed(self) -> tuple[float, np.ndarray, np.ndarray]:
        return self.n, self.mean, self.products[np.triu_indices(len(self.mean))]

    @property
    def flat_mean(self) -> float:
        return float(self.mean.mean())

    def add(self, x: np.ndarray) -> None:
        step = x - self.mean
        self.n += 1.0
        self.mean += step / self.n
        weight = (self.n - 1.0) / self.n
        self.flat_m2 += weight * float(step.mean()) ** 2
        self.products += np.multiply.outer(weight * step, step)
        if self.inverse is not None:
            turned = self.inverse @ step
            self.inverse -= np.multiply.outer(turned * (weight / (1.0 + weight * float(step @ turned))), turned)
            self.updates += 1

    def merge(self, n: float, mean: np.ndarray, m2: np.ndarray) -> None:
        """Add the moments of other vectors (parallel variance formula)."""
        if not n:
            return
        other = RunningVectors(len(mean), self.ridge, n, mean, m2)
        step = other.mean - self.mean
        total = self.n + other.n
        weight = self.n * other.n / total
        self.products += other.products + np.multiply.outer(weight * step, step)
        self.flat_m2 += other.flat_m2 + weight * float(step.mean()) ** 2
        self.mean += step * (other.n / total)
        self.n, self.inverse = total, None

    def distance(self, x: np.ndarray) -> float:
        """``sqrt(g' (products / n + ridge I)^-1 g)`` for the gap ``g`` to the mean."""
        d = len(self.mean)
        if self.inverse is None or self.n - self.base > self.base / GROWTH or self.updates > max(16, UPDATES * d):
            whole = self.products + self.n * self.ridge * np.eye(d)
            self.inverse, self.base, self.updates = np.linalg.inv(whole), self.n, 0
        # the inverse P has the ridge of ``base`` rows; with that of n rows it is P - e P P + e e P P P - ...
        more = (self.n - self.base) * self.ridge
        left, right = x - self.mean, None
        total, scale = 0.0, 1.0
        while True:
            right = self.inverse @ left
            for term in (scale * float(left @ right), -more * scale * float(right @ right)):
                total += term
            if not more or abs(term) <= ENOUGH * abs(total):
                break
            left, scale = right, scale * more * more
        return float(np.sqrt(max(self.n * total, 0.0)))


def _codes(column: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class Groups:
    """Where a new group starts in batches whose rows are sorted by group."""

    def __init__(self, places: Sequence[int]):
        self.places, self.last = places, None

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(k) for k in self.places]
        before = self.last
        self.last = [c.slice(len(c) - 1) for c in columns]
        new = np.zeros(batch.num_rows, bool)
        for k, column in enumerate(columns):
            codes = _codes(pa.concat_arrays([before[k], column]) if before else column)
            new[len(new) - len(codes) + 1 :] |= codes[1:] != codes[:-1]
        if before is None:
            new[0] = True
        return new


def _vectors(column: pa.ListArray) -> list[np.ndarray | None]:
    """The vectors of a column; None for NULL, a NULL or non-finite entry, and no entries."""
    offsets = column.offsets.to_numpy()
    values = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        x = values[a:b] if valid[k] and b > a else None
        out.append(x if x is not None and np.isfinite(x).all() else None)
    return out


def _fits(state: RunningVectors, x: np.ndarray) -> np.ndarray:
    if len(x) != len(state.mean):
        raise ValueError("vectors must have one common length")
    return x


def _sorted(rows: DataFrame, group: Sequence[str], *then: str) -> DataFrame:
    """Rows dealt by group, each group in order; without a group one task takes all."""
    dealt = rows.repartition(*[F.col(c) for c in group]) if group else rows.repartition(1)
    return dealt.sortWithinPartitions(*group, *then) if group or then else dealt


def _moments_of(rows: DataFrame, group: Sequence[str], vector: str, *, every: bool = False) -> DataFrame:
    """One row of moments per group, with the group's columns; groups without vectors only if ``every`` one is asked for."""
    fields = [rows.schema[c] for c in group]
    schema = StructType([*fields, *MOMENT_FIELDS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(range(len(group)))
        state, key = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None or (every and key is not None):
                found = (0.0, [], []) if state is None else state.packed()
                arrays = [*key, *(pa.array([v], f.type) for v, f in zip(found, list(arrow)[len(group) :]))]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            for k, (new, x) in enumerate(zip(groups.starts(batch), _vectors(batch.column(len(group))))):
                if new:
                    yield from done()
                    state, key = None, [batch.column(c).slice(k, 1).cast(arrow.field(c).type) for c in range(len(group))]
                if x is not None:
                    state = RunningVectors(len(x), 0.0) if state is None else state
                    state.add(_fits(state, x))
        yield from done()

    narrow = rows.select(*group, doubles(vector).alias(X))
    return _sorted(narrow, group).mapInArrow(run, schema)


def _merged(parts: DataFrame, keys: Sequence[str], at: str, *, before: bool) -> DataFrame:
    """Moments of each key: all its parts together, or for every part those before it."""
    fields = [parts.schema[c] for c in ([*keys, at] if before else keys)]
    schema = StructType([*fields, *MOMENT_FIELDS])
    arrow = to_arrow_schema(schema)
    width = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, state, key = Groups(range(len(keys))), None, None

        def row() -> pa.RecordBatch:
            arrays = [*key, *(pa.array([v], f.type) for v, f in zip(state.packed(), list(arrow)[width:]))]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            for k, new in enumerate(groups.starts(batch)):
                if new:
                    if state is not None and not before:
                        yield row()
                    state = None
                key = [batch.column(c).slice(k, 1).cast(arrow.field(c).type) for c in range(width)]
                if state is not None and before:
                    yield row()
                n, mean, m2 = (batch.column(len(keys) + 1 + c)[k].values if c else batch.column(len(keys) + 1)[k] for c in range(3))
                mean, m2 = mean.to_numpy(zero_copy_only=False), m2.to_numpy(zero_copy_only=False)
                if not n.as_py():
                    continue
                if state is None:
                    state = RunningVectors(len(mean), 0.0)
                state.merge(n.as_py(), _fits(state, mean), m2)
        if state is not None and not before:
            yield row()

    return _sorted(parts.select(*keys, at, *MOMENTS), keys, at).mapInArrow(run, schema)


def vector_moments(
    df: DataFrame, keys: Sequence[str], vector: str, *, split: Split = DEFAULT_SPLIT
) -> DataFrame:
    """``_n _mean _m2`` of every key's vectors, one row per key: what later rows have to know of them.

    The upper triangle of the centred products is kept row by row.  Rows of a hot key are spread by the
    hash of their vector and their moments merged.  A vector that is NULL or holds a NULL or non-finite entry
    does not count; a key without any other has no row.
    """
    if not keys and split.hot_rows is not None:
        total = df.count()
        pieces = math.ceil(total / split.piece_rows(total))
        dealt = df.withColumn(SALT, F.pmod(F.xxhash64(vector), F.lit(max(pieces, 1))).cast("int"))
        return _merged(_moments_of(dealt, [SALT], vector), keys, SALT, before=False)
    hot = find_hot(df, keys, split) if keys else None
    if hot is None:
        return _moments_of(df, keys, vector)
    parts = _moments_of(spread_rows(df, hot, keys, [vector]), [*keys, SALT], vector)
    return _merged(parts, keys, SALT, before=False)


def _starts(rows: DataFrame, keys: Sequence[str], vector: str, prior: DataFrame | None) -> DataFrame | None:
    """The moments each group of ``rows`` starts with."""
    if SEG not in rows.columns:
        return None if prior is None else prior.select(*keys, *MOMENTS)
    own = _moments_of(rows.filter(F.col(SEG).isNotNull()), [*keys, SEG], vector, every=True)
    if prior is None:
        return _merged(own, keys, SEG, before=True)
    first = prior.select(*keys, F.lit(-1).alias(SEG), *MOMENTS)
    hot = rows.filter(F.col(SEG).isNotNull()).select(*keys).distinct()
    if not keys:
        return _merged(own.unionByName(first), keys, SEG, before=True)
    cut = join_keys(first, hot, keys, "left_semi")
    whole = join_keys(first, hot, keys, "left_anti").withColumn(SEG, F.lit(None).cast("int"))
    return _merged(own.unionByName(cut), keys, SEG, before=True).unionByName(whole)


def running_vectors(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    vector: str,
    *,
    ridge: float,
    include_self: bool = True,
    prior: DataFrame | None = None,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``_n _distance _flat _flat_mean _flat_m2`` against the vectors of the key so far.

    ``_distance`` is the Mahalanobis distance under the population covariance plus ``ridge``; ``_flat``
    is the mean of the vector's entries, with its running mean and centred square sum.  ``prior`` holds
    ``vector_moments`` of all earlier rows.  A vector that is NULL or holds a NULL or non-finite entry has a NULL
    distance and counts for no other row.  Vectors of another length raise an error.
    """
    if not ridge > 0:
        raise ValueError("ridge must be positive")
    rows = segment_rows(df, keys, order_by, split)
    group = group_columns(rows, keys)
    starts = _starts(rows, keys, vector, prior)
    rows = rows.withColumn(X, doubles(vector)).withColumn(KIND, F.lit(1))
    if starts is not None:
        rows = rows.unionByName(starts.withColumn(KIND, F.lit(0)), allowMissingColumns=True)
    else:
        rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in MOMENT_FIELDS])
    found = ["_n", "_distance", "_flat", "_flat_mean", "_flat_m2"]
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in found]])
    arrow = to_arrow_schema(schema)
    names, place = df.columns, {name: k for k, name in enumerate(rows.columns)}
    score = _scorer(place, group, ridge, include_self)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own, scores in score(batches):
            kept = [batch.column(place[c]).filter(own).cast(arrow.field(c).type) for c in names]
            arrays = [*kept, *(pa.array(c, pa.float64()) for c in scores)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return _sorted(rows, group, KIND, *order_by).mapInArrow(run, schema)


def _scorer(place: dict[str, int], group: Sequence[str], ridge: float, include_self: bool) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, list]]:
        groups, state = Groups([place[c] for c in group]), None
        for batch in batches:
            if not batch.num_rows:
                continue
            news, kinds = groups.starts(batch), batch.column(place[KIND]).to_numpy()
            out = []
            for k, x in enumerate(_vectors(batch.column(place[X]))):
                if news[k]:
                    state = None
                if not kinds[k]:
                    n, mean, m2 = (batch.column(place[c])[k] for c in MOMENTS)
                    mean, m2 = (v.values.to_numpy(zero_copy_only=False) for v in (mean, m2))
                    state = RunningVectors(len(mean), ridge, n.as_py(), mean, m2)
                    continue
                if x is None:
                    out.append((0.0, None, None, 0.0, 0.0) if state is None else (state.n, None, None, state.flat_mean, state.flat_m2))
                    continue
                if state is None:
                    state = RunningVectors(len(x), ridge)
                _fits(state, x)
                if include_self:
                    state.add(x)
                far = state.distance(x) if state.n else None
                out.append((state.n, far, float(x.mean()), state.flat_mean, state.flat_m2))
                if not include_self:
                    state.add(x)
            yield batch, pa.array(kinds == 1), list(zip(*out)) or [[]] * 5

    return score
