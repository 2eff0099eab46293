"""Whitening of embeddings from the exact characteristic polynomial of their scatter.

Entries become whole numbers, so the scatter ``n * sum(x x') - S S'`` of the distinct
vectors is a matrix of integers: ``n * n`` times the covariance, without rounding.  It is
summed over the table in Spark.  Then, on numbers that depend on the dimension only:

1. its characteristic polynomial modulo many primes, a task per group of primes, by
   reduction to Hessenberg form, and the integers from the remainders (``characteristic``);
2. the largest roots, isolated to ``DIGITS`` digits by halving intervals whose numbers of
   roots follow from signs alone: all roots are real, so Descartes' rule is exact (``largest_roots``);
3. unit vectors of the null spaces by inverse iteration in decimals (``null_vectors``).

Rows are projected in Arrow batches.

Cases: rows with a null vector, a null or non-finite entry, an entry that leaves the long
range when scaled, or another number of entries than most vectors have (the larger of
two that are as frequent) are dropped, and so are vectors without entries; an empty table, or
vectors that are all the same, give no component and hence no rows; components without
variance are left out; of equal eigenvalues any orthonormal vectors are taken; repeated rows
repeat in the result and count once for the fit; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stored

SCALE = 256
#: Significant decimal digits of roots and null vectors.
DIGITS = 60
#: Primes below this are taken for remainders: products of two remainders stay below 2 ** 62.
BELOW = 1 << 31
#: Primes of one task.
PRIMES_PER_TASK = 16
#: Up to here sums of products of whole numbers are exact in doubles.
EXACT = 1 << 53


# -- whole-number vectors ------------------------------------------------------------------------------------------


def whole_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vec_id x`` with ``x = floor(256 * c)`` as longs, of the rows that can be used."""
    entry = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE))
    inside = F.forall(
        vector,
        lambda c: F.coalesce(
            ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < float(1 << 63)), F.lit(False)
        ),
    )
    usable = df.where(F.col(vector).isNotNull() & inside & (F.size(vector) > 0))
    sizes = usable.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = most[0]["size"] if most else 0
    return usable.where(F.size(vector) == size).select(F.col(id_column).alias("vec_id"), entry.cast("array<long>").alias("x"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _products(x: np.ndarray) -> np.ndarray:
    """``x' x`` of whole numbers without rounding, as Python integers."""
    most = int(max(abs(int(x.min())), abs(int(x.max()))))
    if most * most * len(x) < EXACT:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    whole = x.astype(object)
    return whole.T @ whole


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number ``n``, sums ``S`` and ``n * sum(x x') - S S'`` of the vectors in column ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), batch.num_rows)
                n += len(x)
                sums = sums + x.astype(object).sum(axis=0)
                products = products + _products(x)
        if n:
            numbers = [n, *sums, *(products[i, j] for i in range(d) for j in range(i, d))]
            cells = pa.array(np.arange(len(numbers)))
            # in two halves, so that no sum leaves the range of a decimal
            high, low = zip(*(divmod(int(v), 1 << 64) for v in numbers))
            kind = pa.decimal128(38, 0)
            halves = [pa.array(list(map(Decimal, part)), kind) for part in (high, low)]
            yield pa.RecordBatch.from_arrays([cells, *halves], ["cell", "high", "low"])

    parts = vectors.select("x").mapInArrow(run, "cell long, high decimal(38,0), low decimal(38,0)")
    # one row per cell of the matrix, whatever the table's size
    found = {
        cell: int(high) * (1 << 64) + int(low)
        for cell, high, low in parts.groupBy("cell").agg(F.sum("high"), F.sum("low")).collect()
    }
    if not found:
        return 0, [0] * d, [[0] * d for _ in range(d)]
    n, sums = found[0], [found[1 + i] for i in range(d)]
    matrix = [[0] * d for _ in range(d)]
    cell = 1 + d
    for i in range(d):
        for j in range(i, d):
            matrix[i][j] = matrix[j][i] = n * found[cell] - sums[i] * sums[j]
            cell += 1
    return n, sums, matrix


# -- characteristic polynomial -------------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Exact for odd numbers below 3,215,031,751."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below ``BELOW`` whose product exceeds ``bound``."""
    found, product, number = [], 1, BELOW - 1
    while product <= bound:
        if _is_prime(number):
            found.append(number)
            product *= number
        number -= 2
    return found


def hessenberg_polynomials(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Per prime the coefficients of ``det(t I - M)`` modulo it, lowest power first.

    A similarity brings the matrix to Hessenberg form; its polynomial follows column by column.
    All primes go through each step together.
    """
    d, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes], np.int64).reshape(count, d, d)
    p1, p2, every = p[:, None], p[:, None, None], np.arange(count)
    for m in range(1, d - 1):
        column = h[:, m:, m - 1]
        pivot = (column != 0).argmax(axis=1) + m
        # rows, then columns, of the pivot and of m change places; a column without a pivot is done
        rows = h[every, pivot].copy()
        h[every, pivot], h[:, m] = h[:, m].copy(), rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot], h[:, :, m] = h[:, :, m].copy(), columns
        lead = h[:, m, m - 1]
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(lead, p)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    known = [np.zeros((count, d + 1), np.int64)]
    known[0][:, 0] = 1
    for k in range(1, d + 1):
        before = known[k - 1]
        now = np.zeros_like(before)
        now[:, 1:] = before[:, :-1]
        now = (now - h[:, k - 1, k - 1, None] * before % p1) % p1
        below = np.ones(count, np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            now = (now - (h[:, k - i - 1, k - 1] * below % p)[:, None] * known[k - i - 1] % p1) % p1
        known.append(now)
    return known[d]


def joined_remainders(remainders: list[int], primes: list[int]) -> int:
    """The whole number from 0 with these remainders, by mixed radix digits."""
    value, product = 0, 1
    for r, p in zip(remainders, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of ``det(t I - M)`` of a positive semidefinite matrix of integers, lowest power first.

    The polynomial's sizes are elementary symmetric sums of roots that are not negative, so they are
    at most those of equal roots with the same sum; signs alternate.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                found = hessenberg_polynomials(matrix, own)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    listed = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES_PER_TASK))
    rows = {p: c for p, c in listed.mapInArrow(run, "p long, c array<long>").collect()}
    signs = [-1 if (d - k) % 2 else 1 for k in range(d + 1)]
    return [
        s * joined_remainders([s * rows[p][k] % p for p in primes], primes) for k, s in enumerate(signs)
    ]


# -- roots ---------------------------------------------------------------------------------------------------------


def roots_above(polynomial: list[int], number: int, bits: int) -> int:
    """How many roots, with multiplicity, exceed ``number / 2 ** bits``: Descartes' rule after a shift."""
    d = len(polynomial) - 1
    # the roots times 2 ** bits
    c = [v << (bits * (d - k)) for k, v in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += number * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], k: int, trace: int, digits: int = DIGITS) -> list[Decimal]:
    """The ``k`` largest positive roots of a polynomial with real roots only, falling, with multiplicity.

    Each is the middle of an interval that holds it and is ``10 ** -digits`` of its size.
    """
    d = len(polynomial) - 1
    positive = roots_above(polynomial, 0, 0)
    found: list[Decimal] = []
    intervals: dict[tuple[int, int], int] = {}

    def above(number: int, bits: int) -> int:
        if (number, bits) not in intervals:
            intervals[number, bits] = roots_above(polynomial, number, bits)
        return intervals[number, bits]

    wanted = math.ceil(digits * math.log2(10))
    with decimal.localcontext() as context:
        context.prec = digits + 10
        for place in range(min(k, positive, d)):
            low, high, bits = 0, trace, 0  # more than ``place`` roots above low, at most ``place`` above high
            while high.bit_length() - (high - low).bit_length() < wanted:
                if high - low < 4:
                    low, high, bits = low << 4, high << 4, bits + 4
                middle = (low + high) // 2
                if above(middle, bits) > place:
                    low = middle
                else:
                    high = middle
            found.append(Decimal(low + high) / Decimal(1 << (bits + 1)))
    return found


# -- components ----------------------------------------------------------------------------------------------------


def _factors(matrix: list[list[int]], root: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """Triangular factors of ``M - root I`` with row exchanges; a zero pivot becomes the smallest step."""
    d = len(matrix)
    a = [[Decimal(v) for v in row] for row in matrix]
    for i in range(d):
        a[i][i] -= root
    tiny = max(abs(root), Decimal(1)) * Decimal(10) ** -decimal.getcontext().prec
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
        if not a[k][k]:
            a[k][k] = tiny
        for i in range(k + 1, d):
            factor = a[i][k] = a[i][k] / a[k][k]
            if factor:
                row, lead = a[i], a[k]
                for j in range(k + 1, d):
                    row[j] -= factor * lead[j]
    return a, order


def _solved(factors: list[list[Decimal]], order: list[int], right: list[Decimal]) -> list[Decimal]:
    d = len(right)
    y = [right[i] for i in order]
    for i in range(d):
        y[i] -= sum((factors[i][j] * y[j] for j in range(i)), Decimal(0))
    for i in reversed(range(d)):
        y[i] = (y[i] - sum((factors[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / factors[i][i]
    return y


def _unit(vector: list[Decimal], against: list[list[Decimal]]) -> list[Decimal]:
    for _ in range(2):
        for other in against:
            along = sum((a * b for a, b in zip(vector, other)), Decimal(0))
            vector = [a - along * b for a, b in zip(vector, other)]
    length = sum((a * a for a in vector), Decimal(0)).sqrt()
    return [a / length for a in vector]


def null_vectors(matrix: list[list[int]], roots: list[Decimal], digits: int = DIGITS) -> list[list[Decimal]]:
    """Orthonormal null vectors of ``M - root I`` per root, the largest entry of each positive.

    Inverse iteration from a fixed start; a vector of a repeated root is kept apart from its earlier ones.
    """
    d, found = len(matrix), []
    with decimal.localcontext() as context:
        context.prec = digits + 20
        for place, root in enumerate(roots):
            factors, order = _factors(matrix, root)
            # a start along no axis, another one for every root
            start = [Decimal(1) + Decimal((7 * i * i + 13 * i + 29 * place * i) % 101) / 101 for i in range(d)]
            vector = _unit(start, found)
            for _ in range(3):
                vector = _unit(_solved(factors, order, vector), found)
            largest = max(vector, key=abs)
            found.append([-v for v in vector] if largest < 0 else vector)
    return found


# -- operator ------------------------------------------------------------------------------------------------------


class Whitening:
    """What a fit gives: ``n``, ``sums``, roots of the scatter, their vectors, shares and the identity error."""

    def __init__(self, n: int, sums: list[int], roots: list[Decimal], vectors: list[list[Decimal]], trace: int):
        self.n, self.sums = n, np.array(sums, object)
        self.explained = [float(r / Decimal(trace)) for r in roots]
        # (n x - S) . v / sqrt(root) is (x - S / n) . v / sqrt(e), as root = n * n * e
        self.axes = np.array([[float(v / r.sqrt()) for v in vector] for r, vector in zip(roots, vectors)])
        self.axes = self.axes.reshape(len(roots), len(sums))
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` as whole numbers, Python's where longs are too short."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(abs(int(s)) for s in self.sums)
        if most < 1 << 62:
            return x.astype(np.int64) * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.axes.T

    def deviation(self, centred: np.ndarray) -> list[int]:
        """Sum of squares of every row, exact."""
        most = int(np.abs(centred).max()) if centred.size else 0
        if centred.dtype == np.int64 and most * most * centred.shape[1] < 1 << 62:
            return (centred * centred).sum(axis=1).tolist()
        return [int(v) for v in (centred.astype(object) ** 2).sum(axis=1)]


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(model.centred(_matrix(batch.column(0), batch.num_rows)))
                sums += w.sum(axis=0)
                products += w.T @ w
        numbers = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers))), pa.array(numbers)], ["cell", "v"])

    parts = distinct.select("x").mapInArrow(run, "cell long, v double")
    # k + k * k rows
    found = np.zeros(k + k * k)
    for cell, v in parts.groupBy("cell").agg(F.sum("v")).collect():
        found[cell] = v / model.n
    mean, second = found[:k], found[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Fit on the distinct vectors of column ``x``; None where there are none."""
    first = vectors.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return None
    d = first[0]["d"]
    distinct = stored(vectors.select("x").distinct(), "distinct-vectors")
    n, sums, matrix = scatter(distinct, d)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitening(n, sums, [], [], 1)
    common = reduce(math.gcd, (v for row in matrix for v in row))
    smaller = [[v // common for v in row] for row in matrix]
    polynomial = characteristic(vectors.sparkSession, smaller)
    roots = largest_roots(polynomial, components, trace // common)
    axes = null_vectors(smaller, roots)
    model = Whitening(n, sums, [r * common for r in roots], axes, trace)
    model.identity_error = _identity_error(distinct, model)
    return model


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable row and component: ``vec_id component n deviation whitened explained identity_error``.

    ``deviation`` is a decimal of 38 digits, the sum of squares of ``n * x - S``.
    """
    rows = whole_vectors(df, id_column, vector)
    model = fit(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    if model is None or not len(model.axes):
        return df.sparkSession.createDataFrame([], schema)
    k = len(model.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            centred = model.centred(_matrix(batch.column(1), rows))
            each = pa.array(np.repeat(np.arange(rows), k))
            far = pa.array(list(map(Decimal, model.deviation(centred))), pa.decimal128(38, 0))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                far.take(each),
                pa.array(model.whitened(centred).ravel()),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
