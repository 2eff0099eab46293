"""Whitening, fill-in-middle and SimHash against plain Python and numpy."""

import hashlib
import itertools
import random
import re
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, simhash, whitening
from tidemark.llm.catalog import QUERIES

# -- whitening -----------------------------------------------------------------------------------------------------


def faddeev(matrix):
    """Characteristic polynomial by exact fractions, lowest power first."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m, coefficients = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (coefficients[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        product = [sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)]
        coefficients.append(-sum(product) / k)
    return [int(c) for c in reversed(coefficients)]


def psd(rng, rows, d, size=9):
    x = rng.integers(-size, size + 1, (rows, d))
    return (x.T @ x).tolist()


@pytest.mark.parametrize("rows, d", [(1, 1), (5, 1), (9, 2), (2, 5), (20, 7), (3, 8), (40, 12)])
def test_characteristic_polynomial(spark, rows, d):
    matrix = psd(np.random.default_rng(rows * d), rows, d)
    assert whitening.characteristic(spark, matrix) == faddeev(matrix)


def test_polynomial_of_blocks_zeros_and_large_numbers(spark):
    block = np.kron(np.eye(3, dtype=int), np.array([[2, 1], [1, 2]]))
    for matrix in (block.tolist(), np.zeros((4, 4), int).tolist(), [[10**40, 3], [3, 10**30]], [[0, 0, 0], [0, 5, 0], [0, 0, 5]]):
        assert whitening.characteristic(spark, matrix) == faddeev(matrix)


def test_roots_with_multiplicity_and_null_vectors(spark):
    matrix = np.kron(np.eye(3, dtype=int), np.array([[2, 1], [1, 2]])).tolist()
    polynomial = whitening.characteristic(spark, matrix)
    roots = whitening.largest_roots(polynomial, 5, 12)
    assert max(abs(r - e) for r, e in zip(roots, [3, 3, 3, 1, 1])) < Decimal("1e-26")
    vectors = whitening.null_vectors(matrix, roots)
    v = np.array(vectors, float)
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-15)
    assert np.allclose(np.array(matrix) @ v.T, v.T * np.array(roots, float), atol=1e-14)


def test_roots_far_below_double_precision(spark):
    # eigenvalues (10**20 + 1) +- 1 are one double
    a = 10**20 + 1
    matrix = [[a, 1, 0], [1, a, 0], [0, 0, 7]]
    roots = whitening.largest_roots(whitening.characteristic(spark, matrix), 3, 2 * a + 7)
    assert abs(roots[0] - (a + 1)) < Decimal("1e-30") and abs(roots[1] - (a - 1)) < Decimal("1e-30")
    assert abs(roots[2] - 7) < Decimal("1e-50")
    vectors = np.array(whitening.null_vectors(matrix, roots), float)
    assert np.allclose(np.abs(vectors), [[0.5**0.5, 0.5**0.5, 0], [0.5**0.5, 0.5**0.5, 0], [0, 0, 1]], atol=1e-16)


def plain_whitening(rows, components=4):
    """From ``(id, vector)``: the fit by numpy on the distinct vectors, deviations by Python's whole numbers."""
    whole = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows]
    distinct = sorted({x for _, x in whole})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[k] for x in distinct) for k in range(d)]
    centred = np.array(distinct, float) - np.array(sums, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [k for k in range(min(components, d)) if values[k] > 1e-9 * values[0]]
    out = {}
    for i, x in whole:
        far = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x, float) - np.array(sums, float) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out[i] = (n, far, [w[k] for k in some], [values[k] / values.sum() for k in some])
    return out


def compare_whitening(found, expected):
    got = defaultdict(dict)
    for r in found:
        got[r.vec_id][r.component] = r
    assert set(got) == set(expected)
    signs = {}
    for i, (n, far, w, share) in expected.items():
        own = got[i]
        assert sorted(own) == list(range(1, len(w) + 1))
        for k in range(len(w)):
            r = own[k + 1]
            assert (r.n, int(r.deviation)) == (n, far)
            assert r.explained == pytest.approx(share[k], rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(w[k]), rel=1e-7, abs=1e-7)
            if abs(w[k]) > 1e-3:
                signs.setdefault(k, set()).add(np.sign(w[k]) == np.sign(r.whitened))
            assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = QUERIES["op11_whitening"](spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint"
    compare_whitening(found.collect(), plain_whitening(rows))


VECTORS = [
    (0, [0.5, -0.25, 0.125]), (1, [0.5, -0.25, 0.125]), (2, [0.1, 0.2, -0.3]), (3, [-0.0, 1.5, 2.0]), (4, [3.0, -1.0, 0.75]),
    (5, [0.9, 0.9, 0.1]), (6, None), (7, [0.1, None, 0.3]), (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]),
    (10, [1e300, 0.0, 0.0]), (11, []), (12, [1.0]), (13, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, 0.7, -0.7]), (2**60, [0.001, 0.0039, 0.004]),
]
ODD = "vec_id long, embedding array<double>, x string, n string, component string"


def test_whitening_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in VECTORS], ODD)
    expected = plain_whitening([r for r in VECTORS if r[0] in (0, 1, 2, 3, 4, 5, None, 2**60)])
    compare_whitening(whitening.whiten(df).collect(), expected)
    # repeated rows repeat and change nothing else
    twice = whitening.whiten(df.unionByName(df))
    assert twice.count() == 2 * whitening.whiten(df).count()
    compare_whitening(twice.collect(), expected)


def test_whitening_without_variance_or_rows(spark):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in VECTORS], ODD)
    assert whitening.whiten(df.where("1 = 0")).count() == 0
    assert whitening.whiten(df.where("vec_id in (0, 1)")).count() == 0
    assert whitening.whiten(df.where("vec_id in (6, 8, 11)")).count() == 0
    line = whitening.whiten(df.where("vec_id in (0, 2)")).collect()
    assert {(r.component, round(r.whitened, 9)) for r in line} == {(1, 1.0), (1, -1.0)}


def test_whitening_of_wide_numbers(spark):
    """Sums beyond longs and doubles."""
    rows = [(0, [2.0**50, 1.0]), (1, [-(2.0**50), 3.0]), (2, [2.0**49, -5.0]), (3, [2.0**48 + 1, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1)
    expected = plain_whitening(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in found.collect()} == {i: e[1] for i, e in expected.items()}


# -- fill in the middle --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 200, 5000])
def test_skip_list_reaches_every_rank(n):
    rng = np.random.default_rng(n)
    widths = rng.integers(1, 9, n)
    starts = np.cumsum(widths) - widths
    units = fill_middle.SkipList(starts, int(widths.sum()))
    assert [units.place(k) for k in range(n + 1)] == [*starts.tolist(), int(widths.sum())]
    if n == 5000:
        assert len(units.lanes) > 4
    with pytest.raises(IndexError):
        units.place(n + 1)


def plain_middle(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_of_odd_rows(spark, odd, none):
    more = [(k, t) for k, t in enumerate(["<", "<S", "P>x<M", "a<S>b", "\x00 é\U0001f600<P", "S>" * 40, "aB" * 9 + "ı" + "K"], 100)]
    more += [(k, "x <P y S> z <" * (k % 7 + 1)) for k in range(200, 260)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = fill_middle.fill_middle(df).withColumn("again", fill_middle.restore("output", "form")).collect()
    assert sorted((tuple(r)[:-1] for r in found), key=repr) == sorted((plain_middle(*r) for r in rows), key=repr)
    assert sorted(r.again for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(none).count() == 0
    assert fill_middle.fill_middle(odd).count() == odd.count()


def test_middle_hands_over_in_parts(odd, monkeypatch):
    whole = fill_middle.fill_middle(odd).collect()
    monkeypatch.setattr(fill_middle, "BATCH_CHARS", 10)
    assert sorted(map(repr, fill_middle.fill_middle(odd).collect())) == sorted(map(repr, whole))


# -- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd, monkeypatch):
    for size in (1 << 20, 1, 50):
        monkeypatch.setattr(simhash, "SLICE", size)
        for r in odd.collect():
            assert simhash.fingerprint(r["text"] or "") == plain_fingerprint(r["text"])
    # the same hash as Spark's own
    words = spark.createDataFrame([("ein zwei drei é",), ("",), ("a" * 100,)], "w string")
    for r in words.select("w", F.xxhash64("w").alias("h")).collect():
        assert r.h % 2**64 == xxhash.xxh64_intdigest(r.w.encode(), seed=42)


def plain_components(numbers):
    """Brute force over all pairs: the smallest place reachable."""
    values = np.array(numbers, np.uint64)
    label = np.arange(len(values))
    while True:
        now = label.copy()
        for k in range(len(values)):
            near = np.bitwise_count(values ^ values[k]) <= 2
            now[near] = min(now[near].min(), label[near].min())
        if (now == label).all():
            return label.tolist()
        label = now


def check_simhash(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    numbers = [plain_fingerprint(t) for _, t in rows]
    groups = defaultdict(list)
    for (i, _), label in zip(rows, plain_components(numbers)):
        groups[label].append(i)
    least = {label: min((i for i in own if i is not None), default=None) for label, own in groups.items()}
    expected = [(i, f, least[label]) for (i, _), f, label in zip(rows, numbers, plain_components(numbers))]
    found = [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_components(df).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    return expected


def test_simhash_of_odd_rows(odd, none):
    found = check_simhash(odd)
    assert {i for i, f, _ in found if f == 0} == {3, 4, 5, None}
    assert simhash.near_components(none).count() == 0


@pytest.mark.parametrize("long", [64, 0])
def test_simhash_of_families(spark, monkeypatch, long):
    """Long texts with a few words changed, which differ in few bits or none; with all lists cut again, too."""
    monkeypatch.setattr(simhash, "LONG_LIST", long)
    rng, docs = random.Random(5), []
    for family in range(5):
        base = [f"f{family}x{rng.randrange(400)}" for _ in range(700)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            docs.append(" ".join(words))
    docs += [" ".join(f"z{rng.random()}" for _ in range(30)) for _ in range(60)]
    rng.shuffle(docs)
    found = check_simhash(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert len({f for _, f, _ in found}) > len({c for *_, c in found}) + 10


def test_simhash_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r.doc_id: r.fingerprint for r in QUERIES["op13_simhash"](spark, sf_dir).collect()}
    assert found == {i: f"{plain_fingerprint(t):016x}" for i, t in rows}
    check_simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def links_of(spark, numbers):
    rows = spark.createDataFrame([(int(v),) for v in np.array(numbers, np.uint64).view(np.int64)], "fingerprint long")
    total = len(numbers)
    together = simhash._sums(rows, 64 * 64, simhash._together).reshape(64, 64)
    layout = simhash.Layout(simhash.deal_bits(together, total))
    moved = layout.move(np.array(numbers, np.uint64))
    back = dict(zip(moved.view(np.int64).tolist(), numbers))
    frame = spark.createDataFrame([(int(v),) for v in moved.view(np.int64)], "p long")
    found = simhash._links(frame, simhash._measured(frame, layout, total)).distinct().collect()
    return {tuple(sorted((back[r.a], back[r.b]))) for r in found}


@pytest.mark.parametrize("long", [64, 3])
@pytest.mark.parametrize("kind", ["random", "one value", "fixed bits", "dense"])
def test_no_link_is_lost(spark, monkeypatch, kind, long):
    monkeypatch.setattr(simhash, "LONG_LIST", long)
    rng = random.Random(kind)
    base = [rng.getrandbits(64) for _ in range(40)]
    if kind == "one value":  # nearly all agree in 20 bits
        base = [b & ~0xFFFFF | 0x12345 for b in base]
    if kind == "fixed bits":  # half of the bits are the same, others come in pairs
        base = [b & 0xFFFF | (b & 0xFFFF) << 16 | 0x7F << 40 for b in base]
    if kind == "dense":  # a few unstable bits
        bits = rng.sample(range(64), 7)
        base = [base[0] ^ sum(1 << b for b, on in zip(bits, p) if on) for p in itertools.product([0, 1], repeat=7)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(4)]
    numbers = sorted(set(base + near))
    expected = {(a, b) for a, b in itertools.combinations(numbers, 2) if (a ^ b).bit_count() <= 2}
    assert links_of(spark, numbers) == expected


def test_thresholds_are_cheapest():
    rng = np.random.default_rng(1)
    for total, parts, choices in ((0, 3, 4), (1, 2, 4), (2, 1, 4), (-1, 4, 4), (-2, 5, 3)):
        costs = [rng.integers(0, 50, (choices, 30)).astype(float) for _ in range(parts)]
        chosen = simhash.allocate(costs, total)
        assert (chosen.sum(axis=0) == total).all()
        for n in range(30):
            paid = sum(costs[k][chosen[k, n] + 1, n] for k in range(parts))
            every = itertools.product(range(-1, choices - 1), repeat=parts)
            assert paid == min(sum(costs[k][t + 1, n] for k, t in enumerate(e)) for e in every if sum(e) == total)


def test_correlated_bits_come_together():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 40:50] = bits[:, [0]]
    numbers = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    dealt = simhash.deal_bits(simhash._together(numbers).reshape(64, 64), len(numbers))
    assert sorted(b for own in dealt for b in own) == list(range(64))
    assert any({0, *range(40, 50)} <= set(own) for own in dealt)
    layout = simhash.Layout(dealt)
    moved = layout.move(numbers)
    assert (np.bitwise_count(moved[:-1] ^ moved[1:]) == np.bitwise_count(numbers[:-1] ^ numbers[1:])).all()
