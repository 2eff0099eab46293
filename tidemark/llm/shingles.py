"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are hashed together; a longer text is hashed alone.
SLICE = 1 << 21
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, WIDTH, np.uint64) * U(2) + U(1)
_BYTES = np.random.default_rng(21).integers(1, 1 << 63, 256, np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers_to(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < size:
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    codes = np.frombuffer(joined, np.uint8)
    white = _WHITE[codes]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = (edge == -1).nonzero()[0], (edge == 1).nonzero()[0]
    power, inverse = _powers_to(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[codes] * power[: len(codes)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of every text; fewer words than ``WIDTH`` make one shingle, no word none."""
    encoded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    words, starts = _words(b" ".join(encoded))
    firsts = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    at = np.searchsorted(starts, firsts)
    count = max(0, len(words) - WIDTH + 1)
    total = np.zeros(count, np.uint64)
    for k in range(WIDTH):
        total += words[k : k + count] * _FACTORS[k]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(total[a : b - WIDTH + 1]))
        elif b > a:
            # the number of words keeps a short sequence apart from full shingles
            out.append(mix((words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and shingles of every text of an Arrow column, in slices."""
    part, rows, size = [], [], 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        if part and size + len(text) > SLICE:
            yield from zip(rows, shingle_sets(part))
            part, rows, size = [], [], 0
        part.append(text)
        rows.append(row)
        size += len(text)
    if part:
        yield from zip(rows, shingle_sets(part))


def set_key(elements: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    total = mix(elements ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + U(len(elements))
    return int(mix(total).view(np.int64)[0])
