"""Line diffs with places: the shortest edit script of every changed text, and its application.

Versions are compared by hash first.  Only texts of changed paths are read into the comparison: a
bitmap of hashed paths of fixed size filters both tables before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

#: Bits of the bitmap of changed paths: 8 MB, whatever the tables' sizes.
BITMAP_BITS = 1 << 26
#: Masks of lines that occur often, kept while a text is compared.
KEPT_MASKS, OFTEN = 64, 16
HUNK_COLUMNS = ["hunk", "old_start", "new_start", "place", "op", "line"]


def changed_paths(base: DataFrame, target: DataFrame, path: str, text: str, suffix: str = "") -> DataFrame:
    """``path change_type`` (added, removed, modified) of the paths with the suffix; only hashes are joined.

    Paths are unique inside a version; a NULL text is one that is not there.
    """

    def hashed(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(F.col(path).endswith(suffix) & F.col(text).isNotNull())
        return kept.select(F.col(path), F.sha2(text, 256).alias(name))

    rows = hashed(base, "_old").join(hashed(target, "_new"), [path], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("modified")
    return rows.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(path, change.alias("change_type"))


def _bit(path: str) -> Column:
    # numbered from 1, as the bitmap functions do
    return F.pmod(F.xxhash64(path), F.lit(BITMAP_BITS)) + 1


def _marked(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Add ``_hit``: false only where the column's value is surely not in ``ids``.  Nothing is moved for it."""
    bits = ids.select(_bit(column).alias("_bit"))
    bits = bits.groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")
    )
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(_bit(column)))
    # at most BITMAP_BITS / 32768 rows of 4 KB
    marked = marked.join(F.broadcast(bits), ["_bucket"], "left")
    at = F.bitmap_bit_position(_bit(column))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return marked.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


def only_changed(df: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """The rows whose path is in ``changes``; nearly all others are dropped before the join moves them."""
    hit = _marked(df, changes, path).filter("_hit").drop("_hit")
    return hit.join(changes.select(path), [path], "left_semi")


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose value is not in ``ids``; only rows that may be in it are moved.  ``df`` is read twice."""
    marked = _marked(df, ids, column)
    maybe = marked.filter("_hit").drop("_hit").join(ids.select(column), [column], "left_anti")
    return marked.filter("not _hit").drop("_hit").unionByName(maybe)


# -- one pair of texts ---------------------------------------------------------------------------------------------


class _Masks:
    """For a line its places among the lines of one side, as the bits of a whole number."""

    def __init__(self, lines: list[int]):
        self.places: dict[int, list[int]] = {}
        for k, line in enumerate(lines):
            self.places.setdefault(line, []).append(k)
        self.size, self.kept = len(lines) // 8 + 1, {}

    def of(self, line: int) -> int:
        places = self.places.get(line)
        if not places:
            return 0
        if len(places) == 1:
            return 1 << places[0]
        if line in self.kept:
            return self.kept[line]
        bits = bytearray(self.size)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        mask = int.from_bytes(bits, "little")
        if len(places) > OFTEN and len(self.kept) < KEPT_MASKS:
            self.kept[line] = mask
        return mask


def _common(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and each beginning of ``b``.

    One number holds a whole row of the table: a zero bit is a place where the length grows by one.
    """
    masks, full = _Masks(b), (1 << len(b)) - 1
    row = full
    for line in a:
        hit = row & masks.of(line)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(b)].astype(np.int64))])


def kept_lines(old: list, new: list) -> list[tuple[int, int]]:
    """Places of the lines that a shortest edit script keeps, in memory proportional to the texts.

    Halves ``old`` and finds where ``new`` divides with it; equal ends and lines of one side only go first.
    """
    numbers: dict = {}
    a = [numbers.setdefault(line, len(numbers)) for line in old]
    b = [numbers.setdefault(line, len(numbers)) for line in new]
    found: list[tuple[int, int]] = []
    stack = [(list(range(len(a))), list(range(len(b))))]
    while stack:
        x, y = stack.pop()
        head = 0
        while head < min(len(x), len(y)) and a[x[head]] == b[y[head]]:
            found.append((x[head], y[head]))
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and a[x[-1 - tail]] == b[y[-1 - tail]]:
            found.append((x[-1 - tail], y[-1 - tail]))
            tail += 1
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        left, right = {a[k] for k in x}, {b[k] for k in y}
        x, y = [k for k in x if a[k] in right], [k for k in y if b[k] in left]
        if not x or not y:
            continue
        if len(x) == 1:
            found.append((x[0], next(k for k in y if b[k] == a[x[0]])))
            continue
        half = len(x) // 2
        lines = [b[k] for k in y]
        before = _common([a[k] for k in x[:half]], lines)
        after = _common([a[k] for k in reversed(x[half:])], lines[::-1])
        cut = int((before + after[::-1]).argmax())
        stack += [(x[:half], y[:cut]), (x[half:], y[cut:])]
    return sorted(found)


def hunks_of(old: str | None, new: str | None) -> Iterator[tuple[int, int, int, int, str, str]]:
    """``hunk old_start new_start place op line`` of two texts, lines numbered from 1; None has no lines.

    A hunk is what lies between two kept lines: first its old lines (``-``), then its new ones (``+``).
    """
    a = [] if old is None else old.split("\n")
    b = [] if new is None else new.split("\n")
    hunk, i, j = 0, 0, 0
    for x, y in [*kept_lines(a, b), (len(a), len(b))]:
        if x > i or y > j:
            lines = [("-", line) for line in a[i:x]] + [("+", line) for line in b[j:y]]
            for place, (op, line) in enumerate(lines):
                yield hunk, i + 1, j + 1, place, op, line
            hunk += 1
        i, j = x + 1, y + 1


def patched(old: str | None, hunks: list[tuple[int, str, str]]) -> str | None:
    """A text after its hunks: ``(old_start, op, line)`` in order."""
    lines = [] if old is None else old.split("\n")
    out, at = [], 0
    for start, op, line in hunks:
        if start - 1 > at:
            out += lines[at : start - 1]
            at = start - 1
        if op == "+":
            out.append(line)
        elif at < len(lines) and lines[at] == line:
            at += 1
        else:
            raise ValueError(f"line {at + 1} is not what the hunk takes out")
    out += lines[at:]
    return "\n".join(out) if out else None


# -- tables --------------------------------------------------------------------------------------------------------


def line_hunks(base: DataFrame, target: DataFrame, path: str, text: str, *, suffix: str = ".py") -> DataFrame:
    """``path hunk old_start new_start place op line`` for every changed path with the suffix.

    ``op`` is ``-`` for a line of the old text and ``+`` for one of the new; ``place`` orders the lines of a hunk.
    An added path has new lines only, a removed one old lines only.
    """
    changes = stored(changed_paths(base, target, path, text, suffix), "changed-paths")
    old = only_changed(base.select(path, F.col(text).alias("_old")).filter("_old is not null"), changes, path)
    new = only_changed(target.select(path, F.col(text).alias("_new")).filter("_new is not null"), changes, path)
    rows = old.join(new, [path], "full_outer").select(path, "_old", "_new")
    kind = rows.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(hunks_of(batch.column(1)[k].as_py(), batch.column(2)[k].as_py()))
                if found:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                    name = batch.column(0).take(pa.array([k] * len(found)))
                    yield pa.RecordBatch.from_arrays([name, *arrays], [path, *HUNK_COLUMNS])

    return rows.mapInArrow(
        run, f"`{path}` {kind}, hunk int, old_start long, new_start long, place long, op string, line string"
    )


def apply_hunks(base: DataFrame, hunks: DataFrame, path: str, text: str) -> DataFrame:
    """``path text`` of all paths that have hunks: the old text of ``base`` after them, NULL for a removed path."""
    hunks = stored(hunks.select(path, *HUNK_COLUMNS), "hunks")
    steps = F.array_sort(F.collect_list(F.struct("hunk", "place", "old_start", "op", "line")))
    scripts = hunks.groupBy(path).agg(steps.alias("_steps"))
    old = only_changed(base.select(path, F.col(text).alias("_old")), hunks.select(path).distinct(), path)
    rows = scripts.join(old, [path], "left").select(path, "_old", "_steps")
    kind = rows.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                script = [(s["old_start"], s["op"], s["line"]) for s in batch.column(2)[k].as_py()]
                new = pa.array([patched(batch.column(1)[k].as_py(), script)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), new], [path, text])

    return rows.mapInArrow(run, f"`{path}` {kind}, `{text}` string")
