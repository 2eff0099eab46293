"""Fill-in-middle transformation with cuts found by an indexable skip list.

A text is a sequence of units (a run of ASCII letters, or any other code point).
The two cuts are ranks among the units.  ``SkipList`` holds the units of one text:
every node of an express lane knows how many units and how many code points lie
between it and the next node of its lane.  Going down from the top lane, and along
a lane while the accumulated unit widths stay within the rank, reaches the unit of
that rank, and the accumulated code-point widths are the place of the cut.

Cases: a null or empty text, and one that holds a marker, stays as it is (``plain``);
a null id is hashed as an empty string; long texts are cut whole; an empty table
gives an empty result; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.shingles import mix

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
#: One in so many nodes of a lane stands in the lane above, too.
STEP = 4
#: Characters of results that are handed over at once.
BATCH_CHARS = 1 << 24


def unit_starts(text: str) -> np.ndarray:
    """The code point at which each unit of ``[A-Za-z]+|[^A-Za-z]`` starts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes | 32
    letter = (low >= 97) & (low <= 122)
    starts = np.ones(len(codes), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return starts.nonzero()[0]


class SkipList:
    """The units of one text under express lanes; a node's height follows from a hash of its rank."""

    def __init__(self, starts: np.ndarray, points: int):
        self.units, self.points = len(starts), points
        #: Per lane, from the lowest: unit widths, code-point widths, and each node's place in the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ranks, hashes, below = np.arange(self.units), None, np.arange(self.units)
        while True:
            ends = np.append(ranks[1:], self.units)
            places = starts[ranks]
            self.lanes.append((ends - ranks, np.append(places[1:], points) - places, below))
            if len(ranks) <= STEP:
                return
            if hashes is None:
                hashes = mix(ranks.astype(np.uint64))
            taller = hashes % np.uint64(STEP) == 0
            taller[0] = True  # the head stands in every lane
            below = taller.nonzero()[0]
            if len(below) == len(ranks):
                return
            ranks, hashes = ranks[below], hashes[below] // np.uint64(STEP)

    def place(self, rank: int) -> int:
        """The code point before the unit of a rank; the end of the text for the number of units."""
        units = points = node = 0
        for widths, lengths, below in reversed(self.lanes):
            while node < len(widths) and units + widths[node] <= rank:
                units += int(widths[node])
                points += int(lengths[node])
                node += 1
            if units == rank:
                return points
            node = int(below[node])
        raise IndexError(rank)


def _numbers(seed: str, id_column: str) -> list[Column]:
    """The first four groups of eight digits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_middle(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, seed: str = "1:",
    moved_percent: int = 90, suffix_first_percent: int = 20,
) -> DataFrame:
    """One row per document: ``doc_id n form prefix_chars middle_chars output``.

    Of 100 texts about ``moved_percent`` get their middle moved to the end, and of these
    ``suffix_first_percent`` in a hundred are written with the suffix first (``spm``), the others ``psm``.
    """

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        starts = unit_starts(text)
        n = len(starts)
        if not n or h3 % 100 >= moved_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
            return n, "plain", None, None, text
        units = SkipList(starts, len(text))
        first, second = sorted(units.place(h % (n + 1)) for h in (h1, h2))
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        if h4 % 100 < suffix_first_percent:
            return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

        for batch in batches:
            numbers = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            rows, size, first = [], 0, 0
            for text, four in zip(batch.column(1), numbers):
                rows.append(one(text.as_py(), *four))
                size += len(rows[-1][-1])
                if size > BATCH_CHARS:
                    yield packed(batch.column(0).slice(first, len(rows)), rows)
                    first, rows, size = first + len(rows), [], 0
            if rows:
                yield packed(batch.column(0).slice(first, len(rows)), rows)

    rows = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"), *_numbers(seed, id_column))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(output: str, form: str) -> Column:
    """The text of a transformed column again, from it and its form alone.

    A moved text held no marker, and no cut or join makes a new one, so its three markers are the only ones.
    """
    parts = F.split(F.col(output), MARKER, -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    moved = F.when(F.col(form) == "psm", F.concat(one, three, two)).when(F.col(form) == "spm", F.concat(two, three, one))
    return F.coalesce(moved, F.col(output))
