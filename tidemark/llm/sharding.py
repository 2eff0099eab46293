"""Split documents into shards of near-equal bytes by histogram sort.

Documents are ordered by a 60-bit key of their text, then id, then row number.
Splitters are found by counting exact bytes in the cells between probe keys over
all partitions, again and again inside the one cell where a target lies; only
``shards - 1`` cells of ``probes`` counts each reach the driver per round.  Rows
are exchanged once, when their places are numbered.

Equal texts share a key and stay in one shard unless moving the nearest end of
their group to the boundary would miss the target by more than
``group_tolerance`` of a shard; then the group is cut at an id.

Cases: a null text has no bytes (size 1) and is equal to an empty one; a null id
sorts first; repeated rows are told apart by row number; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import number_within, text_or_empty
from tidemark.session import stored

LEVELS = ("_key", "_id", "_row")
TOP = 1 << 62


@dataclass
class Search:
    """One splitter: rows below ``prefix + (lo,)`` hold ``below`` bytes; the target is ``target``."""

    target: float
    prefix: tuple[int, ...] = ()
    lo: int = 0
    hi: int = TOP
    below: int = 0
    found: tuple[int, ...] | None = None


def _scope(s: Search) -> tuple:
    return s.prefix, s.lo, s.hi


def _inside(scope: tuple) -> Column:
    prefix, lo, hi = scope
    test = (F.col(LEVELS[len(prefix)]) >= lo) & (F.col(LEVELS[len(prefix)]) < hi)
    for level, value in zip(LEVELS, prefix):
        test &= F.col(level) == value
    return test


def _cells(rows: DataFrame, scopes: list[tuple], probes: int) -> dict[tuple, list]:
    """Exact bytes in every cell of every scope: at most ``len(scopes) * probes`` rows."""
    number, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, scope in enumerate(scopes):
        prefix, lo, hi = scope
        step = max(1, -(-(hi - lo) // probes))
        number = F.when(_inside(scope), F.lit(k)).otherwise(number)
        at = F.floor((F.col(LEVELS[len(prefix)]) - F.lit(lo)) / F.lit(float(step))).cast("long")
        cell = F.when(_inside(scope), at).otherwise(cell)
    level = F.lit(None).cast("long")
    for k, (prefix, _, _) in enumerate(scopes):
        level = F.when(F.col("_scope") == k, F.col(LEVELS[len(prefix)])).otherwise(level)
    placed = rows.select(*LEVELS, "size", number.alias("_scope"), cell.alias("_cell")).where("_scope is not null")
    sums = placed.withColumn("_level", level).groupBy("_scope", "_cell").agg(
        F.sum("size").alias("bytes"), F.min("_level").alias("lo"), F.max("_level").alias("hi")
    )
    out: dict[tuple, list] = {scope: [] for scope in scopes}
    for row in sorted(sums.collect()):
        out[scopes[row[0]]].append(row)
    return out


def find_splitters(
    rows: DataFrame, shards: int, tolerance: float = 0.001, group_tolerance: float = 0.01, probes: int = 64
) -> list[tuple[int, ...]]:
    """Keys at which each shard but the first begins."""
    total = rows.agg(F.sum("size")).head()[0] or 0
    share = total / shards
    searches = [Search(share * k) for k in range(1, shards)] if total else []
    while open_ := [s for s in searches if s.found is None]:
        scopes = list(dict.fromkeys(_scope(s) for s in open_))
        cells = _cells(rows, scopes, probes)
        for s in open_:
            below = s.below
            for cell in cells[_scope(s)]:
                if below + cell["bytes"] >= s.target or cell is cells[_scope(s)][-1]:
                    break
                below += cell["bytes"]
            after = below + cell["bytes"]
            one = cell["lo"] == cell["hi"]
            level = len(s.prefix)
            limit = group_tolerance if one and level == 0 else tolerance
            near = min(s.target - below, after - s.target) <= limit * share
            if near or (one and level == len(LEVELS) - 1):
                first = s.target - below <= after - s.target
                s.found = (*s.prefix, cell["lo"] if first else cell["hi"] + 1)
            elif one:
                s.prefix, s.lo, s.hi, s.below = (*s.prefix, cell["lo"]), -TOP, TOP, below
            else:
                s.lo, s.hi, s.below = cell["lo"], cell["hi"] + 1, below
    return [s.found for s in searches]


def _at_or_after(splitter: tuple[int, ...]) -> Column:
    test = F.lit(True)
    for level, value in reversed(list(zip(LEVELS, splitter))):
        last = level == LEVELS[len(splitter) - 1]
        test = F.col(level) >= value if last else (F.col(level) > value) | ((F.col(level) == value) & test)
    return test


def shard_by_bytes(
    df: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text",
    tolerance: float = 0.001, group_tolerance: float = 0.01,
) -> DataFrame:
    """One row per document: ``doc_id size text_crc32 shard slot``."""
    text = text_or_empty(text_column)
    rows = df.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("_key"),
        # within the range that the search covers
        F.coalesce(F.shiftright(F.col(id_column).cast("long"), 1), F.lit(-TOP)).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # written once: every round reads the narrow rows, and row numbers cannot change
    rows = stored(rows, "shard-keys")
    splitters = find_splitters(rows, shards, tolerance, group_tolerance)
    shard = sum((_at_or_after(s).cast("int") for s in splitters), F.lit(0))
    placed = rows.withColumn("shard", shard)
    numbered = number_within(placed, "shard", "_row", "slot", rows.count())
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
