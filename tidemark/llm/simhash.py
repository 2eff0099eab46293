"""Near-duplicate texts by SimHash and the generalised pigeonhole principle.

A fingerprint has 64 bits; texts link when their fingerprints differ in at most
``DIFFERENCE`` of them.  The work after the fingerprints is on distinct ones only:

1. Correlations of all bits (one 64 x 64 sum over every fingerprint) deal the bits to
   ``PARTS`` partitions; correlated bits come together, so the others stay selective.
2. With thresholds that add up to ``DIFFERENCE - PARTS + 1`` (-1: partition not probed),
   two linked fingerprints agree within the threshold of at least one partition.  Each
   fingerprint gets the thresholds that cost it least, by dynamic programming over the
   partitions on estimated numbers of candidates.
3. Every fingerprint is listed under its value of each partition, and probes the values
   within its thresholds.  Candidates are compared in full; links make components.

Estimates come from counts of all fingerprints: small histograms of blocks of bits, taken
as independent, and the exact counts of the values that more than a thousandth of them
share.  Lists above ``LONG_LIST`` are cut again by the plain principle: what is left of the
difference is spread over pieces of the other bits, one of which must then agree.

Cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; fewer words than ``WIDTH`` make one shingle; a null id never names a component
unless all its ids are null; long texts are hashed in slices; an empty table gives an empty
result; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.components import components
from tidemark.plans.joins import join_per_key
from tidemark.session import stored

BITS = 64
WIDTH = 3
SEED = 42
DIFFERENCE = 2
PARTS = 3
#: Bits of a block, whose values are counted.
BLOCK = 8
#: Values that more than one fingerprint in so many shares are counted exactly.
SHARE = 1000
#: What a probe costs next to the comparison of a candidate.
PROBE_COST = 4.0
#: Lists longer than this are cut again.
LONG_LIST = 64
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20
#: Rows that are compared with the shared values at once.
ROWS = 4096

_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: str) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, slice by slice."""
    data = text.encode("utf-8", "surrogatepass").lower()
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    last: list[bytes] = []
    start, some = 0, False
    while start < len(data):
        cut = _WHITE.search(data, min(len(data), start + SLICE))
        end = cut.start() if cut else len(data)
        words = last + data[start:end].split()
        start = end
        if len(words) >= WIDTH:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: 1 - WIDTH].tolist(), ends[WIDTH - 1 :].tolist())
            yield np.array([hashed(joined[a:b]) for a, b in spans], np.uint64)
        last = words[1 - WIDTH :]
    if last and not some:
        yield np.array([hashed(b" ".join(last))], np.uint64)


def as_bits(numbers: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per number, lowest bit first."""
    return np.unpackbits(numbers.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint, as an unsigned number."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in _hashes(text):
        ones += as_bits(hashes).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id fingerprint``, the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    rows = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _sums(rows: DataFrame, cells: int, count) -> np.ndarray:
    """``count(numbers)`` of every batch, ``cells`` whole numbers, added up over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(_unsigned(batch.column(0)))
        some = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    found = np.zeros(cells, np.int64)
    # at most ``cells`` rows, whatever the table's size
    for cell, n in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        found[cell] = n
    return found


def _together(numbers: np.ndarray) -> np.ndarray:
    ones = as_bits(numbers).astype(np.float64)
    return (ones.T @ ones).astype(np.int64).ravel()


def deal_bits(together: np.ndarray, total: int, parts: int = PARTS) -> list[list[int]]:
    """Bits in partitions of nearly equal size, each grown by the bit that correlates most with it."""
    share = together / max(total, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0))
    scale = np.outer(spread, spread)
    related = np.abs(np.divide(share - np.outer(mean, mean), scale, out=np.zeros_like(share), where=scale > 0))
    np.fill_diagonal(related, 0)
    left, dealt = list(range(BITS)), []
    for part in range(parts):
        size = len(left) // (parts - part)
        own = [left[int(related[np.ix_(left, left)].sum(axis=1).argmax())]]
        while len(own) < size:
            rest = [b for b in left if b not in own]
            own.append(rest[int(related[np.ix_(rest, own)].sum(axis=1).argmax())])
        dealt.append(own)
        left = [b for b in left if b not in own]
    return dealt


class Layout:
    """Where the partitions, and the blocks of each, lie after the bits were moved together."""

    def __init__(self, dealt: list[list[int]]):
        self.order = [bit for own in dealt for bit in own]
        self.widths = [len(own) for own in dealt]
        self.offsets = np.cumsum([0, *self.widths])[:-1].tolist()
        self.blocks: list[list[tuple[int, int]]] = []
        for at, width in zip(self.offsets, self.widths):
            sizes = [len(x) for x in np.array_split(np.arange(width), -(-width // BLOCK))]
            self.blocks.append(list(zip((np.cumsum([at, *sizes])[:-1]).tolist(), sizes)))

    def move(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros_like(numbers)
        for k, bit in enumerate(self.order):
            out |= ((numbers >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        return out

    def value(self, part: int) -> Column:
        return F.shiftrightunsigned("p", self.offsets[part]).bitwiseAND(F.lit((1 << self.widths[part]) - 1).cast("long"))


def _field(numbers: np.ndarray, at: int, width: int) -> np.ndarray:
    return ((numbers >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)


def balls(counts: np.ndarray, most: int) -> np.ndarray:
    """For each value of a block, the count of values that differ in exactly 0, 1, ... ``most`` bits."""
    values = np.arange(len(counts))
    away = np.bitwise_count(values[:, None] ^ values[None, :])
    return np.stack([(away == d) @ counts for d in range(most + 1)]).astype(float)


class Estimates:
    """Estimated numbers of candidates of a probe, from the counts of blocks and of shared values."""

    def __init__(self, layout: Layout, total: int, counts: list[np.ndarray], shared: dict[int, tuple], most: int = DIFFERENCE):
        self.layout, self.total, self.most, self.shared = layout, total, most, shared
        self.balls = [[] for _ in layout.widths]
        flat = iter(counts)
        for part, blocks in enumerate(layout.blocks):
            self.balls[part] = [balls(next(flat), most) / max(total, 1) for _ in blocks]

    def candidates(self, part: int, numbers: np.ndarray) -> np.ndarray:
        """Per threshold (rows of the result, from 0) the candidates of each number."""
        exact = np.zeros((self.most + 1, len(numbers)))
        exact[0] = 1.0
        for (at, width), ball in zip(self.layout.blocks[part], self.balls[part]):
            own = ball[:, _field(numbers, at, width)]
            exact = np.stack([sum(exact[d - e] * own[e] for e in range(d + 1)) for d in range(self.most + 1)])
        found = exact.cumsum(axis=0) * self.total
        if part in self.shared:
            values, counts = self.shared[part]
            mine = _field(numbers, self.layout.offsets[part], self.layout.widths[part])
            for first in range(0, len(mine), ROWS):
                away = np.bitwise_count(mine[first : first + ROWS, None] ^ values[None, :])
                for d in range(self.most + 1):
                    known = (away <= d) @ counts
                    found[d, first : first + ROWS] = np.maximum(found[d, first : first + ROWS], known)
        return found


def probes_of(width: int, threshold: int) -> list[int]:
    """All masks of at most ``threshold`` bits; none for -1."""
    return [sum(1 << b for b in bits) for d in range(threshold + 1) for bits in combinations(range(width), d)]


def allocate(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Thresholds per partition (rows) and number that add up to ``total`` at the least cost.

    ``costs[part][threshold + 1]`` holds the cost of each number, from threshold -1 on.
    Dynamic programming: after each partition the least cost of every sum so far.
    """
    parts, choices, n = len(costs), len(costs[0]), len(costs[0][0])
    # a sum is kept as the sum of threshold + 1, from 0 to total + parts
    top = total + parts
    best = np.full((top + 1, n), np.inf)
    best[0] = 0.0
    taken = np.zeros((parts, top + 1, n), np.int8)
    for part in range(parts):
        now = np.full((top + 1, n), np.inf)
        for choice in range(choices):
            for before in range(top + 1 - choice):
                cost = best[before] + costs[part][choice]
                better = cost < now[before + choice]
                now[before + choice][better] = cost[better]
                taken[part, before + choice][better] = choice
        best = now
    out = np.zeros((parts, n), np.int8)
    state = np.full(n, top)
    for part in reversed(range(parts)):
        out[part] = taken[part, state, np.arange(n)] - 1
        state = state - (out[part] + 1)
    return out


def thresholds(estimates: Estimates, numbers: np.ndarray) -> np.ndarray:
    """The cheapest thresholds of each number that keep the principle."""
    layout, most = estimates.layout, estimates.most
    costs = []
    for part, width in enumerate(layout.widths):
        probing = PROBE_COST * np.array([len(probes_of(width, d)) for d in range(most + 1)])[:, None]
        costs.append(np.vstack([np.zeros((1, len(numbers))), estimates.candidates(part, numbers) + probing]))
    return allocate(costs, most - len(layout.widths) + 1)


def _measured(moved: DataFrame, layout: Layout, total: int) -> Estimates:
    flat = [block for blocks in layout.blocks for block in blocks]
    firsts = np.cumsum([0, *(1 << width for _, width in flat)])

    def count(numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_field(numbers, at, w), minlength=1 << w) for at, w in flat])

    cells = _sums(moved.select("p"), int(firsts[-1]), count)
    counts = [cells[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), layout.value(k).alias("value")) for k in range(PARTS)]))
    listed = moved.select(values.alias("v")).groupBy("v.part", "v.value").agg(F.count(F.lit(1)).alias("n"))
    # fewer than SHARE values per partition, whatever the table's size
    often: dict[int, list] = {}
    for part, value, n in listed.where(F.col("n") * SHARE > total).where("n > 1").collect():
        often.setdefault(part, []).append((value, n))
    shared = {part: tuple(np.array(x, np.int64) for x in zip(*rows)) for part, rows in often.items()}
    return Estimates(layout, total, counts, shared)


def _probes(moved: DataFrame, estimates: Estimates) -> DataFrame:
    """``part value q used``: the values each fingerprint looks up, and the bits of difference that takes."""
    layout = estimates.layout
    masks = [[np.array(probes_of(w, d), np.int64) for d in range(estimates.most + 1)] for w in layout.widths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _unsigned(batch.column(0))
            if not len(numbers):
                continue
            chosen = thresholds(estimates, numbers)
            for part, width in enumerate(layout.widths):
                for d in range(estimates.most + 1):
                    own = numbers[chosen[part] == d]
                    every = masks[part][d]
                    value = _field(own, layout.offsets[part], width)
                    found = [
                        pa.array(np.full(len(own) * len(every), part, np.int32)),
                        pa.array((value[:, None] ^ every[None, :]).ravel()),
                        pa.array(np.repeat(own.view(np.int64), len(every))),
                        pa.array(np.tile(np.bitwise_count(every).astype(np.int32), len(own))),
                    ]
                    if len(own):
                        yield pa.RecordBatch.from_arrays(found, ["part", "value", "q", "used"])

    return moved.select("p").mapInArrow(run, "part int, value long, q long, used int")


def _rest(layout: Layout, number: str, part: int) -> Column:
    """The bits outside a partition, moved to the low end."""
    by = (layout.offsets[part] + layout.widths[part]) % BITS
    turned = F.shiftrightunsigned(number, by).bitwiseOR(F.shiftleft(number, BITS - by)) if by else F.col(number)
    return turned.bitwiseAND(F.lit((1 << (BITS - layout.widths[part])) - 1).cast("long"))


def _pieces(layout: Layout, number: str, left: int) -> Column:
    """The bits outside the partition of a row in ``left + 1`` pieces, one of which agrees if at most ``left`` bits differ."""
    out = None
    for part, width in enumerate(layout.widths):
        rest, size = _rest(layout, number, part), BITS - width
        cuts = [size * k // (left + 1) for k in range(left + 2)]
        own = F.array(*[
            F.struct(
                F.lit(left).alias("left"), F.lit(k).alias("piece"),
                F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"),
            )
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        ])
        out = F.when(F.col("part") == part, own) if out is None else out.when(F.col("part") == part, own)
    return out


def _links(moved: DataFrame, estimates: Estimates) -> DataFrame:
    """``a b``: all fingerprints that differ in at most ``DIFFERENCE`` bits."""
    layout, most = estimates.layout, estimates.most
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), layout.value(k).alias("value")) for k in range(PARTS)]))
    lists = moved.select("p", listed.alias("v")).select("p", "v.part", "v.value")
    long = lists.groupBy("part", "value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG_LIST)
    long = long.select("part", "value", F.lit(True).alias("long"))
    plain = F.array(F.struct(F.lit(-1).alias("left"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("bits")))
    every = F.concat(*[_pieces(layout, "p", left) for left in range(most + 1)])
    own = F.when(F.col("used") == most, _pieces(layout, "q", 0))
    for left in range(1, most + 1):
        own = own.when(F.col("used") == most - left, _pieces(layout, "q", left))
    keys = ["part", "value", "left", "piece", "bits"]
    index = lists.join(long, ["part", "value"], "left").withColumn("k", F.explode(F.when(F.col("long"), every).otherwise(plain)))
    probes = _probes(moved, estimates).join(long, ["part", "value"], "left")
    probes = probes.withColumn("k", F.explode(F.when(F.col("long"), own).otherwise(plain)))
    x = index.select("part", "value", "k.*", "p").alias("x")
    y = probes.select("part", "value", "k.*", "q").alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    near = F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.q"))) <= most
    found = x.join(y, [*same, F.col("x.p") != F.col("y.q"), near])
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id fingerprint component_id`` (fingerprint as a signed number)."""
    docs = stored(fingerprints(df, id_column, text_column), "fingerprints")
    distinct = stored(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    total = distinct.count()
    layout = Layout(deal_bits(_sums(distinct.select("fingerprint"), BITS * BITS, _together).reshape(BITS, BITS), total))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = layout.move(_unsigned(batch.column(0))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(moved)], ["fingerprint", "least", "p"])

    kind = distinct.schema["least"].dataType.simpleString()
    moved = stored(distinct.mapInArrow(move, f"fingerprint long, least {kind}, p long"), "moved-fingerprints")
    labels = components(stored(_links(moved, _measured(moved, layout, total)), "fingerprint-links"))
    named = moved.join(labels, moved["p"] == labels["node"], "left")
    named = named.select("fingerprint", "least", F.coalesce("label", "p").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = join_per_key(named.select("fingerprint", "component"), least, ["component"], ["fingerprint"])
    return join_per_key(docs, named.select("fingerprint", "component_id"), ["fingerprint"], ["doc_id"]).select(
        "doc_id", "fingerprint", "component_id"
    )
