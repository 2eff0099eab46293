"""Jaccard join of word-shingle sets by PartEnum signatures.

Two texts link when ``100 * |A and B| >= SHARE * |A or B|`` for their sets of
distinct ``WIDTH``-word shingles.  Equal sets are collapsed first.  Sets of about equal
size (a band and the next) differ in at most ``k`` elements if they link.  The
domain of shingles is hashed into ``k // 2 + 1`` parts, each into three pieces: some
part holds at most one of the differing elements, so two of its three
pieces agree.  Each pair of pieces is a signature, and linked sets share one.

A pair of pieces without elements is no signature.  That two linked sets agree
on empty pieces only has a chance that falls with their size; small sets are therefore
partitioned anew two to eight times, which leaves it below 1e-8 for a pair at the border.
Sets are told apart by a 64-bit hash.

Sets that link share more than one signature unless they differ in ``k`` elements, so a set can spare a few
(:func:`spare_signatures`): it leaves its largest groups.

Signatures are packed into bytes per map batch and bucket and grouped by
bucket.  Groups of at most ``SMALL_GROUP`` sets give all their pairs.  Larger groups are resolved without
forming theirs: rounds of a few leaders per group, whose links join most members.  Members that are still in different
components meet in blocks of groups, where each two of them are compared once by wide sketches.  A pair becomes a row only if
the sizes and the parity sketches of its sets allow a link.  Candidates whose wider sketches allow
one too are verified on the whole texts.  Only such pairs are left out whose ends are in one component already.

Cases: a null or empty text has an empty set and links with nothing; repeated
rows and equal sets share a component; a null id takes part but never names a
component unless all its members are null; an empty table gives an empty
result; other columns are ignored by :func:`near_components` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.components import components
from tidemark.llm.shingles import U, mix, set_key, sets_of, shingle_sets
from tidemark.session import stored

SHARE = 75
SMALL_GROUP = 4
LEADERS = 6
ROUNDS = 4
#: Signatures of a bucket, which one task groups in memory, and of a map batch.
BUCKET_SIGNATURES = 3_000_000
BATCH_SIGNATURES = 1_500_000
#: Pairs whose texts are held in memory at once.
VERIFIED_ROWS = 500
MOST_COUNTED = 60_000
SKETCH = 8
#: Cells of the wide sketch, which tells long sets apart as well.
WIDE = 4096
#: Pairs, and pairs of members of groups, from which on wide sketches are made; these change speed only.
MANY_PAIRS, MANY_IN_GROUPS = 20_000, 1_000_000
#: Rows of a block of groups, and members of a part of a large group; pairs that are formed and compared at a time.
BLOCK_ROWS, PART_MEMBERS = 50_000, 1_000
MEETINGS, SKETCHED = 1_000_000, 20_000
#: An instance has one part more for so many differing elements.
MORE_PARTS = 20
SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH)]
SPARE_COLUMNS = ["spare_even", "spare_odd"]


def band_edges(largest: int) -> list[int]:
    """First size of every band: a set links only with sets of its own band and the two next to it."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // SHARE + 1)
    edges.append(edges[-1] * 100 // SHARE + 1)
    return edges


EDGES = band_edges(1 << 31)
_ODD = np.random.default_rng(22).integers(1, 1 << 63, 3, np.uint64) * U(2) + U(1)
_SEEDS = np.random.default_rng(23).integers(1, 1 << 63, (len(EDGES) + 1) << 8, np.uint64) * U(2) + U(1)


def instances(size: int) -> list[tuple[int, int]]:
    """Number and greatest distance of the two instances that a set takes part in.

    Instance ``j`` holds band ``j - 1`` against itself and against band ``j``.
    """
    band = int(np.searchsorted(EDGES, size, "right")) - 1
    return [(j, (EDGES[j] + EDGES[j + 1] - 2) * (100 - SHARE) // (100 + SHARE)) for j in (band, band + 1)]


def repeats(size: int) -> int:
    return 1 if size >= 100 else 2 if size >= 50 else 4 if size >= 16 else 8


def parts_of(distance: int) -> int:
    """Parts of an instance; linked sets share more than one signature if there are more than ``distance // 2 + 1``."""
    return distance // 2 + 1 + distance // MORE_PARTS


def _slots(elements: np.ndarray, j: int, turn: int, parts: int) -> np.ndarray:
    """The piece of every element."""
    return (((elements * _SEEDS[(j << 8) + turn]) >> U(32)) * U(3 * parts) >> U(32)).view(np.int64)


def signatures(elements: np.ndarray) -> np.ndarray:
    """All signatures of a set; its elements are hashes already.  The last bit is that of the instance."""
    found = []
    for j, distance in instances(len(elements)):
        parts = parts_of(distance)
        for turn in range(repeats(len(elements))):
            seed = U((j << 8) + turn)
            slot = _slots(elements, j, turn, parts)
            sums = np.zeros(3 * parts, np.uint64)
            np.add.at(sums, slot, elements)
            sums = sums.reshape(-1, 3)
            # the pairs of pieces, each named after the piece left out
            left, right = sums[:, (0, 0, 1)], sums[:, (1, 2, 2)]
            name = np.arange(3 * parts, dtype=np.uint64).reshape(-1, 3) + (seed << U(40))
            both = mix(left * _ODD[0] + right * _ODD[1] + name * _ODD[2])
            found.append((both & ~U(1) | U(j & 1))[(left != 0) | (right != 0)])
    return np.concatenate(found)


def spare_signatures(elements: np.ndarray) -> list[int]:
    """How many signatures of its even and of its odd instance a set shares at least, beyond one, with any set it links with.

    A part without a differing element gives three shared signatures, one with one of them one; those
    of empty pieces are no signatures.  One more is left out of the count, for signatures that are equal by chance.
    """
    found, size = [0, 0], len(elements)
    for j, distance in instances(size) if size else ():
        parts, largest = parts_of(distance), min(size * 100 // SHARE, EDGES[j + (size < EDGES[j])] - 1)
        turns = repeats(max(size, largest))  # a larger set may be partitioned less often
        differ = (size + largest) * (100 - SHARE) // (100 + SHARE)
        shared = turns * (3 * parts - 2 * differ if differ <= parts else 2 * parts - differ)
        if shared <= 2:
            continue
        for turn in range(turns):
            full = np.bincount(_slots(elements, j, turn, parts), minlength=3 * parts).reshape(-1, 3) > 0
            filled = full.sum(axis=1)
            shared -= int(3 * (filled == 0).sum() + (filled == 1).sum())
        found[j & 1] = max(0, shared - 2)
    return found


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of ``64 * SKETCH`` cells: sketches differ in no more bits than sets in elements."""
    return _parity(elements, 64 * SKETCH)


def _parity(elements: np.ndarray, size: int) -> np.ndarray:
    cells = np.bincount((elements >> U(20)).view(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _split_counts(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Each count as ``more`` counts of at most ``MOST_COUNTED``."""
    first = np.cumsum(more) - more
    part = np.full(more.sum(), MOST_COUNTED)
    part[first + more - 1] = counts - (more - 1) * MOST_COUNTED
    return part


def _sets(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id hash n_shingles key s0 .. spare_even spare_odd`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bits, spare = [], [], [], []
            for _, elements in sets_of(batch.column(2)):
                sizes.append(len(elements))
                keys.append(set_key(elements))
                bits.append(sketch(elements))
                spare.append(spare_signatures(elements))
            grid = np.array(bits, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                 *(pa.array(grid[:, k]) for k in range(SKETCH)), *(pa.array([s[k] for s in spare], pa.int64()) for k in range(2))],
                ["doc_id", "hash", "n_shingles", "key", *SKETCH_COLUMNS, *SPARE_COLUMNS],
            )

    rows = _texts(df, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ["hash", "n_shingles", "key", *SKETCH_COLUMNS, *SPARE_COLUMNS])
    return rows.mapInArrow(run, f"doc_id {kind}, {longs}")


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_or_empty(text_column)
    return df.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _packed(df: DataFrame, text_column: str, buckets: int) -> DataFrame:
    """The signatures of many sets as bytes per bucket, each set once per task.

    ``owners`` holds the keys of the sets that have signatures in the bucket,
    ``counts`` how many, and ``signatures`` their low 40 bits, set after set.
    """

    def pack(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        table = np.array([key for key, _ in held], np.int64)
        every = np.concatenate([s for _, s in held])
        owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
        bucket = ((every >> U(40)) * U(buckets) >> U(24)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        low = every.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        out = []
        for b in (np.diff(edges) > 0).nonzero()[0]:
            at = order[edges[b] : edges[b + 1]]
            owners, counts = np.unique(owner[at], return_counts=True)
            # a set with more signatures than two bytes count is listed again
            more = counts // MOST_COUNTED + 1
            owners, counts = np.repeat(owners, more), _split_counts(counts, more)
            out.append((int(b), table[owners].tobytes(), counts.astype("<u2").tobytes(), low[at].tobytes()))
        names = ["bucket", "owners", "counts", "signatures"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            for _, elements in sets_of(batch.column(0)):
                key = set_key(elements)
                if not len(elements) or key in seen:
                    continue
                seen.add(key)
                held.append((key, signatures(elements)))
                size += len(held[-1][1])
                if size >= BATCH_SIGNATURES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    rows = df.select(text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, "bucket long, owners binary, counts binary, signatures binary")


def _groups(packed: DataFrame) -> DataFrame:
    """``sig a b``: pairs of small groups (``sig`` is null), and members ``a`` of larger groups of ``b`` sets."""

    def run(table: pa.Table) -> pa.Table:
        keys, sigs = [], []
        for row in table.select(["owners", "counts", "signatures"]).to_batches():
            for owner, count, low in zip(*(row.column(k) for k in range(3))):
                keys.append(np.repeat(np.frombuffer(owner.as_buffer(), np.int64), np.frombuffer(count.as_buffer(), "<u2")))
                wide = np.zeros((len(keys[-1]), 8), np.uint8)
                wide[:, :5] = np.frombuffer(low.as_buffer(), np.uint8).reshape(-1, 5)
                sigs.append(wide.view("<u8").ravel())
        sig, key = np.concatenate(sigs), np.concatenate(keys)
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        sig, key = sig[shared], key[shared]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        if len(sig):
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
            sig, key = sig[fresh], key[fresh]
        _, first, size = np.unique(sig, return_index=True, return_counts=True)
        pairs = [np.zeros((0, 2), np.int64)]
        for m in range(2, SMALL_GROUP + 1):
            at = first[size == m]
            pairs += [np.stack([key[at + i], key[at + j]], 1) for i in range(m) for j in range(i + 1, m)]
        pair = np.unique(np.concatenate(pairs), axis=0)
        large = np.repeat(size > SMALL_GROUP, size)
        bucket = table.column("bucket")[0].as_py()
        names = (sig[large] | (U(bucket) << U(40))).view(np.int64)
        blank = pa.nulls(len(pair), pa.int64())
        a = pa.chunked_array([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(key[large])])
        b = pa.chunked_array([pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(np.repeat(size, size)[large])])
        return pa.table([pa.chunked_array([blank, pa.array(names)]), a, b], ["sig", "a", "b"])

    return packed.groupBy("bucket").applyInArrow(run, "sig long, a long, b long")


def _may_link(left: str, right: str) -> Column:
    """A condition that every linked pair meets: sizes, and bits in which the sketches differ."""
    n, m = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    bits = sum(
        (F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in SKETCH_COLUMNS), F.lit(0)
    )
    sizes = (F.least(n, m) * 100 >= F.greatest(n, m) * SHARE)
    return sizes & (bits * (100 + SHARE) <= (n + m) * (100 - SHARE))


def _zipped(texts: DataFrame) -> DataFrame:
    """``doc_id hash zipped``: texts compressed, as they are dealt by key more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            zipped = [press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(zipped, pa.binary())], ["doc_id", "hash", "zipped"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, hash long, zipped binary")


def _wide_sketches(held: DataFrame) -> DataFrame:
    """``key n bits``: size and wide sketch of the set of every text of ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, VERIFIED_ROWS):
                batch = whole.slice(at, VERIFIED_ROWS)
                found = shingle_sets([unzip(z.as_py()).decode("utf-8", "surrogatepass") for z in batch.column(1)])
                bits = pa.array([_parity(elements, WIDE).tobytes() for elements in found], pa.binary())
                sizes = pa.array([len(elements) for elements in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, bits], ["key", "n", "bits"])

    return held.select("key", "zipped").mapInArrow(run, "key long, n long, bits binary")


def _near(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs ``a b`` whose wide sketches allow a link; no pair that links is left out."""
    joined = pairs.join(wide.select(F.col("key").alias("a"), "n", F.col("bits").alias("x")), "a")
    joined = joined.join(wide.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for k in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            allowed = pa.array(differ * (100 + SHARE) <= both * (100 - SHARE))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(allowed)

    return joined.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, held: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """The pairs ``a b`` whose whole texts link; ``held`` has ``key zipped``.

    With ``wide``, the wide sketches of these texts, only texts of pairs that these allow are dealt out.
    """
    if wide is not None:
        pairs = stored(_near(pairs, wide), "near-pairs")
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
        held = held.join(ends, "key", "left_semi")
    joined = pairs.join(held.select(F.col("key").alias("a"), F.col("zipped").alias("left")), "a")
    joined = joined.join(held.select(F.col("key").alias("b"), F.col("zipped").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress

        def sets(keys: list[int], zipped: pa.Array) -> dict[int, np.ndarray]:
            first = {key: k for k, key in enumerate(keys)}
            found = shingle_sets([unzip(zipped[k].as_py()).decode("utf-8", "surrogatepass") for k in first.values()])
            return dict(zip(first, found))

        for whole in batches:
            for at in range(0, whole.num_rows, VERIFIED_ROWS):
                batch = whole.slice(at, VERIFIED_ROWS)
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                one, two, keep = sets(a, batch.column(2)), sets(b, batch.column(3)), []
                for x, y in zip(a, b):
                    common = len(np.intersect1d(one[x], two[y], assume_unique=True))
                    keep.append(100 * common >= SHARE * (len(one[x]) + len(two[y]) - common))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("key").alias("a"), F.struct("n_shingles", *SKETCH_COLUMNS).alias("x"))
    right = sets.select(F.col("key").alias("b"), F.struct("n_shingles", *SKETCH_COLUMNS).alias("y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(_may_link("x", "y")).select("a", "b")


def _without_spare(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members ``sig key`` without the most frequent signatures that a set can spare, with size and sketch.

    Of the signatures that two linked sets share, the one of the smallest group is left: as many of the others come
    before it as either set spares.
    """
    joined = members.select("sig", F.col("a").alias("key"), F.col("b").alias("_size")).join(sets, "key")
    odd = F.col("sig").bitwiseAND(F.lit(1))
    ranked = Window.partitionBy("key", "_odd").orderBy(F.desc("_size"), "sig")
    joined = joined.withColumn("_odd", odd).withColumn("_place", F.row_number().over(ranked))
    needed = joined.where(F.col("_place") > F.when(F.col("_odd") == 0, F.col("spare_even")).otherwise(F.col("spare_odd")))
    return needed.select("sig", "key", "n_shingles", *SKETCH_COLUMNS)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    joined = members.join(labels, members["key"] == labels["node"], "left")
    return joined.select("sig", "key", F.coalesce("label", "key").alias("label"), "n_shingles", *SKETCH_COLUMNS)


def _open(members: DataFrame) -> DataFrame:
    """Members of groups that still lie in several components."""
    several = members.groupBy("sig").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l != _h")
    return members.join(several.select("sig"), "sig")


def _leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with up to ``LEADERS`` members of its group, chosen by hash, that it may link with and is apart from."""
    one = F.struct("key", "label", "n_shingles", *SKETCH_COLUMNS)
    order = [F.min_by(one, F.xxhash64("key", F.lit(turn * LEADERS + k))) for k in range(LEADERS)]
    leaders = members.groupBy("sig").agg(F.array_distinct(F.array(*order)).alias("_leaders"))
    leaders = leaders.select("sig", F.explode("_leaders").alias("_one")).select("sig", "_one.*")
    x, y = members.alias("x"), leaders.alias("y")
    apart = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y")
    return x.join(y, apart).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """``block side sig key label``: the members of groups dealt out so that each two of a group meet in a block.

    Groups with the same first member, by a hash, share a block as far as it holds ``BLOCK_ROWS`` rows, as these mostly
    have other members in common too.  A group of more than ``PART_MEMBERS`` is cut into parts: a block holds one part
    (``side`` 0) or two whose members meet each other's only (1 and 2).
    """
    sigs = members.groupBy("sig").agg(F.count(F.lit(1)).alias("_m"), F.min_by("key", F.xxhash64("key")).alias("_owner"))
    sigs = sigs.withColumn("_parts", F.ceil(F.col("_m") / PART_MEMBERS).cast("int"))
    owners = sigs.groupBy("_owner").agg(F.sum(F.col("_m") * F.col("_parts")).alias("_rows"))
    rows = owners.agg(F.sum("_rows")).head()[0] or 0
    buckets = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BLOCK_ROWS))
    sigs = sigs.join(owners, "_owner")
    turn = F.pmod(F.xxhash64("sig"), F.ceil(F.col("_rows") / BLOCK_ROWS))
    sigs = sigs.select("sig", "_parts", "_rows", F.xxhash64("_owner", turn).alias("_name"))
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("_parts")).cast("int")
    dealt = members.select("sig", "key", "label").join(sigs, "sig").withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    apart = F.xxhash64("_name", F.least("_own", "_other"), F.greatest("_own", "_other"))
    together = F.pmod("_name", F.lit(buckets))
    block = F.when(F.col("_rows") <= BLOCK_ROWS, together).otherwise(apart)
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return dealt.select(block.alias("block"), side.alias("side"), "sig", "key", "label")


def _meetings(sig: np.ndarray, side: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of members that meet, in pieces of about ``MEETINGS``."""
    order = np.lexsort((side, sig))
    sig, side, place = sig[order], side[order], place[order]
    _, first, size = np.unique(sig[side == 0], return_index=True, return_counts=True)
    alone = place[side == 0]
    for m in np.unique(size[size > 1]):
        x, y = np.triu_indices(m, 1)
        at = first[size == m]
        step = max(1, MEETINGS // len(x))
        for k in range(0, len(at), step):
            yield alone[(at[k : k + step, None] + x).ravel()], alone[(at[k : k + step, None] + y).ravel()]
    names, first = np.unique(sig[side > 0], return_index=True)
    cut, second = place[side > 0], side[side > 0] == 2
    for at, end in zip(first, [*first[1:], len(cut)]):
        left, right = cut[at:end][~second[at:end]], cut[at:end][second[at:end]]
        yield np.repeat(left, len(right)), np.tile(right, len(left))


def _cross_pairs(members: DataFrame, wide: DataFrame) -> DataFrame:
    """All pairs of a group that are in different components and whose wide sketches allow a link."""
    dealt = stored(_blocks(members), "blocks")
    sets = dealt.select(F.col("block").alias("of"), F.col("key").alias("key"), "label")
    sets = sets.groupBy("of", "key").agg(F.first("label").alias("label")).join(wide, "key")

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        key, label, n = (held.column(c).to_numpy() for c in ("key", "label", "n"))
        bits = np.frombuffer(b"".join(held.column("bits").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
        order = np.argsort(key)
        key, label, n, bits = key[order], label[order], n[order], bits[order]
        place = np.searchsorted(key, rows.column("key").to_numpy())
        codes = np.zeros(0, np.int64)
        for x, y in _meetings(rows.column("sig").to_numpy(), rows.column("side").to_numpy(), place):
            code = np.unique(np.minimum(x, y) * len(key) + np.maximum(x, y))
            x, y = code // len(key), code % len(key)
            least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            codes = np.union1d(codes, code[(label[x] != label[y]) & (least * 100 >= most * SHARE)])
        x, y = codes // max(1, len(key)), codes % max(1, len(key))
        kept = [np.zeros(0, bool)]
        for k in range(0, len(x), SKETCHED):
            i, j = x[k : k + SKETCHED], y[k : k + SKETCHED]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            kept.append(differ * (100 + SHARE) <= (n[i] + n[j]) * (100 - SHARE))
        kept = np.concatenate(kept)
        return pa.table([pa.array(key[x[kept]], pa.int64()), pa.array(key[y[kept]], pa.int64())], ["a", "b"])

    met = dealt.select("block", "side", "sig", "key").groupBy("block").cogroup(sets.groupBy("of"))
    return met.applyInArrow(run, "a long, b long").distinct()


def _cross_count(members: DataFrame) -> int:
    """How many pairs of members of a group are in different components."""
    sizes = members.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("m"))
    pairs = sizes.groupBy("sig").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p"))
    return int(pairs.agg(F.sum("p")).head()[0] or 0)


def near_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id n_shingles component_id``, and ``hash key component`` to find rows again."""
    docs = stored(_sets(df, id_column, text_column), "sets")
    sets = docs.where("n_shingles > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("one"),
        F.first("n_shingles").alias("n_shingles"), *(F.first(c).alias(c) for c in [*SKETCH_COLUMNS, *SPARE_COLUMNS]),
    )
    sets = stored(sets, "distinct-sets")
    volume = sets.agg(F.sum("n_shingles")).head()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(1.2 * volume / BUCKET_SIGNATURES))
    groups = stored(_groups(_packed(df, text_column, buckets)), "signature-groups")

    few = stored(_allowed(groups.where("sig is null").select("a", "b").distinct(), sets), "pairs")
    members = stored(_without_spare(groups.where("sig is not null"), sets), "members")
    wanted = few.select(F.col("a").alias("key")).union(few.select("b")).union(members.select("key")).distinct()
    found = wanted.join(sets, "key").select("key", F.col("one.doc_id").alias("_id"), F.col("one.hash").alias("_hash"))
    texts = _zipped(_texts(df, id_column, text_column))
    held = texts.join(found, (texts["hash"] == F.col("_hash")) & texts["doc_id"].eqNullSafe(F.col("_id")))
    held = stored(held.groupBy("key").agg(F.first("zipped").alias("zipped")), "candidate-texts")

    wide = []

    def sketches() -> DataFrame:
        if not wide:
            wide.append(stored(_wide_sketches(held), "wide-sketches"))
        return wide[0]

    def verified(pairs: DataFrame, many: bool) -> DataFrame:
        return _verified(pairs, held, sketches() if many else None)

    links = stored(verified(few, few.count() >= MANY_PAIRS), "links")
    labels = components(links)
    members = stored(_open(_labelled(members, labels)), "members")
    left = _cross_count(members)
    for turn in range(ROUNDS):
        if not left:
            break
        more = verified(_leader_pairs(members, turn), left >= MANY_IN_GROUPS)
        links = links.unionByName(stored(more, "links"))
        labels = components(links)
        members = stored(_open(_labelled(members.drop("label"), labels)), "members")
        before, left = left, _cross_count(members)
        if 2 * left > before:
            break
    if left:
        cross = stored(_cross_pairs(members, sketches()), "near-pairs")
        ends = cross.select(F.col("a").alias("key")).union(cross.select("b"))
        links = links.unionByName(stored(_verified(cross, held.join(ends, "key", "left_semi")), "links"))
        labels = components(links)
    joined = docs.select("doc_id", "n_shingles", "hash", "key").join(labels, docs["key"] == labels["node"], "left")
    alone = F.struct(F.lit(True).alias("alone"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("of"))
    together = F.struct(F.lit(False).alias("alone"), F.coalesce("label", "key").alias("of"))
    # an empty set is a component of its own, and is never grouped
    rows = joined.withColumn("component", F.when(F.col("n_shingles") > 0, together).otherwise(alone))
    rows = rows.select("doc_id", "n_shingles", "hash", "key", "component")
    names = rows.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("_least"))
    grouped = rows.where("n_shingles > 0").join(names, "component").withColumnRenamed("_least", "component_id")
    single = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return grouped.unionByName(single)


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns; rows without shingles stay."""
    found = near_components(df, id_column, text_column)
    chosen = found.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("one")
    )
    chosen = chosen.select(F.col("one.doc_id").alias("_id"), F.col("one.hash").alias("_hash"))
    rows = df.select(
        F.struct("*").alias("_row"), F.col(id_column).alias("_doc"), F.xxhash64(text_or_empty(text_column)).alias("_text"),
        F.regexp_like(text_or_empty(text_column), F.lit(r"[^\x20\x09-\x0D]")).alias("_some"),
    )
    kept = rows.where("_some").join(chosen, (F.col("_text") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id")))
    # rows repeated with id and text would all be found
    once = kept.groupBy("_doc", "_text").agg(F.first("_row").alias("_row"))
    return once.select("_row.*").unionByName(rows.where("not _some").select("_row.*"))
