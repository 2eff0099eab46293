"""Code lengths of texts under a context-tree weighting model of bytes.

A text is coded as its words (A-Z lower-cased, without white space), each followed by
a space, and a line feed at the end.  Every byte is coded as eight binary decisions, each in
the context of up to ``DEPTH`` bytes before it in its word; the contexts of one decision form
a tree.  A node's estimate is Krichevsky-Trofimov's over the bits seen there, and a
node mixes its own estimate with that of the next longer context by the
weighting of the context-tree method, so all depths are mixed.  A context that
was not seen takes no part.

Two such models score a text.  In that of ``score`` contexts end at a word's start; in that of
``running_score`` they are the bytes before in the running text, over spaces and words.

Words of the first do not look at each other, so it is counted and scored per
distinct word: batches of documents give their distinct words with counts, each
distinct word's code length goes back to the batches that hold it, and a document is kept as
the places of its words there.  For the second, batches give the distinct grams of their running texts
with counts, packed by their last ``SHORT`` bytes of context, and get back the code length of each; the texts
are put together from their words again.
No model is ever
written: grams that share their last ``SHORT`` bytes of context meet in one task, which
holds all longer contexts of theirs.  One pass sums these into the shorter contexts, a
second one gives each gram its chances; only the tables of shorter contexts are joined.

Cases: a null or empty text is the end alone; repeated rows count each time; a
null id is trained on; without training rows all probabilities are those of
the empty model (one half per decision); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release_shuffles, text_or_empty
from tidemark.llm.word_tokens import texts
from tidemark.session import stored

DEPTH = 7
#: Bytes of context that grams dealt to one task share; contexts at least that long live in that task.
SHORT = 3
#: Grams at least in a piece of work, which ends where the shared bytes change; words in a block.
PIECE_GRAMS, BLOCK_WORDS = 200_000, 150_000
#: Rows of words of batches in a block of words, at most on average.
BLOCK_ROWS = 2_000_000
FOLDS, HELD_OUT = 7, 2
#: Characters of text in a batch of documents, which is read into one task at a time.
BATCH_CHARS = 64_000_000
#: Bytes of running text whose grams are sorted at a time; grams that meet the packed ones of batches in one task, on average.
CHUNK_BYTES, BLOCK_GRAMS = 8_000_000, 1_000_000
#: The end of a text, as a token; no word holds white space.
END = b"\n"
MASK = [(1 << 8 * d) - 1 for d in range(DEPTH + 1)]
LN2 = math.log(2)
#: Of a turned gram: the bits behind its shared bytes.
REST = np.uint64(8 * (DEPTH - SHORT + 1))
LOW = (np.uint64(1) << REST) - np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every coded word with its context as one number, and the word it belongs to.

    The context is the ``DEPTH`` bytes before it, padded with zero bytes at a word's start.
    """
    pad = bytes(DEPTH)
    coded = [w if w == END else w + b" " for w in words]
    flat = np.frombuffer(b"".join([pad + w for w in coded]), np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in coded], np.int64)
    first = np.cumsum(sizes + DEPTH) - sizes
    place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    grams = np.zeros(len(place), np.int64)
    for back in range(DEPTH, -1, -1):
        grams = (grams << 8) | flat[place - back]
    return grams, np.repeat(np.arange(len(coded)), sizes)


def running_grams(texts: bytes) -> np.ndarray:
    """The byte at each place from ``DEPTH`` on with the ``DEPTH`` bytes before it as one number."""
    return np.ndarray((max(0, len(texts) - DEPTH),), ">i8", texts, strides=(1,)).astype(np.int64)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where another number begins."""
    return np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]).nonzero()[0]


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order with the sums of their counts."""
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    first = _firsts(grams)
    return grams[first], np.add.reduceat(n, first) if len(first) else n


class RunningCounts:
    """Distinct grams of running texts and how often training texts hold them, with memory for the grams and a chunk of text."""

    def __init__(self):
        self.grams, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held, self.size = {True: [], False: []}, {True: 0, False: 0}

    def add(self, words: list[bytes], trained: bool) -> None:
        text = b" ".join(words)
        self.held[trained].append(text)
        self.size[trained] += len(text)
        if self.size[trained] >= CHUNK_BYTES:
            self._count(trained)

    def _count(self, trained: bool) -> None:
        pad, held = bytes(DEPTH), self.held[trained]
        grams = running_grams(b"".join([x for text in held for x in (pad, text)]))
        # the grams that end in a later text's padding
        ends = np.cumsum([len(text) + DEPTH for text in held])[:-1] - DEPTH
        inside = np.ones(len(grams), bool)
        inside[(ends[:, None] + np.arange(DEPTH)).ravel()] = False
        grams = np.sort(grams[inside])
        first = _firsts(grams)
        n = np.diff(np.append(first, len(grams))) * trained
        self.grams, self.n = _summed(np.concatenate([self.grams, grams[first]]), np.concatenate([self.n, n]))
        self.held[trained], self.size[trained] = [], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        for trained, held in self.held.items():
            if held:
                self._count(trained)
        return self.grams, self.n


class Lookup:
    """Places of distinct numbers, by open addressing: texts ask for their grams in no order, and sorting them costs more."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(len(keys)).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        places, left = self._first(keys), np.arange(len(keys))
        while len(left):
            at = places[left]
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            places[left] = (places[left] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number; all must be there."""
        at = self._first(wanted)
        found = self.slots[at]
        (left,) = (self.keys[found] != wanted).nonzero()
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.slots[at[left]]
            left = left[self.keys[found[left]] != wanted[left]]
        return found


def _planes(numbers: np.ndarray, width: int = 4) -> bytes:
    """The lowest bytes of all numbers, then the next ones: high bytes are mostly zero, and pack well together."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int = 4) -> np.ndarray:
    whole = np.zeros((len(planes) // width, 8), np.uint8)
    whole[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return whole.view("<u8").ravel()


def _turned(grams: np.ndarray) -> np.ndarray:
    """Grams with their last ``SHORT`` bytes of context first, then the earlier ones and the byte: those dealt together stand together."""
    grams = grams.view(np.uint64)
    rest = grams >> np.uint64(8 * SHORT + 8) << np.uint64(8) | grams & np.uint64(255)
    return (grams >> np.uint64(8) & np.uint64(MASK[SHORT])) << REST | rest


def _turned_back(turned: np.ndarray) -> np.ndarray:
    rest = turned & LOW
    shared = turned >> REST << np.uint64(8)
    return (rest >> np.uint64(8) << np.uint64(8 * SHORT + 8) | shared | rest & np.uint64(255)).view(np.int64)


def _packed(turned: np.ndarray) -> bytes:
    """Sorted turned grams with the same shared bytes, as the steps between them."""
    return _planes(np.diff(turned & LOW, prepend=np.uint64(0)), DEPTH - SHORT + 1)


def _unpacked(shared: int, packed: bytes) -> np.ndarray:
    return np.cumsum(_numbers(packed, DEPTH - SHORT + 1), dtype=np.uint64) | np.uint64(shared) << REST


def _numbered(df: DataFrame, id_column: str, text_column: str, trained: Column) -> DataFrame:
    """Runs of documents of about ``BATCH_CHARS``, numbered by input partition, as rows of three kinds.

    A document is ``batch doc_id trained tokens``: its words in order and the end, as the places they have
    among the distinct words of its batch, four bytes each, packed.  A distinct word is ``batch word place count``,
    where ``count`` is how often training documents of the batch hold it.  The distinct grams of its running texts are
    ``batch shared grams counts``, a row for those that share bytes, packed.  Other columns are null.  So the texts are
    read once, and neither stored nor dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds = {"word": pa.binary(), "place": pa.int32(), "count": pa.int64(), "shared": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}
        names = ["batch", "doc_id", "trained", "tokens", *kinds]
        press = zstandard.ZstdCompressor(level=1).compress

        def rows(number: int, n: int, kind: pa.DataType, given: dict[str, pa.Array]) -> pa.RecordBatch:
            every = {"batch": pa.int64(), "doc_id": kind, "trained": pa.bool_(), "tokens": pa.binary(), **kinds}
            given["batch"] = pa.array(np.full(n, number, np.int64))
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, every[c]) for c in names], names)

        def words(number: int, seen: dict, counts: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            every = list(seen)
            for at in range(0, len(every), 50_000):
                part = every[at : at + 50_000]
                place = pa.array(np.arange(at, at + len(part), dtype=np.int32))
                found = {"word": pa.array(part, pa.binary()), "place": place, "count": pa.array(counts[at : at + len(part)])}
                yield rows(number, len(part), kind, found)

        def grams(number: int, running: RunningCounts, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            every, n = running.all()
            every = _turned(every)
            order = np.argsort(every)
            every, n = every[order], n[order]
            shared = (every >> REST).astype(np.int32)
            ends = np.append(_firsts(shared), len(every)).tolist()
            for at in range(0, len(ends) - 1, 2_000):
                spans = [slice(*span) for span in zip(ends[at : at + 2_000], ends[at + 1 : at + 2_001])]
                found = {
                    "shared": pa.array(shared[[span.start for span in spans]]),
                    "grams": pa.array([_packed(every[span]) for span in spans], pa.binary()),
                    "counts": pa.array([_planes(n[span]) for span in spans], pa.binary()),
                }
                yield rows(number, len(spans), kind, found)

        def fresh() -> tuple[defaultdict, np.ndarray, RunningCounts]:
            seen = defaultdict()
            seen.default_factory = seen.__len__
            return seen, np.zeros(0, np.int64), RunningCounts()

        number, size, kind = TaskContext.get().partitionId() << 32, 0, None
        seen, counts, running = fresh()
        for batch in batches:
            kind, first, held, held_bytes = batch.column(0).type, 0, [], 0
            learned = batch.column(1).to_pylist()

            def documents(end: int) -> Iterator[pa.RecordBatch]:
                """The rows of this Arrow batch from the first that was not given yet."""
                nonlocal first, held, held_bytes, counts
                if held:
                    some = [t for t, use in zip(held, learned[first:end]) if use]
                    more = np.bincount(np.concatenate(some) if some else np.zeros(0, np.uint32), minlength=len(seen))
                    more[: len(counts)] += counts
                    counts = more
                    ids, use = (batch.column(k).slice(first, len(held)) for k in range(2))
                    tokens = pa.array([press(_planes(t)) for t in held], pa.binary())
                    yield rows(number, len(held), kind, {"doc_id": ids, "trained": use, "tokens": tokens})
                first, held, held_bytes = end, [], 0

            for row, text in enumerate(texts(batch.column(2))):
                if size and size + len(text) > BATCH_CHARS:
                    yield from documents(row)
                    yield from words(number, seen, counts, kind)
                    yield from grams(number, running, kind)
                    number, size, (seen, counts, running) = number + 1, 0, fresh()
                elif held_bytes > BATCH_CHARS:
                    yield from documents(row)
                found = words_of(text)
                found.append(END)
                running.add(found, bool(learned[row]))
                held.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
                held_bytes += held[-1].nbytes
                size += len(text) + 1
            yield from documents(batch.num_rows)
        if kind is not None:
            yield from words(number, seen, counts, kind)
            yield from grams(number, running, kind)

    rows = df.select(F.col(id_column).alias("doc_id"), trained.alias("trained"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"batch long, doc_id {kind}, trained boolean, tokens binary, word binary, place int, count long, shared int, "
        "grams binary, counts binary",
    )


def _block_grams(words: DataFrame) -> DataFrame:
    """``block gram`` over ``block word``: the distinct grams of each block."""

    def run(block: pa.Table) -> pa.Table:
        grams = np.unique(grams_of(block.column("word").to_pylist())[0])
        return pa.table([pa.array(np.full(len(grams), block.column("block")[0].as_py())), pa.array(grams)], ["block", "gram"])

    return words.groupBy("block").applyInArrow(run, "block long, gram long")


def _gram_counts(words: DataFrame) -> DataFrame:
    """``gram n`` over ``word count``; 0 for grams of held-out words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, owner = grams_of(batch.column(0).to_pylist())
            distinct, place = np.unique(grams, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, batch.column(1).to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], ["gram", "n"])

    counted = words.mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _log_gamma(x, log):
    """Stirling's series eight steps up; exact to about 1e-12 for x of one half or more."""
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(steps)


def _log_block(zeros, ones, log):
    """Log of the Krichevsky-Trofimov probability of so many bits, over columns or arrays."""
    return _log_gamma(zeros + 0.5, log) + _log_gamma(ones + 0.5, log) - math.log(math.pi) - _log_gamma(zeros + ones + 1, log)


class LongContexts:
    """All nodes of at least ``SHORT`` bytes of context of the grams of one piece.

    ``levels`` has for each depth from ``DEPTH`` down the sorted keys (context and node), each decision's
    estimate of a one and its share of the mixture; ``shorter`` has the sums one byte below ``SHORT``.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        byte, keys = self.decisions(grams[n > 0])
        keys, place = np.unique(keys.ravel(), return_inverse=True)
        ones = np.stack([byte >> shift & 1 for shift in range(7, -1, -1)]).ravel().astype(bool)
        count = np.tile(n[n > 0], 8).astype(float)
        every = np.bincount(place, count, len(keys))
        ones = np.bincount(place, count * ones, len(keys))
        below, self.levels = None, []
        for depth in range(DEPTH, SHORT - 1, -1):
            block = _log_block(every - ones, ones, np.log)
            with np.errstate(over="ignore"):
                own = np.ones(len(keys)) if below is None else 1 / (1 + np.exp(below - block))
            weighted = block if below is None else np.logaddexp(block, below) - LN2
            self.levels.append((depth, keys, (ones + 0.5) / (every + 1), own))
            keys, place = np.unique(self.cut(keys, depth - 1), return_inverse=True)
            every, ones, below = (np.bincount(place, x, len(keys)) for x in (every, ones, weighted))
        self.shorter = keys, every - ones, ones, below

    @staticmethod
    def cut(keys: np.ndarray, depth: int) -> np.ndarray:
        return keys & np.uint64(MASK[depth] << 8 | 255)

    @staticmethod
    def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte of each gram, and eight rows of keys, one for each bit: the context with the node in the last byte."""
        grams = grams.view(np.uint64)
        byte = (grams & np.uint64(255)).astype(np.int64)
        nodes = np.stack([1 << level | byte >> 8 - level for level in range(8)]).astype(np.uint64)
        return byte, grams & ~np.uint64(255) | nodes

    def chances(self, grams: np.ndarray) -> np.ndarray:
        """Eight rows of chances of a one, NaN where no context of at least ``SHORT`` bytes was seen."""
        wanted = self.decisions(grams)[1]
        chance = np.full(wanted.shape, np.nan)
        for depth, keys, one, own in self.levels:
            if len(keys):
                wanted = self.cut(wanted, depth)
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                mixed = np.where(np.isnan(chance), one[place], own[place] * one[place] + (1 - own[place]) * chance)
                chance = np.where(keys[place] == wanted, mixed, chance)
        return chance


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts in pieces that end where the last ``SHORT`` bytes of context change."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= PIECE_GRAMS:
            grams, n = (np.concatenate(x) for x in zip(*held))
            shared = grams >> 8 & MASK[SHORT]
            (ends,) = (shared[1:] != shared[:-1]).nonzero()
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield grams[:cut], n[:cut]
            held, size = [(grams[cut:], n[cut:])], len(grams) - cut
    if size:
        grams, n = (np.concatenate(x) for x in zip(*held))
        yield grams, n


def _dealt(grams: DataFrame) -> DataFrame:
    shared = F.shiftrightunsigned("gram", 8).bitwiseAND(MASK[SHORT])
    return grams.select("gram", "n").repartition(shared).sortWithinPartitions(shared)


def build(grams: DataFrame) -> list[DataFrame]:
    """Per depth below ``SHORT`` a table ``context nodes``: for each of 256 nodes its estimate of a one
    and its share of the mixture, null where no decision was seen.

    Levels are summed from the longer contexts up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n in _pieces(batches):
            keys, zeros, ones, below = LongContexts(part, n).shorter
            columns = [(keys >> np.uint64(8)).astype(np.int64), (keys & np.uint64(255)).astype(np.int32), zeros, ones, below]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "node", "zeros", "ones", "below"])

    kind = "context long, node int, zeros double, ones double, below double"
    level = _dealt(grams.where("n > 0")).mapInArrow(run, kind)
    tables = []
    for depth in range(SHORT - 1, -1, -1):
        sums = level.groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
        sums = sums.withColumn("_block", _log_block(F.col("zeros"), F.col("ones"), F.log))
        apart = F.col("_block") - F.col("below")
        mixed = F.greatest("_block", "below") + F.log1p(F.exp(-F.abs(apart))) - LN2
        sums = sums.select("context", "node", "zeros", "ones", mixed.alias("below"), (1 / (1 + F.exp(-apart))).alias("own"))
        sums = stored(sums, "contexts")
        estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        # at most 255 decisions per context; laid out by node, as a map would be searched from its start for each decision
        entry = F.struct("node", F.struct(estimate.alias("one"), F.col("own").alias("own")))
        table = sums.groupBy("context").agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))
        table = table.select("context", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.try_element_at("nodes", k)).alias("nodes"))
        tables.insert(0, stored(table, "tables") if depth > 1 else table)
        if depth:
            level = sums.withColumn("context", F.col("context").bitwiseAND(MASK[depth - 1]))
    release_shuffles(grams.sparkSession)
    return tables


def code_lengths(grams: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``gram value``: the log10 probability of each gram's byte in its context.

    From the longest context down to none, each context that was seen mixes its
    estimate with what longer ones say; only the eight chances are carried on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n in _pieces(batches):
            chances = LongContexts(part, n).chances(part)
            for at in range(0, len(part), 20_000):
                some = slice(at, at + 20_000)
                columns = [pa.array(part[some]), *[pa.array(row[some], from_pandas=True) for row in chances]]
                yield pa.RecordBatch.from_arrays(columns, ["gram", *[f"_p{level}" for level in range(8)]])

    byte = F.col("gram").bitwiseAND(255).cast("int")
    rows = _dealt(grams).mapInArrow(run, "gram long, " + ", ".join(f"_p{level} double" for level in range(8)))
    for depth in range(SHORT - 1, -1, -1):
        named = tables[depth].withColumnRenamed("context", "_context")
        short = F.shiftrightunsigned("gram", 8).bitwiseAND(MASK[depth])
        # without or with one byte of context: at most 256 rows
        named = F.broadcast(named) if depth < 2 else named
        joined = rows.join(named, short == F.col("_context"), "left")
        found = [
            F.get("nodes", F.lit(1 << level).bitwiseOR(F.shiftright(byte, 8 - level))).alias(f"_s{level}")
            for level in range(8)
        ]
        joined = joined.select("gram", *[f"_p{level}" for level in range(8)], *found)
        mixed = []
        for level in range(8):
            here, longer = F.col(f"_s{level}"), F.col(f"_p{level}")
            both = here["own"] * here["one"] + (1 - here["own"]) * longer
            chance = F.when(here.isNull(), longer).when(longer.isNull(), here["one"]).otherwise(both)
            mixed.append(chance.alias(f"_p{level}"))
        rows = joined.select("gram", *mixed)
    total = F.lit(0.0)
    for level in range(8):
        chance = F.coalesce(F.col(f"_p{level}"), F.lit(0.5))
        one = F.shiftright(byte, 7 - level).bitwiseAND(1) == 1
        total = total + F.log10(F.when(one, chance).otherwise(1 - chance))
    return rows.select("gram", total.alias("value"))


def _word_values(words: DataFrame, batch_words: DataFrame, values: DataFrame, blocks: int) -> DataFrame:
    """``batch place word count value`` for each word of a batch: its count in all batches and its code length, by blocks of words."""
    block = F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("long").alias("block")
    coded = _block_grams(words.select(block, "word")).join(values, "gram").select("block", "gram", "value")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, value = right.column("gram").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(grams)
        every = left.column("word").combine_chunks().dictionary_encode()
        which = every.indices.to_numpy()
        mine, owner = grams_of(every.dictionary.to_pylist())
        place = order[np.searchsorted(grams, mine, sorter=order)]
        sums = np.bincount(owner, value[place], len(every.dictionary))
        total = np.zeros(len(sums), np.int64)
        np.add.at(total, which, left.column("count").to_numpy())
        columns = [*(left.column(c) for c in ("batch", "place", "word")), pa.array(total[which]), pa.array(sums[which])]
        return pa.table(columns, ["batch", "place", "word", "count", "value"])

    dealt = batch_words.select(block, "batch", "word", "place", "count").groupBy("block")
    kind = "batch long, place int, word binary, count long, value double"
    return dealt.cogroup(coded.groupBy("block")).applyInArrow(run, kind)


def _running_counts(batch_grams: DataFrame) -> DataFrame:
    """``gram n`` over the packed grams of batches: each gram with its count in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, every = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if every is not None:
                grams = _turned_back(every[0])
                for at in range(0, len(grams), 100_000):
                    some = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(grams[some]), pa.array(every[1][some])], ["gram", "n"])

        for batch in batches:
            shared = batch.column(0).to_numpy()
            ends = np.append(_firsts(shared), len(shared)).tolist()
            for start, end in zip(ends, ends[1:]):
                if last != shared[start]:
                    yield from done()
                    last, every = shared[start], None
                grams = [_unpacked(last, x.as_py()) for x in batch.column(1)[start:end]]
                n = [_numbers(x.as_py()).astype(np.int64) for x in batch.column(2)[start:end]]
                if every is not None:
                    grams, n = [every[0], *grams], [every[1], *n]
                every = _summed(np.concatenate(grams), np.concatenate(n))
        yield from done()

    dealt = batch_grams.select("shared", "grams", "counts").repartition("shared").sortWithinPartitions("shared")
    return dealt.mapInArrow(run, "gram long, n long")


def _running_values(batch_grams: DataFrame, values: DataFrame, blocks: int) -> DataFrame:
    """``batch shared grams values``: the packed grams of batches with their code lengths."""

    def block(shared: Column) -> Column:
        return F.pmod(F.xxhash64(shared.cast("int")), F.lit(blocks)).alias("block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = _turned(right.column("gram").to_numpy())
        order = np.argsort(keys)
        keys, value = keys[order], right.column("value").to_numpy()[order]
        shared = left.column("shared").to_pylist()
        places = (np.searchsorted(keys, _unpacked(s, x.as_py())) for s, x in zip(shared, left.column("grams")))
        found = pa.array([value[at].tobytes() for at in places], pa.binary())
        return pa.table([*(left.column(c) for c in ("batch", "shared", "grams")), found], ["batch", "shared", "grams", "values"])

    dealt = batch_grams.select(block(F.col("shared")), "batch", "shared", "grams").groupBy("block")
    found = values.select(block(F.shiftrightunsigned("gram", 8).bitwiseAND(MASK[SHORT])), "gram", "value").groupBy("block")
    return dealt.cogroup(found).applyInArrow(run, "batch long, shared int, grams binary, values binary")


def _text_values(tokens: Iterator[np.ndarray], words: pa.Array, grams: np.ndarray, value: np.ndarray) -> Iterator[float]:
    """The code length of each running text, given as places of words, under the values of all its grams."""
    lookup, pad = Lookup(grams), len(words)
    # a word with its space, the end as it is, and the bytes before a text
    coded = pa.array([w if w == END else w + b" " for w in words.to_pylist()] + [bytes(DEPTH)], pa.binary())
    sizes = pa.compute.binary_length(coded).to_numpy()
    held, size = [], 0

    def sums() -> np.ndarray:
        at = np.concatenate([x for text in held for x in (np.array([pad], np.uint32), text)])
        ends = np.cumsum([int(sizes[text].sum()) + DEPTH for text in held])
        every = running_grams(b"".join(coded.take(pa.array(at)).to_pylist()))
        inside = np.ones(len(every), bool)
        inside[(ends[:-1, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
        coming = np.zeros(len(every))
        coming[inside] = value[lookup.places(every[inside])]
        # each text has its end at least
        return np.add.reduceat(coming, np.append(0, ends[:-1]))

    for text in tokens:
        held.append(text)
        size += int(sizes[text].sum())
        if size >= CHUNK_BYTES:
            yield from sums().tolist()
            held, size = [], 0
    if held:
        yield from sums().tolist()


def score(df: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id held_out n_tokens n_known train_tokens base_score score running_score``.

    ``held_out`` tells the documents that are not learned from; null counts as false.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    numbered = stored(_numbered(df, id_column, text_column, ~held_out), "numbered-words", "zstd")
    batch_words = numbered.where("word is not null").select("batch", "word", "place", "count")
    words = batch_words.groupBy("word").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("batches"))
    words = stored(words, "words", "zstd")
    total, distinct, every, rows = words.agg(
        F.sum("count"), F.count(F.when(F.col("count") > 0, 1)), F.count(F.lit(1)), F.sum("batches")
    ).head()
    total, blocks = total or 0, max(1, math.ceil(every / BLOCK_WORDS), math.ceil((rows or 0) / BLOCK_ROWS))
    release_shuffles(df.sparkSession)
    grams = stored(_gram_counts(words.select("word", "count")), "grams", "zstd")
    values = stored(code_lengths(grams, build(grams)), "code-lengths", "zstd")
    release_shuffles(df.sparkSession)
    lookups = stored(_word_values(words, batch_words, values, blocks), "word-values", "zstd")
    release_shuffles(df.sparkSession)
    batch_grams = numbered.where("grams is not null").select("batch", "shared", "grams", "counts")
    running = stored(_running_counts(batch_grams), "running-grams", "zstd")
    release_shuffles(df.sparkSession)
    running_values = stored(code_lengths(running, build(running)), "running-lengths", "zstd")
    release_shuffles(df.sparkSession)
    gram_values = _running_values(batch_grams, running_values, math.ceil(running.count() / BLOCK_GRAMS) or 1)
    lookups = lookups.unionByName(gram_values, allowMissingColumns=True)
    docs = numbered.where("tokens is not null").select("batch", "doc_id", "trained", "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()
    unit = math.log10(total + distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "running_score"]
        spelled = pa.compute.is_valid(right.column("place"))
        words, grams = right.filter(spelled), right.filter(pa.compute.invert(spelled))
        words = words.take(np.argsort(words.column("place").to_numpy()))
        count, coded = (words.column(name).to_numpy() for name in ("count", "value"))
        base, unzip = np.log10(count + 1) - unit, zstandard.ZstdDecompressor().decompress
        out = {name: [] for name in fields[2:]}
        every = lambda: (_numbers(unzip(tokens.as_py())) for tokens in left.column("tokens"))
        for at in every():
            out["n_tokens"].append(len(at))
            out["n_known"].append(int((count[at] > 0).sum()))
            out["base_score"].append(float(base[at].sum()))
            out["score"].append(float(coded[at].sum()))
        packed = zip(grams.column("shared").to_pylist(), grams.column("grams"))
        asked = _turned_back(np.concatenate([_unpacked(s, x.as_py()) for s, x in packed]))
        value = np.concatenate([np.frombuffer(x.as_py()) for x in grams.column("values")])
        out["running_score"] = [*_text_values(every(), words.column("word").combine_chunks(), asked, value)]
        columns = [left.column("doc_id"), pa.compute.invert(left.column("trained"))]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table(columns + [pa.array(out[n], k) for n, k in zip(fields[2:], kinds)], fields)

    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, running_score double"
    scored = docs.groupBy("batch").cogroup(lookups.groupBy("batch")).applyInArrow(run, fields)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "running_score"
    )
