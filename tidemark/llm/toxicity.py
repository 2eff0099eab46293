"""Toxicity by noisy-channel deobfuscation: texts are restored, then scored.

A chunk of text in which letters are mixed with digits or signs, letters are
repeated three times or more, or single letters are spaced out, is read as a
lattice: every character may stand for itself, for the letters it resembles, or
for nothing, signs at the edges of a chunk too, and spaced letters may be words of
their own.  Viterbi decoding finds the cheapest path under a character
trigram model of the corpus.  Other chunks have one path only, themselves.

The trigram model counts all documents.  The score uses learned word evidence:
for restored words and their first ``PREFIX`` characters, the lower bound of the log
odds of occurring in toxic rather than other documents, from labelled rows of
one half of the training rows; the sum of a document's ``STRONGEST``
largest bounds goes through a logistic curve fitted on the other half.  At most
``MAX_LABELLED`` labelled rows are used, chosen by hash, and at most
``MAX_LEXICON`` features are kept, the strongest.

Cases: a null or empty text has no evidence and gets the curve's value at 0; null
labels are left out and of several labels of a document the largest counts;
without labelled rows of both kinds every score is the share of toxic rows (0 without any
rows); repeated rows repeat; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.word_tokens import Recent, texts

MAX_LABELLED = 40_000
MAX_LEXICON = 20_000
MIN_SUPPORT = 3
STRONGEST = 3
PREFIX = 6
BIN = 0.25

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Signs and the letters they are written for.
RESEMBLES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "×": "x",
}
#: Costs in nats of reading a sign as a letter, of dropping it or breaking the word at it, and the same for a
#: sign that resembles no letter; of dropping a letter of a run of three or more, and of a pair.
AS_LETTER, DROPPED, BROKEN = 0.7, 9.0, 9.0
MARK_DROPPED, MARK_BROKEN = 0.7, 2.0
REPEATED, PAIR = 0.5, 5.0
#: Leaving out a sign at the edge of a chunk: one that is punctuation there, and any other at the end.
PUNCTUATION, TRAILING = 1.0, 4.0
#: A word break between spaced letters.
SPLIT = 0.5

#: Signs that resemble no letter and are cut off at the edges.
EDGES = ".,;:?\"')[]{}…“”‘’«»¿"
OPENING, CLOSING = "(¡", "!("
SIGNS = frozenset(c for c in RESEMBLES if not c.isdigit())
RUNS = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
GAPS = re.compile(r"\s+")


def _classes() -> np.ndarray:
    """Class of each byte: 1 to 26 for letters of either case, 0 for all else."""
    table = np.zeros(256, np.int64)
    for k, letter in enumerate(LETTERS, 1):
        table[ord(letter)] = table[ord(letter.upper())] = k
    return table


def trigram_counts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``gram count`` over all texts: at most 27**3 rows, summed before and after the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _classes(), np.zeros(27**3, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                c = table[np.frombuffer(f"  {text} ".encode("utf-8", "replace"), np.uint8)]
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        (seen,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "count"])

    rows = df.select(text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(count, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))


def trigram_costs(counts: dict[int, int]) -> np.ndarray:
    """Negative log probabilities, mixed with bigrams and a uniform share."""
    total = np.zeros(27**3)
    for gram, count in counts.items():
        total[gram] = count
    tri = total.reshape(27, 27, 27)
    bi = tri.sum(0)
    uni = (bi.sum(0) + 1) / (bi.sum() + 27)
    two = (bi + 27 * uni) / (bi.sum(1, keepdims=True) + 27)
    three = (tri + 27 * two[None]) / (tri.sum(2, keepdims=True) + 27)
    return -np.log(three)


class Restorer:
    """Restores chunks of text to lower-case words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def chunk(self, chunk: str) -> tuple[str, ...]:
        core = chunk.strip(EDGES).lower()
        if core.isalpha() and not RUNS.search(core):
            return (core,)
        return tuple(self.decode(core).split()) if self.written(core) else ()

    @staticmethod
    def written(text: str) -> bool:
        """Whether a text may stand for words: it has letters or signs read as letters, not digits alone."""
        return any(c.isalpha() or c in SIGNS for c in text)

    def spaced(self, run: str) -> str:
        """The reading of single characters with white space between; wide gaps break words at no cost."""
        gaps = GAPS.findall(run)
        widest = min(map(len, gaps))
        # one character each: a few lower to two
        joined = "".join(c.lower()[0] for c in GAPS.sub("", run))
        if not self.written(joined):
            return ""
        return self.decode(joined, [0.0 if len(gap) > widest else SPLIT for gap in gaps])

    def _readings(self, text: str, at: int, start: int, end: int) -> list[tuple[str, float]]:
        c = text[at]
        if c.isalpha():
            if at == 0 or text[at - 1] != c:
                return [(c, 0.0)]
            pair = text[at + 1 : at + 2] != c and text[at - 2 : at - 1] != c
            return [(c, 0.0), ("", PAIR if pair else REPEATED)]
        letters = RESEMBLES.get(c, "")
        if not letters:
            return [("", MARK_DROPPED), (" ", MARK_BROKEN)]
        dropped, broken = DROPPED, BROKEN
        if not c.isdigit():
            run = text[at - 2 : at + 1] == c * 3 or (at and text[at - 1 : at + 2] == c * 3)
            if at >= end:
                dropped = broken = PUNCTUATION if c in CLOSING else REPEATED if run else TRAILING
            elif at < start and (c in OPENING or run):
                dropped = broken = PUNCTUATION
        return [("", dropped), (" ", broken), *((letter, AS_LETTER) for letter in letters)]

    def decode(self, text: str, breaks: list[float] | None = None) -> str:
        """The cheapest path through the lattice of a lower-case chunk.

        ``breaks`` are the costs of a word break after each character but the last; None allows none.
        """
        # signs before the first and from behind the last letter or digit are at the edges
        inner = [k for k, c in enumerate(text) if c.isalnum()]
        start, end = (inner[0], inner[-1] + 1) if inner else (0, 0)
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at in range(len(text)):
            if breaks and at:
                for (a, b), (cost, back) in list(paths.items()):
                    now = cost + breaks[at - 1] + self.costs[a][b][0]
                    if b and ((b, 0) not in paths or now < paths[b, 0][0]):
                        paths[b, 0] = (now, (" ", back))
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            readings = self._readings(text, at, start, end)
            for (a, b), (cost, back) in paths.items():
                for read, price in readings:
                    if read:
                        c = ord(read) - 96 if "a" <= read <= "z" else 0
                        state, now, link = (b, c), cost + price + self.costs[a][b][c], (read, back)
                    else:
                        state, now, link = (a, b), cost + price, back
                    if state not in following or now < following[state][0]:
                        following[state] = (now, link)
            paths = following
        ended = ((cost + self.costs[a][b][0], back) for (a, b), (cost, back) in paths.items())
        _, link = min(ended, key=lambda end: end[0])
        read = []
        while link:
            read.append(link[0])
            link = link[1]
        return "".join(reversed(read))

    def words(self, text: str) -> list[str]:
        """All restored words of a text, in order but for spaced-out runs, which come last."""
        rest, runs = split_runs(text)
        found = [word for chunk in rest for word in self.chunk(chunk)]
        return found + [word for run in runs for word in self.spaced(run).split()]


def split_runs(text: str) -> tuple[list[str], list[str]]:
    """White-space separated chunks, and runs of single characters with white space between."""
    runs = SPACED.findall(text)
    return (SPACED.sub(" ", text) if runs else text).split(), runs


def features(word: str) -> tuple[str, ...]:
    return (word, word[:PREFIX] + "*") if len(word) > PREFIX else (word,)


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -50.0
    slope: float = 0.0

    def probability(self, evidence: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + F.lit(self.slope) * evidence)))


def _labelled(df: DataFrame, labels: DataFrame, remainder: Column, id_column: str) -> DataFrame:
    """``text toxic remainder`` of the labelled training rows, at most ``MAX_LABELLED`` ids."""
    usable = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.withColumn("remainder", remainder).where("remainder != 2")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    few = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))  # at most MAX_LABELLED narrow rows
    return df.join(few, df[id_column] == F.col("_id")).select("text", "toxic", "remainder")


def held_out_remainder(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4).cast("int")


def _word_evidence(rows: DataFrame, restorer: Restorer) -> DataFrame:
    """``feature toxic clean``: in how many documents of each kind a feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recent(restorer.chunk)
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                rest, runs = split_runs(text)
                words = {word for chunk in set(rest) for word in known[chunk]}
                words.update(word for run in runs for word in restorer.spaced(run).split())
                seen[1 if toxic else 0].update({f for word in words for f in features(word)})
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([seen[k][n] for n in part], pa.int64()) for k in (1, 0))],
                ["feature", "toxic", "clean"],
            )

    counted = rows.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def evidence(df: DataFrame, model: Model, keep: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` and ``evidence``: the sum of the strongest weights in each whole restored text."""
    shared = df.sparkSession.sparkContext.broadcast((model.costs, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, weights = shared.value
        restorer = Restorer(costs)

        def weigh(words) -> tuple[tuple[str, float], ...]:
            found = ((word, max(weights.get(f, 0.0) for f in features(word))) for word in words)
            return tuple(pair for pair in found if pair[1] > 0)

        known = Recent(lambda chunk: weigh(restorer.chunk(chunk)))
        for batch in batches:
            sums = []
            for text in texts(batch.column(len(keep))):
                rest, runs = split_runs(text)
                found = dict(pair for pairs in [known[chunk] for chunk in rest] if pairs for pair in pairs)
                for spaced in runs:
                    found.update(weigh(restorer.spaced(spaced).split()))
                sums.append(math.fsum(sorted(found.values(), reverse=True)[:STRONGEST]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(sums, pa.float64())], [*keep, "evidence"]
            )

    rows = df.select(*keep, text_or_empty(text_column).alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kinds}, evidence double")


def _curve(bins: list[tuple[float, int, int]], rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over binned evidence; half a row of each kind is added at the ends."""
    top = max((x for x, *_ in bins), default=0.0) or 1.0
    data = np.array([*bins, (0.0, 0.5, 0.0), (top, 0.0, 0.5)], float)
    x, positive, count = data[:, 0], data[:, 2], data[:, 1] + data[:, 2]
    beta = np.array([math.log((positive.sum() + 0.5) / (count.sum() - positive.sum() + 0.5)), 0.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(design @ beta)))
        slope = design.T @ (positive - count * p) - 0.01 * np.array([0.0, beta[1]])
        bend = (design * (count * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01])
        step = np.linalg.solve(bend, slope)
        beta = beta + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(beta[0]), float(max(0.0, beta[1]))


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on ``labels`` (``doc_id toxic``); ids whose remainder is 2 are held out."""
    # at most 27**3 rows
    costs = trigram_costs({r[0]: r[1] for r in trigram_counts(df, text_column).collect()})
    model = Model(costs)
    source = df.select(F.col(id_column), text_or_empty(text_column).alias("text"))
    rows = _labelled(source, labels, held_out_remainder(F.col("doc_id")), id_column)
    sizes = {int(r[0] > 0): r[1] for r in rows.where("remainder < 2").groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return model
    found = _word_evidence(rows.where("remainder < 2"), Restorer(costs)).where(F.col("toxic") >= MIN_SUPPORT)
    in_toxic, in_clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(in_toxic / (sizes[1] + 1)) - F.log(in_clean / (sizes[0] + 1))
    bound = odds - 1.65 * F.sqrt(1 / in_toxic + 1 / in_clean)
    strongest = found.select("feature", bound.alias("weight")).where("weight > 0.5")
    strongest = strongest.orderBy(F.desc("weight"), "feature").limit(MAX_LEXICON)
    model.weights = {r[0]: r[1] for r in strongest.collect()}
    scored = evidence(rows.where("remainder = 3"), model, ("toxic",))
    bins = scored.groupBy((F.round(F.col("evidence") / BIN) * BIN).alias("x")).agg(
        F.sum((F.col("toxic") <= 0).cast("long")), F.sum((F.col("toxic") > 0).cast("long"))
    )
    model.intercept, model.slope = _curve([tuple(r) for r in bins.collect()])
    return model


def score(df: DataFrame, model: Model, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id held_out score predicted evidence``."""
    renamed = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    scored = evidence(renamed, model, ("doc_id",))
    probability = model.probability(F.col("evidence"))
    held_out = F.coalesce(held_out_remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), probability.alias("score"),
        (probability >= threshold).cast("int").alias("predicted"), "evidence",
    )


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    rows = df.select(F.struct("*").alias("_row"), F.col(text_column).alias("_text"))
    scored = evidence(rows, model, ("_row",), "_text")
    return scored.where(model.probability(F.col("evidence")) < threshold).select("_row.*")


def restore(df: DataFrame, costs: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id restored``: the restored words of each text joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            found = [" ".join(restorer.words(t)) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "restored"])

    rows = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, restored string")
