"""Connected components of a table of links: forests of parts of it, then alternating star contractions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


#: Links of a part that one task holds in memory; a table of no more links is one part.
PART_LINKS = 500_000


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the smallest node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _forest(links: DataFrame, roots: bool = False) -> DataFrame:
    """Links ``u v`` that connect what the links of each part do: every node with its smallest one (itself too, with ``roots``)."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1))
        u, v = _labels(u, v)
        shown = np.full(len(u), True) if roots else u != v
        return pa.RecordBatch.from_arrays([pa.array(u[shown], pa.int64()), pa.array(v[shown], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * PART_LINKS:  # a table of one part stays below
                yield stars(held)
                held, size = [], 0
        if held:
            yield stars(held)

    return links.mapInArrow(run, "u long, v long")


def _to_smallest(links: DataFrame) -> DataFrame:
    """``node least``: per node the smallest of itself and its neighbours; combined before the shuffle."""
    return links.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_to_smallest(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _to_smallest(down)
    joined = down.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node label`` for every node of ``links`` (columns ``a b``): the smallest node of its component.

    Each task first replaces its links by a forest, which leaves stars only if one task holds all that is left.  Else stars
    are contracted in rounds, each written to the shared folder, until they no longer change.
    """
    now = stored(_forest(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v")), "links")
    parts = math.ceil(now.count() / PART_LINKS)
    if parts <= 1:
        whole = stored(_forest(now.coalesce(1), roots=True), "links")
        return whole.select(F.col("u").alias("node"), F.col("v").alias("label"))
    now = stored(_forest(now.coalesce(parts)), "links")
    sign = None
    while True:
        now = stored(_small_star(_large_star(now)), "links")
        last, sign = sign, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).head())
        if sign == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
