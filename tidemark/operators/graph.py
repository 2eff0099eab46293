"""Flow graphs: edges, degrees, adjacency, Laplacian and PageRank.

A NULL graph key, source, target or node is no part of a graph.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.joins import SALT, copy_rows, find_hot, join_per_key, spread_rows
from tidemark.plans.running import previous_values
from tidemark.plans.segments import DEFAULT_SPLIT, Split
from tidemark.session import cut_lineage

# fixed values: statement, edge type, condition, and whether a step inside one line counts
STATEMENTS = [
    ("FunctionDef", "call", None, False),
    ("AsyncFunctionDef", "async_call", None, True),
    ("Assign", "assign", None, False),
    ("AugAssign", "aug_assign", None, True),
    ("If", "branch", "if", True),
    ("For", "loop", "for", True),
    ("While", "loop", "while", True),
    ("Try", "try", None, True),
    ("ExceptHandler", "exception", None, True),
]
PLACES_ONLY = ["ClassDef"]
DAMPING = 0.85
ITERATIONS = 100
SMALL_GRAPH = 20_000
STEPS_PER_CHECKPOINT = 5


def transitions(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    state: str,
    *,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Edges from the previous state of a key to the next: ``keys, source, target``."""
    rows = previous_values(df, keys, order_by, {"source": F.col(state)}, split=split)
    return rows.filter(F.col("source").isNotNull()).select(*keys, "source", F.col(state).alias("target"))


def flow_nodes(nodes: DataFrame) -> DataFrame:
    """Lines that carry a node of the flow graph: ``doc_id, node``."""
    kinds = [s[0] for s in STATEMENTS] + PLACES_ONLY
    rows = nodes.filter(F.col("node_type").isin(kinds) & (F.col("skips") == 0))
    return rows.select("doc_id", F.col("line").alias("node")).distinct()


def flow_edges(nodes: DataFrame) -> DataFrame:
    """Control-flow edges of Python sources: ``doc_id, source, target, edge_type, condition``."""
    columns = ["doc_id", "source", "target", "edge_type", "condition"]
    visited = nodes.filter(F.col("skips") == 0)
    kind = F.create_map(*[F.lit(x) for s in STATEMENTS for x in (s[0], s[1])])
    condition = F.create_map(*[F.lit(x) for s in STATEMENTS if s[2] for x in (s[0], s[2])])
    loops = [s[0] for s in STATEMENTS if s[3]]
    steps = visited.filter(F.col("node_type").isin([s[0] for s in STATEMENTS]))
    steps = steps.select("doc_id", "node_id", "node_type", "line")
    # nodes of one text only: no key can be hot
    steps = previous_values(
        steps, ["doc_id"], ["node_id"], {"source": F.col("line")}, split=Split(hot_rows=None)
    )
    moved = F.col("source").isNotNull() & (
        F.col("node_type").isin(loops) | (F.col("source") != F.col("line"))
    )
    steps = steps.filter(moved).select(
        "doc_id",
        "source",
        F.col("line").alias("target"),
        F.try_element_at(kind, F.col("node_type")).alias("edge_type"),
        F.try_element_at(condition, F.col("node_type")).alias("condition"),
    )

    def in_part(part: str) -> Column:
        return F.concat(F.lit("/"), F.col("role")).endswith(f"/{part}")

    other = visited.filter(in_part("If.orelse") & (F.col("pos") == 0)).select(
        "doc_id",
        F.col("parent_line").alias("source"),
        F.col("line").alias("target"),
        F.lit("branch").alias("edge_type"),
        F.lit("else").alias("condition"),
    )
    bodies = visited.filter(in_part("For.body") | in_part("While.body"))
    word = F.when(in_part("For.body"), "for").otherwise("while")
    back = bodies.groupBy("doc_id", "parent_id", F.col("parent_line").alias("target"), word.alias("condition"))
    back = back.agg(F.max_by("line", "pos").alias("source"))
    back = back.withColumn("edge_type", F.lit("loop_back")).select(*columns)
    return steps.unionByName(other).unionByName(back)


def degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``node, in_degree, out_degree`` per graph, parallel edges counted; one shuffle."""
    out = F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    ends = edges.select(*keys, F.explode(F.array(out, into)).alias("_e")).select(*keys, "_e.*")
    return ends.groupBy(*keys, "node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")
    )


def graph_nodes(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("node"))
    return ends.distinct()


def adjacency(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 0/1 adjacency matrix as ``source, target`` rows; ends outside ``nodes`` are dropped."""
    pairs = edges.select(*keys, "source", "target").distinct()
    for end in ("source", "target"):
        known = nodes.select(*keys, F.col("node").alias(end))
        pairs = pairs.join(known, [*keys, end], "left_semi")
    return pairs


def laplacian(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Out-degree diagonal minus adjacency as ``row, col, value`` entries (diagonal always present)."""
    off = pairs.select(
        *keys, F.col("source").alias("row"), F.col("target").alias("col"), F.lit(-1.0).alias("value")
    )
    diagonal = pairs.select(
        *keys, F.col("source").alias("row"), F.col("source").alias("col"), F.lit(1.0).alias("value")
    )
    zero = nodes.select(
        *keys, F.col("node").alias("row"), F.col("node").alias("col"), F.lit(0.0).alias("value")
    )
    entries = off.unionByName(diagonal).unionByName(zero)
    return entries.groupBy(*keys, "row", "col").agg(F.sum("value").alias("value"))


def pagerank(
    edges: DataFrame,
    nodes: DataFrame,
    keys: Sequence[str] = (),
    *,
    damping: float = DAMPING,
    iterations: int = ITERATIONS,
    direction: str = "reverse",
    small_graph: int = SMALL_GRAPH,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """``keys, node, rank`` after a fixed number of steps, for many graphs at once.

    ``direction="reverse"`` divides each entry of the source-to-target matrix by
    its column sum, so rank flows from targets to sources; ``"forward"`` is the
    usual sense.  Parallel edges count once, lost mass is not handed back.
    Graphs of at most ``small_graph`` edges and nodes are iterated inside a task,
    a whole Arrow batch of graphs at a time; larger ones by joins.
    """
    if direction not in ("reverse", "forward"):
        raise ValueError("direction must be 'reverse' or 'forward'")
    giver, taker = ("target", "source") if direction == "reverse" else ("source", "target")
    # a NULL key is no graph, a NULL node no node
    edges, nodes = edges.dropna(subset=[*keys, "source", "target"]), nodes.dropna(subset=[*keys, "node"])
    ends = [F.col(giver).alias("_from"), F.col(taker).alias("_to")]
    if not keys:
        return _pagerank_by_joins(_arcs(edges.select(*ends), nodes), nodes, [], damping, iterations, split)
    arcs = adjacency(edges, nodes, keys).select(*keys, *ends)
    size = nodes.select(*keys).unionByName(arcs.select(*keys)).groupBy(*keys)
    size = size.agg(F.count(F.lit(1)).alias("_size"))
    large = size.filter(F.col("_size") > small_graph).select(*keys)
    if large.isEmpty():
        return _pagerank_in_tasks(arcs, nodes, keys, damping, iterations)
    in_tasks = [d.join(large, [*keys], "left_anti") for d in (arcs, nodes)]
    by_joins = [d.join(large, [*keys], "left_semi") for d in (arcs, nodes)]
    return _pagerank_in_tasks(*in_tasks, keys, damping, iterations).unionByName(
        _pagerank_by_joins(*by_joins, keys, damping, iterations, split)
    )


def _arcs(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct arcs to known nodes.

    Arcs to unknown takers must not count as shares; the shuffle that finds them brings equal arcs together as well.
    Arcs of unknown givers meet no rank.
    """
    known = nodes.select(F.col("node").alias("_to"))
    return arcs.join(known, ["_to"], "left_semi").distinct().select("_from", "_to")


def _pagerank_in_tasks(
    arcs: DataFrame, nodes: DataFrame, keys: Sequence[str], damping: float, iterations: int
) -> DataFrame:
    """One row per small graph; its size was checked before it is collected."""
    kind = nodes.schema["node"].dataType
    none = F.lit(None).cast(kind)
    parts = arcs.select(*keys, "_from", "_to", none.alias("_node")).unionByName(
        nodes.select(*keys, none.alias("_from"), none.alias("_to"), F.col("node").alias("_node"))
    )
    arc = F.when(F.col("_from").isNotNull(), F.struct("_from", "_to"))
    graphs = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_set("_node")).alias("_nodes"), F.collect_list(arc).alias("_arcs")
    )
    graphs = graphs.withColumns(
        {"_f": F.col("_arcs").getField("_from"), "_t": F.col("_arcs").getField("_to")}
    )

    @F.pandas_udf("array<double>")
    def iterate(names: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        if not len(names):
            return pd.Series([], dtype="object")
        sizes = names.map(len).to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)])
        place = pd.Series(
            np.arange(first[-1]),
            index=pd.MultiIndex.from_arrays(
                [np.repeat(np.arange(len(names)), sizes), np.concatenate(names.to_numpy())]
            ),
        )
        graph = np.repeat(np.arange(len(starts)), starts.map(len).to_numpy())

        def places(values: pd.Series) -> np.ndarray:
            if not len(graph):
                return np.zeros(0, dtype=np.int64)
            at = pd.MultiIndex.from_arrays([graph, np.concatenate(values.to_numpy())])
            return place.reindex(at).to_numpy(dtype=np.int64)

        gives, takes = places(starts), places(ends)
        share = np.maximum(np.bincount(gives, minlength=first[-1]), 1)
        count = np.repeat(sizes, sizes)
        rank = 1.0 / count
        for _ in range(iterations):
            flow = np.bincount(takes, weights=(rank / share)[gives], minlength=first[-1])
            rank = (1.0 - damping) / count + damping * flow
        return pd.Series(np.split(rank, first[1:-1]))

    ranks = iterate("_nodes", "_f", "_t")
    rows = graphs.select(*keys, F.explode(F.arrays_zip(F.col("_nodes").alias("node"), ranks.alias("rank"))).alias("_r"))
    return rows.select(*keys, F.col("_r.node").alias("node"), F.col("_r.rank").alias("rank"))


def _pagerank_by_joins(
    arcs: DataFrame, nodes: DataFrame, keys: Sequence[str], damping: float, iterations: int, split: Split
) -> DataFrame:
    """Rank flows along the arcs by one join and one aggregation per step.

    Arcs are laid out and sorted once by their giving node and kept, so a step
    shuffles ranks and pre-summed gifts but never the arcs.  The arcs of a hot
    giver are spread over 256 salts by their other end, and its gift is copied
    to each.  Checkpoints cut the lineage every few steps and at the end.
    """
    spark = arcs.sparkSession
    # read several times below; computed once
    arcs, nodes = cut_lineage(arcs), cut_lineage(nodes.select(*keys, "node"))
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    giver = [*keys, "node"]
    arcs = arcs.withColumnRenamed("_from", "node")
    known = nodes.select(*giver).filter(F.col("node").isNotNull()).distinct()
    share = arcs.groupBy(*giver).agg(F.count(F.lit(1)).alias("_share"))
    if keys:
        sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
        known = join_per_key(known, sizes, keys, ["node"], split=split)
    else:
        known = known.withColumn("_count", known.agg(F.count(F.lit(1)).alias("_c")).scalar())
    known = known.join(share, giver, "left").repartition(places, *giver).persist()

    hot = find_hot(arcs, giver, split)
    salt = [] if hot is None else [SALT]
    if hot is not None:
        arcs = spread_rows(arcs, hot, giver, ["_to"])
    arcs = arcs.repartition(places, *giver, *salt).sortWithinPartitions(*giver, *salt).persist()

    own = (1.0 - damping) / F.col("_count")
    base = known.select(*giver, own.alias("_part"), "_share")
    ranks = known.select(*giver, (1.0 / F.col("_count")).alias("rank"), "_share")
    for step in range(1, iterations + 1):
        gifts = ranks.filter(F.col("_share").isNotNull())
        gifts = gifts.select(*giver, (damping * F.col("rank") / F.col("_share")).alias("_part"))
        if hot is not None:
            gifts = copy_rows(gifts, hot, giver)
        moved = arcs.join(gifts, [*giver, *salt])
        moved = moved.select(*keys, F.col("_to").alias("node"), "_part", F.lit(None).alias("_share"))
        parts = moved.unionByName(base).groupBy(*giver)
        ranks = parts.agg(F.sum("_part").alias("rank"), F.max("_share").alias("_share"))
        if step % STEPS_PER_CHECKPOINT == 0 or step == iterations:
            ranks = cut_lineage(ranks)
    known.unpersist()
    arcs.unpersist()
    return ranks.select(*giver, "rank")
