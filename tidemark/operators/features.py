"""Fixed-length vectors of Python sources, built from the node table.

Each plane is a sparse table of slots per document, packed into one array and
projected: ``syntax`` from node types, ``dataflow`` from assignments, ``intent``
from function complexity.  The symbol part comes from names and the flow graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import concat_vectors
from tidemark.functions.hashing import positional_encoding, random_projection
from tidemark.operators import graph, reports, symbols
from tidemark.session import joined_by_sort

# fixed values
SYNTAX_DIM = 512
DATAFLOW_DIM = 512
INTENT_DIM = 256
SYMBOL_DIM = 128
COMPLEXITY_DIM = 32
COMPLEXITY_START = 64
KINDS = ["function", "class", "variable", "loop_var"]


def syntax_encoding(nodes: DataFrame, dim: int = SYNTAX_DIM) -> DataFrame:
    """``doc_id, syntax``: encoded types of the first ``dim`` nodes, breadth first."""
    # at most dim entries per document
    first = nodes.filter((F.col("bfs_ord") < dim) & (F.col("node_type") != "_error"))
    ordered = F.array_sort(F.collect_list(F.struct("bfs_ord", "node_type")))
    types = first.groupBy("doc_id").agg(F.transform(ordered, lambda n: n["node_type"]).alias("_types"))
    return types.select("doc_id", positional_encoding(F.col("_types"), dim).alias("syntax"))


def dataflow_encoding(nodes: DataFrame, dim: int = DATAFLOW_DIM) -> DataFrame:
    return symbols.slots_to_array(symbols.flow_features(nodes, dim), "doc_id", dim, "dataflow")


def intent_encoding(nodes: DataFrame, dim: int = INTENT_DIM) -> DataFrame:
    """``doc_id, intent``: decayed complexity of the first ``dim`` functions, breadth first."""
    functions = symbols.cyclomatic_complexity(nodes)
    rows = symbols.first_n_per_group(functions, ["doc_id"], ["bfs_ord"], dim)
    value = symbols.complexity_decay(F.col("complexity"), F.col("place"))
    slots = rows.select("doc_id", F.col("place").alias("slot"), value.alias("value"))
    return symbols.slots_to_array(slots, "doc_id", dim, "intent")


def complexity_vector(nodes: DataFrame, *, iterations: int = graph.ITERATIONS) -> DataFrame:
    """``doc_id, complexity``: 32 values per document.

    Counts of functions, classes, variables and loop variables; the deepest loop
    and branch; nodes and edges of the flow graph; mean and population standard
    deviation of its PageRank; entropy of the definition depths; zeros.
    """
    parsed = nodes.filter(F.col("node_type") != "_error")
    definitions = symbols.define_symbols(parsed)
    kinds = symbols.kind_counts(definitions, "doc_id", "node_type", KINDS)
    scope = reports.value_entropy(definitions, ["doc_id"], "scope_depth", split=symbols.PER_TEXT)

    def deepest(kinds: list[str]):
        return F.max(F.when(F.col("node_type").isin(kinds), F.col("depth")))

    depths = parsed.groupBy("doc_id").agg(
        deepest(["For", "While"]).alias("loop_depth"), deepest(["If"]).alias("branch_depth")
    )
    edges, places = graph.flow_edges(parsed), graph.flow_nodes(parsed)
    edge_counts = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"))
    ranks = graph.pagerank(edges, places, ["doc_id"], iterations=iterations)
    ranks = ranks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.avg("rank").alias("rank_mean"),
        F.stddev_pop("rank").alias("rank_std"),
    )
    parts = [depths, kinds, edge_counts, ranks, scope]
    rows = reduce(lambda left, right: left.join(joined_by_sort(right), ["doc_id"], "left"), parts)
    slots = [
        *[f"n_{k}" for k in KINDS],
        "loop_depth", "branch_depth", "n_nodes", "n_edges", "rank_mean", "rank_std", "entropy",
    ]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in slots]
    zeros = F.array_repeat(F.lit(0.0), COMPLEXITY_DIM - len(slots))
    return rows.select("doc_id", F.concat(F.array(*values), zeros).alias("complexity"))


def symbol_vector(nodes: DataFrame, *, iterations: int = graph.ITERATIONS) -> DataFrame:
    """``doc_id, symbols``: encoded names, with the complexity values laid over slots 64 to 95."""
    definitions = symbols.define_symbols(nodes)
    names = symbols.name_encoding(definitions, "doc_id", "name", "node_id", SYMBOL_DIM)
    encoded = symbols.slots_to_array(names, "doc_id", SYMBOL_DIM, "_names")
    rows = complexity_vector(nodes, iterations=iterations).join(encoded, ["doc_id"], "left")
    blank = F.array_repeat(F.lit(0.0), SYMBOL_DIM)
    base = F.coalesce("_names", blank)
    after = COMPLEXITY_START + COMPLEXITY_DIM
    laid = F.concat(
        F.slice(base, 1, COMPLEXITY_START), "complexity", F.slice(base, after + 1, SYMBOL_DIM - after)
    )
    return rows.select("doc_id", laid.alias("symbols"))


def source_planes(nodes: DataFrame, *, iterations: int = graph.ITERATIONS) -> DataFrame:
    """``doc_id, symbols, syntax, dataflow, intent`` for every source that parses; a plane without entries is NULL."""
    rows = symbol_vector(nodes, iterations=iterations)
    for part in (syntax_encoding(nodes), dataflow_encoding(nodes), intent_encoding(nodes)):
        rows = rows.join(joined_by_sort(part), ["doc_id"], "left")
    return rows


def embedding() -> Column:
    """The vector of a source from its planes; NULL without ``symbols``, which all that parse have."""
    projected = []
    for name, dim in {"syntax": SYNTAX_DIM, "dataflow": DATAFLOW_DIM, "intent": INTENT_DIM}.items():
        padded = F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), dim))
        whole = F.concat(padded, F.array_repeat(F.lit(0.0), dim - F.size(padded)))
        projected.append(random_projection(dim, dim, name)(F.when(F.col("symbols").isNotNull(), whole)))
    return concat_vectors(*projected, "symbols")


def source_vectors(nodes: DataFrame, *, iterations: int = graph.ITERATIONS) -> DataFrame:
    """``doc_id, embedding`` with 1408 values for every source that parses."""
    return source_planes(nodes, iterations=iterations).select("doc_id", embedding().alias("embedding"))
