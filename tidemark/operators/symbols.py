"""Symbols, usages, complexity and depth from a node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.hashing import name_bucket
from tidemark.plans.running import latest_defined, running_sums
from tidemark.plans.segments import Split

# All nodes of a document come from one text, which one task has parsed already:
# windows per document need no splitting.
PER_TEXT = Split(hot_rows=None)

# fixed values
DEFINING_NODES = {"FunctionDef": "function", "AsyncFunctionDef": "async_function", "ClassDef": "class"}
DEFINING_ROLES = [
    ("arg", "/FunctionDef.args/arguments.args", "parameter"),
    ("arg", "/AsyncFunctionDef.args/arguments.args", "async_parameter"),
    ("Name", "/Assign.targets", "variable"),
    ("Name", "/Assign.targets/Tuple.elts", "variable"),
    ("Name", "/For.target", "loop_var"),
    ("Name", "/ExceptHandler.type", "exception_type"),
]
BRANCHING_NODES = ["If", "While", "For", "ExceptHandler", "With", "Assert", "comprehension"]


def _role_ends(suffix: str) -> Column:
    return F.concat(F.lit("/"), F.col("role")).endswith(suffix)


def define_symbols(nodes: DataFrame) -> DataFrame:
    """One row per definition: ``doc_id, name, node_type, scope_depth, definition_line, node_id``."""
    kind = F.lit(None).cast("string")
    for node_type, symbol in DEFINING_NODES.items():
        kind = F.when((F.col("node_type") == node_type) & (F.col("skips") == 0), symbol).otherwise(kind)
    for node_type, role, symbol in DEFINING_ROLES:
        # the statement itself is visited, this part of it is its one unvisited edge
        here = (F.col("node_type") == node_type) & _role_ends(role) & (F.col("skips") == 1)
        kind = F.when(here, symbol).otherwise(kind)
    rows = nodes.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    return rows.select(
        "doc_id",
        "name",
        F.col("_kind").alias("node_type"),
        F.col("depth").alias("scope_depth"),
        F.col("stmt_line").alias("definition_line"),
        "node_id",
    )


def usages(nodes: DataFrame) -> DataFrame:
    """Places where a name is read or updated: ``doc_id, name, node_id``."""
    name = F.col("node_type") == "Name"
    read = name & F.col("is_load") & (F.col("skips") == 0)
    updated = name & _role_ends("/AugAssign.target") & (F.col("skips") == 1)
    return nodes.filter(read | updated).select("doc_id", "name", "node_id")


def resolve_symbol(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """As-of lookup: each use with the latest definition of its name so far, or NULL."""
    defined = symbols.select("doc_id", "name", "node_id", F.col("node_id").alias("def_id"))
    used = uses.select("doc_id", "name", "node_id", F.lit(None).cast("int").alias("def_id"))
    both = defined.withColumn("_use", F.lit(0)).unionByName(used.withColumn("_use", F.lit(1)))
    rows = latest_defined(
        both, ["doc_id", "name"], ["node_id", "_use"], "definition", F.col("def_id"), split=PER_TEXT
    )
    return rows.filter(F.col("_use") == 1).select("doc_id", "name", "node_id", "definition")


def count_usages(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """Symbols with ``usage_count``; uses without an earlier definition are ignored."""
    resolved = resolve_symbol(symbols, uses).filter(F.col("definition").isNotNull())
    counts = resolved.groupBy("doc_id", F.col("definition").alias("node_id")).agg(
        F.count(F.lit(1)).alias("usage_count")
    )
    rows = symbols.join(counts, ["doc_id", "node_id"], "left")
    count = F.coalesce("usage_count", F.lit(0).cast("bigint"))
    return rows.select(*symbols.columns, count.alias("usage_count"))


def kind_counts(df: DataFrame, id_column: str, kind: str, kinds: list[str]) -> DataFrame:
    """Rows per document of each listed kind, one ``n_<kind>`` column per kind."""
    return df.groupBy(id_column).agg(
        *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    )


def symbol_density(counted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Usages per symbol of each document."""
    total, symbols = F.sum("usage_count"), F.count(F.lit(1))
    return counted.groupBy(id_column).agg((total / symbols).alias("density"))


def subtree_sums(nodes: DataFrame, anchors: Column, weight: Column, name: str) -> DataFrame:
    """Sum of ``weight`` over each anchor node and everything below it.

    A subtree is a range in depth-first order, so its sum is the difference of
    two running sums: no anchor is paired with its descendants.
    """
    rows = nodes.select("doc_id", "node_id", "dfs_end", weight.alias("_w"), anchors.alias("_anchor"))
    rows = running_sums(rows, ["doc_id"], ["node_id"], {"_upto": F.col("_w")}, split=PER_TEXT)
    ends = rows.select("doc_id", F.col("node_id").alias("dfs_end"), F.col("_upto").alias("_end"))
    found = rows.filter("_anchor").join(ends, ["doc_id", "dfs_end"])
    return found.select("doc_id", "node_id", (F.col("_end") - F.col("_upto") + F.col("_w")).alias(name))


def cyclomatic_complexity(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, bfs_ord, name, complexity`` of every function (not async ones)."""
    branch = F.col("node_type").isin(BRANCHING_NODES)
    operand = _role_ends("/BoolOp.values") & (F.col("pos") > 0)
    weight = F.coalesce(branch.cast("int"), F.lit(0)) + F.coalesce(operand.cast("int"), F.lit(0))
    is_function = F.col("node_type") == "FunctionDef"
    sums = subtree_sums(nodes, is_function, weight, "_sum")
    named = nodes.filter(is_function).select("doc_id", "node_id", "bfs_ord", "name")
    rows = named.join(sums, ["doc_id", "node_id"])
    complexity = (F.col("_sum") + 1).cast("bigint")
    return rows.select("doc_id", "node_id", "bfs_ord", "name", complexity.alias("complexity"))


def first_n_per_group(df: DataFrame, keys: list[str], order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``place`` (0-based); limited before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    rows = df.withColumn("place", place).filter(F.col("place") <= n)
    return rows.withColumn("place", F.col("place") - 1)


def flow_features(nodes: DataFrame, dim: int = 512) -> DataFrame:
    """Two slots per assignment in breadth-first order: ``doc_id, slot, value``.

    Slot 2k holds targets / (depth + 1) and slot 2k+1 log(1 + depth), where depth
    is the height of the assigned value.
    """
    targets = F.count_if(_role_ends("/Assign.targets")).alias("_targets")
    depth = F.max(F.when(_role_ends("/Assign.value"), F.col("height"))).alias("_depth")
    parts = nodes.filter(_role_ends("/Assign.targets") | _role_ends("/Assign.value"))
    sums = parts.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(targets, depth)
    assigned = nodes.filter(F.col("node_type") == "Assign").select("doc_id", "node_id", "bfs_ord")
    rows = assigned.join(sums, ["doc_id", "node_id"])
    rows = first_n_per_group(rows, ["doc_id"], ["bfs_ord"], dim // 2)
    pair = F.array(
        F.struct((2 * F.col("place")).alias("slot"), (F.col("_targets") / (F.col("_depth") + 1.0)).alias("value")),
        F.struct((2 * F.col("place") + 1).alias("slot"), F.log1p("_depth").alias("value")),
    )
    return rows.select("doc_id", F.explode(pair).alias("_p")).select("doc_id", "_p.slot", "_p.value")


def complexity_decay(complexity: Column, place: Column) -> Column:
    """``exp(-complexity / 10) * sin(0.1 * place)``."""
    return F.exp(-complexity / 10.0) * F.sin(place * 0.1)


def name_encoding(df: DataFrame, id_column: str, name: str, order: str, dim: int = 128) -> DataFrame:
    """``id, slot, value`` for the first ``dim`` distinct names of a document.

    ``value = count * sin(bucket(name) mod 100) * cos(0.1 * slot)`` with slots in
    order of first appearance.
    """
    names = df.groupBy(id_column, name).agg(
        F.count(F.lit(1)).alias("_count"), F.min(order).alias("_first")
    )
    rows = first_n_per_group(names, [id_column], ["_first"], dim)
    wave = F.sin(name_bucket(F.col(name), 100).cast("double")) * F.cos(F.col("place") * 0.1)
    return rows.select(id_column, F.col("place").alias("slot"), (F.col("_count") * wave).alias("value"))


def slots_to_array(slots: DataFrame, id_column: str, dim: int, name: str) -> DataFrame:
    """Sparse ``slot, value`` rows (at most ``dim`` per id) to one dense array per id."""
    entries = F.map_from_entries(F.collect_list(F.struct("slot", "value")))
    packed = slots.filter(F.col("slot") < dim).groupBy(id_column).agg(entries.alias("_m"))
    every = F.sequence(F.lit(0), F.lit(dim - 1))
    # bound outside the inner lambda, or the map is made from its entries again for each slot
    dense = let(F.col("_m"), lambda m: F.transform(every, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
    return packed.select(id_column, dense.alias(name))
