"""Node tables: one row per element of a tree-shaped text.

``source_nodes`` parses Python texts, ``tag_nodes`` reads the tags of HTML.
Everything after them is relational.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ``node_id`` is the place in depth-first order, ``dfs_end`` the last node below
# it, ``bfs_ord`` the place in breadth-first order and ``height`` the number of
# levels from the node down.  ``role`` names the last two edges that lead to the
# node (``For.body``, ``Assign.targets/Tuple.elts``), ``pos`` the place in the
# field, ``stmt_line`` the line of the closest statement and ``skips`` how many
# unvisited edges lie above (see UNVISITED).
NODE_SCHEMA = (
    "node_id INT, parent_id INT, grandparent_id INT, bfs_ord INT, dfs_end INT, depth INT, height INT, "
    "node_type STRING, name STRING, line INT, parent_line INT, stmt_line INT, role STRING, pos INT, "
    "is_load BOOLEAN, skips INT"
)

# fixed values: parts of statements in which symbols, usages and flow do not count
UNVISITED = {
    "Module": ["type_ignores"],
    "FunctionDef": ["args", "decorator_list", "returns", "type_params"],
    "AsyncFunctionDef": ["args", "decorator_list", "returns", "type_params"],
    "ClassDef": ["keywords", "decorator_list", "type_params"],
    "Assign": ["targets"],
    "AugAssign": ["target", "op"],
    "If": ["test"],
    "For": ["target", "iter", "orelse"],
    "While": ["test", "orelse"],
    "Try": ["orelse"],
    "ExceptHandler": ["type"],
}

ROWS_PER_BATCH = 50_000


def _children(node: ast.AST) -> list[tuple[str, int, ast.AST]]:
    found = []
    for field, value in ast.iter_fields(node):
        many = value if isinstance(value, list) else [value]
        found += [(field, i, child) for i, child in enumerate(many) if isinstance(child, ast.AST)]
    return found


def _label(node: ast.AST) -> str | None:
    for attribute in ("name", "id", "attr", "arg"):
        value = getattr(node, attribute, None)
        if isinstance(value, str):
            return value
    return None


def node_rows(text: str) -> list[tuple]:
    """The nodes of one Python text in depth-first order, as tuples of NODE_SCHEMA."""
    rows: list[list] = []
    # node, parent id, edge, position, statement line, unvisited edges so far
    stack = [(ast.parse(text), -1, "", 0, 0, 0)]
    while stack:
        node, parent, edge, pos, stmt_line, skips = stack.pop()
        here = len(rows)
        above = rows[parent] if parent >= 0 else None
        line = getattr(node, "lineno", None)
        if isinstance(node, (ast.stmt, ast.excepthandler)):
            stmt_line = line
        kind = type(node).__name__
        before = above[12].rpartition("/")[2] if above else ""
        role = f"{before}/{edge}" if before else edge
        grandparent = above[1] if above else -1
        depth = above[5] + 1 if above else 0
        parent_line = above[9] if above else None
        is_load = isinstance(getattr(node, "ctx", None), ast.Load)
        rows.append(
            [here, parent, grandparent, 0, here, depth, 1, kind, _label(node), line, parent_line,
             stmt_line, role, pos, is_load, skips]
        )
        unvisited = UNVISITED.get(kind, ())
        for field, i, child in reversed(_children(node)):
            skipped = skips + (field in unvisited)
            stack.append((child, here, f"{kind}.{field}", i, stmt_line, skipped))
    for row in reversed(rows):
        if row[1] >= 0:
            above = rows[row[1]]
            above[4] = max(above[4], row[4])
            above[6] = max(above[6], row[6] + 1)
    for place, row in enumerate(sorted(rows, key=lambda row: row[5])):
        row[3] = place
    return [tuple(row) for row in rows]


def source_nodes(
    sources: DataFrame, id_column: str = "doc_id", text: str = "text", *, spread: bool = True
) -> DataFrame:
    """Parse each text into node rows; a text that does not parse gives one ``_error`` row.

    Parsing costs far more than moving a text, so texts are first spread over
    ``spark.sql.shuffle.partitions`` tasks by id; ``spread=False`` keeps the
    partitions of the input.
    """
    kind = sources.schema[id_column].dataType.simpleString()
    names = [part.split()[0] for part in NODE_SCHEMA.split(", ")]
    empty = dict.fromkeys(names) | {"node_id": 0, "parent_id": -1, "node_type": "_error"}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for ident, body in zip(batch["doc_id"], batch["text"]):
                try:
                    out += [(ident, *row) for row in node_rows(body)]
                except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
                    out.append((ident, *empty.values()))
                if len(out) >= ROWS_PER_BATCH:
                    yield pd.DataFrame(out, columns=["doc_id", *names])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["doc_id", *names])

    rows = sources.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    if spread:
        tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, "doc_id")
    return rows.mapInPandas(parse, f"doc_id {kind}, {NODE_SCHEMA}")


# fixed values: tags that are often left open do not change the depth
VOID_TAGS = ["br", "meta", "p"]


def tags(html: Column) -> Column:
    """The tags of a page in order; closing tags start with a slash."""
    return F.regexp_extract_all(html, F.lit(r"<(/?[a-zA-Z0-9]+)"), F.lit(1))


def tag_nodes(pages: DataFrame, id_column: str, html: str, void: list[str] = VOID_TAGS) -> DataFrame:
    """Tags as nodes: ``id, ord, tag, is_open, depth`` (depth after the tag).

    Pages move to the tasks by id before their tags are unfolded, so the
    running depth needs no further shuffle.
    """
    found = pages.select(id_column, tags(F.col(html)).alias("_tags")).repartition(id_column)
    # the outer form keeps the optimizer from repeating the pattern in a filter below
    rows = found.select(id_column, F.posexplode_outer("_tags").alias("ord", "_raw"))
    rows = rows.filter(F.col("ord").isNotNull())
    is_open = ~F.col("_raw").startswith("/")
    rows = rows.withColumns({"is_open": is_open, "tag": F.lower(F.ltrim(F.col("_raw"), F.lit("/")))})
    step = F.when(F.col("tag").isin(void), 0).when(F.col("is_open"), 1).otherwise(-1)
    # all tags of a page come from one row of the table
    order = Window.partitionBy(id_column).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(step).over(order)
    return rows.select(id_column, "ord", "tag", "is_open", depth.alias("depth"))
