"""Queries over trees, symbols and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.common import Query, r, rounded, table
from tidemark.functions.hashing import positional_encoding as encode
from tidemark.operators import features, graph, patterns, subtrees, symbols
from tidemark.plans.running import latest_defined
from tidemark.session import joined_by_sort, stored
from tidemark.sources.nodes import source_nodes, tag_nodes, tags
from tidemark.sources.store import flatten_struct

# ---- pages: tags as nodes


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_nodes(table(spark, sf_dir, "pages"), "page_id", "html")


TAGS_SQL = """
SELECT page_id, ord, is_open, tag,
       CAST(sum(CASE WHEN tag IN ('br', 'meta', 'p') THEN 0 WHEN is_open THEN 1 ELSE -1 END)
            OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
FROM (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, NOT starts_with(raw[i], '/') AS is_open,
         lower(ltrim(raw[i], '/')) AS tag
  FROM (SELECT page_id, raw, unnest(range(1, len(raw) + 1)) AS i
        FROM (SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z0-9]+)', 1) AS raw FROM pages)))"""


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tags(spark, sf_dir).groupBy("page_id").agg(F.max("depth").alias("depth"))


TREE_DEPTH_SQL = f"SELECT page_id, max(depth) AS depth FROM ({TAGS_SQL}) GROUP BY page_id"

KINDS = ["a", "div", "li", "p"]


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = page_tags(spark, sf_dir).filter("is_open")
    return symbols.kind_counts(opened, "page_id", "tag", KINDS)


KIND_COUNTS_SQL = f"""
SELECT page_id, {', '.join(f"count(*) FILTER (tag = '{k}') AS n_{k}" for k in KINDS)}
FROM ({TAGS_SQL}) WHERE is_open GROUP BY page_id"""


def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_tags(spark, sf_dir).select("page_id", "ord", "tag")
    return symbols.first_n_per_group(rows, ["page_id"], ["ord"], 16)


FIRST_N_SQL = f"SELECT page_id, ord, tag, ord AS place FROM ({TAGS_SQL}) WHERE ord < 16"


def name_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = page_tags(spark, sf_dir).filter("is_open")
    found = symbols.name_encoding(opened, "page_id", "tag", "ord")
    return found.select("page_id", "slot", *rounded("value"))


def _bucket_sql(name: str, buckets: int) -> str:
    return f"CAST('0x' || substr(md5({name}), 1, 8) AS BIGINT) % {buckets}"


NAME_ENCODING_SQL = f"""
WITH n AS (
  SELECT page_id, tag, count(*) AS c, min(ord) AS first FROM ({TAGS_SQL}) WHERE is_open GROUP BY page_id, tag),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS INTEGER) AS slot FROM n)
SELECT page_id, slot, {r(f"c * sin(CAST({_bucket_sql('tag', 100)} AS DOUBLE)) * cos(slot * 0.1)", 'value')}
FROM s WHERE slot < 128"""


def positional_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", tags(F.col("html")).alias("types"))
    found = rows.select("page_id", F.posexplode(encode(F.col("types"))).alias("slot", "value"))
    return found.select("page_id", "slot", *rounded("value"))


POSITIONAL_ENCODING_SQL = f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS slot,
       {r(f"sin({_bucket_sql('raw[i]', 512)} * 0.1) * cos((i - 1) * 0.05)", 'value')}
FROM (SELECT page_id, raw, unnest(range(1, least(len(raw), 512) + 1)) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z0-9]+)', 1) AS raw FROM pages))"""


def complexity_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a page in order, with the depth at their start as complexity."""
    opened = page_tags(spark, sf_dir).filter("is_open AND tag IN ('div', 'article', 'nav', 'footer')")
    rows = symbols.first_n_per_group(opened, ["page_id"], ["ord"], 256)
    found = rows.withColumn("value", symbols.complexity_decay(F.col("depth"), F.col("place")))
    return found.select("page_id", "place", *rounded("value"))


COMPLEXITY_DECAY_SQL = f"""
WITH s AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS place
  FROM ({TAGS_SQL}) WHERE is_open AND tag IN ('div', 'article', 'nav', 'footer'))
SELECT page_id, place, {r('exp(-depth / 10.0) * sin(place * 0.1)', 'value')} FROM s WHERE place < 256"""

# ---- conversations: tokens as symbols


def symbol_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    tokens = rows.select("conv_id", F.explode(F.split("text", "[ \\n]+")).alias("token"))
    counted = tokens.groupBy("conv_id", "token").agg((F.count(F.lit(1)) - 1).alias("usage_count"))
    return symbols.symbol_density(counted, "conv_id").select("conv_id", *rounded("density"))


SYMBOL_DENSITY_SQL = f"""
WITH t AS (SELECT conv_id, unnest(string_split_regex(text, '[ \\n]+')) AS token FROM conversations)
SELECT conv_id, {r('(count(*) - count(DISTINCT token)) / CAST(count(DISTINCT token) AS DOUBLE)', 'density')}
FROM t GROUP BY conv_id"""


def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the latest earlier turn of the assistant."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    said = F.when(F.col("role") == "assistant", F.col("turn"))
    return latest_defined(rows, ["conv_id"], ["turn"], "definition", said, include_self=False)


RESOLVE_SYMBOL_SQL = """
SELECT conv_id, turn, role, max(turn) FILTER (role = 'assistant')
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition
FROM conversations"""

# ---- events: state changes per user as small graphs


def user_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return graph.transitions(rows, ["user_id"], ["ts", "event_id"], "event_type")


TRANSITIONS_SQL = """
SELECT user_id, source, event_type AS target
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source FROM events)
WHERE source IS NOT NULL"""


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = user_transitions(spark, sf_dir)
    return edges.groupBy("user_id", "source", "target").agg(F.count(F.lit(1)).alias("edges"))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(user_transitions(spark, sf_dir), ["user_id"])


DEGREES_SQL = f"""
SELECT user_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT user_id, source AS node, 0 AS i, 1 AS o FROM ({TRANSITIONS_SQL})
      UNION ALL SELECT user_id, target, 1, 0 FROM ({TRANSITIONS_SQL}))
GROUP BY user_id, node"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(user_transitions(spark, sf_dir), ["user_id"])


GRAPH_NODES_SQL = f"""
SELECT user_id, source AS node FROM ({TRANSITIONS_SQL}) UNION SELECT user_id, target FROM ({TRANSITIONS_SQL})"""


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that count: the states of a user other than errors."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    return rows.select("user_id", F.col("event_type").alias("node")).distinct()


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = user_transitions(spark, sf_dir)
    return graph.adjacency(edges, _registered(spark, sf_dir), ["user_id"])


ADJACENCY_SQL = f"""
SELECT DISTINCT user_id, source, target FROM ({TRANSITIONS_SQL}) WHERE source <> 'error' AND target <> 'error'"""


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _registered(spark, sf_dir)
    pairs = graph.adjacency(user_transitions(spark, sf_dir), nodes, ["user_id"])
    return graph.laplacian(pairs, nodes, ["user_id"])


LAPLACIAN_SQL = f"""
WITH a AS ({ADJACENCY_SQL}),
n AS (SELECT DISTINCT user_id, event_type AS node FROM events WHERE event_type <> 'error')
SELECT user_id, row, col, sum(value) AS value
FROM (SELECT user_id, source AS row, target AS col, -1.0::DOUBLE AS value FROM a
      UNION ALL SELECT user_id, source, source, 1.0 FROM a
      UNION ALL SELECT user_id, node, node, 0.0 FROM n)
GROUP BY user_id, row, col"""


def pagerank_sql(edges: str, nodes: str, key: str, iterations: int, giver: str, taker: str) -> str:
    """Unrolled steps, one CTE each; ``key`` is a column or a constant."""
    steps = "".join(
        f""",
r{i + 1} AS MATERIALIZED (
  SELECT b.g, b.node, 0.15 / c + 0.85 * coalesce(f, 0.0) AS rank
  FROM b LEFT JOIN (
    SELECT e.g, e.b AS node, sum(rank / share) AS f
    FROM e JOIN r{i} r ON r.g = e.g AND r.node = e.a JOIN s ON s.g = e.g AND s.node = e.a GROUP BY e.g, e.b
  ) x ON x.g = b.g AND x.node = b.node)"""
        for i in range(iterations)
    )
    return f"""
WITH e AS MATERIALIZED (SELECT DISTINCT {key} AS g, {giver} AS a, {taker} AS b FROM ({edges})),
b AS MATERIALIZED (SELECT g, node, CAST(count(*) OVER (PARTITION BY g) AS DOUBLE) AS c
                   FROM (SELECT DISTINCT {key} AS g, node FROM ({nodes}))),
s AS MATERIALIZED (SELECT g, a AS node, count(*) AS share FROM e GROUP BY g, a),
r0 AS MATERIALIZED (SELECT g, node, 1.0 / c AS rank FROM b){steps}
"""


def pagerank_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small graph per user, 100 steps."""
    edges = user_transitions(spark, sf_dir)
    found = graph.pagerank(edges, graph.graph_nodes(edges, ["user_id"]), ["user_id"])
    return found.select("user_id", "node", *rounded("rank", digits=9))


PAGERANK_USERS_SQL = f"""{pagerank_sql(TRANSITIONS_SQL, GRAPH_NODES_SQL, 'user_id', 100, 'target', 'source')}
SELECT g AS user_id, node, {r('rank', 'rank', 9)} FROM r100"""

PART_STEPS = 10


def part_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each line of an order to its next line, as a graph of parts."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    order = ["l_linenumber", "l_partkey", "l_extendedprice"]
    return graph.transitions(rows, ["l_orderkey"], order, "l_partkey").select("source", "target")


PART_TRANSITIONS_SQL = """
SELECT source, l_partkey AS target
FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)
             AS source FROM lineitem)
WHERE source IS NOT NULL"""


def _pagerank_parts(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    edges = part_transitions(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    found = graph.pagerank(edges, nodes, iterations=PART_STEPS, direction=direction)
    return found.select("node", *rounded("rank", digits=9))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pagerank_parts(spark, sf_dir, "reverse")


def pagerank_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pagerank_parts(spark, sf_dir, "forward")


_PARTS_SQL = "SELECT p_partkey AS node FROM part"


def _parts_sql(giver: str, taker: str) -> str:
    steps = pagerank_sql(PART_TRANSITIONS_SQL, _PARTS_SQL, "0", PART_STEPS, giver, taker)
    return f"{steps} SELECT node, {r('rank', 'rank', 9)} FROM r{PART_STEPS}"


# ---- customers: one Python source each, chosen by market segment

SOURCES = {
    "AUTOMOBILE": (
        "def complex_#(n):\n"
        "    for i in range(n):\n"
        "        if i % 2 == 0 and n > # or i < 3:\n"
        "            total = i\n"
        "    return n\n"
    ),
    "BUILDING": (
        "class Store_#:\n"
        "    def find(self, cur, v):\n"
        "        cur.execute('select a from t where b = %s' % v)\n"
        "        return eval(v)\n"
    ),
    "FURNITURE": (
        "x = #\n"
        "y, z = x, [a for a in range(x) if a]\n"
        "try:\n"
        "    x += 1\n"
        "    password = 'hunter-#-hunter'\n"
        "except ValueError:\n"
        "    w = x\n"
    ),
    "MACHINERY": (
        "async def run_#(a, b):\n"
        "    while a:\n"
        "        b = a\n"
        "        a -= 1\n"
        "    return b\n"
    ),
    "HOUSEHOLD": "def broken_#(:\n    password = 'hunter-#-hunter'\n",
}


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: a source per customer with its key in names and numbers."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    texts = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])
    text = F.replace(F.try_element_at(texts, F.col("c_mktsegment")), F.lit("#"), F.col("c_custkey").cast("string"))
    return rows.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once and stored: most queries need the nodes several times."""
    return joined_by_sort(stored(source_nodes(customer_sources(spark, sf_dir)), "nodes"))


def _per_segment(columns: list[str], rows: list[tuple], select: str) -> str:
    """SQL that gives every customer the expected rows of its segment; ``#`` becomes the key."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, (int, float)) else f"'{value}'"

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"""
WITH t(segment, {', '.join(columns)}) AS (VALUES {values})
SELECT c_custkey AS doc_id, {select} FROM customer JOIN t ON segment = c_mktsegment"""


_KEYED = "replace(name, '#', CAST(c_custkey AS VARCHAR)) AS name"


def source_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each source by type and line; unparsable sources give one error row."""
    nodes = source_nodes(customer_sources(spark, sf_dir))
    kinds = ["FunctionDef", "AsyncFunctionDef", "ClassDef", "If", "For", "While", "Try", "Return", "_error"]
    kept = nodes.filter(F.col("node_type").isin(kinds))
    return kept.select("doc_id", "node_type", "name", "line", "depth")


SOURCE_NODES_SQL = _per_segment(
    ["node_type", "name", "line", "depth"],
    [
        ("AUTOMOBILE", "FunctionDef", "complex_#", 1, 1), ("AUTOMOBILE", "For", None, 2, 2),
        ("AUTOMOBILE", "If", None, 3, 3), ("AUTOMOBILE", "Return", None, 5, 2),
        ("BUILDING", "ClassDef", "Store_#", 1, 1), ("BUILDING", "FunctionDef", "find", 2, 2),
        ("BUILDING", "Return", None, 4, 3), ("FURNITURE", "Try", None, 3, 1),
        ("MACHINERY", "AsyncFunctionDef", "run_#", 1, 1), ("MACHINERY", "While", None, 2, 2),
        ("MACHINERY", "Return", None, 5, 2), ("HOUSEHOLD", "_error", None, None, None),
    ],
    f"node_type, {_KEYED}, line, depth",
)


def count_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = customer_nodes(spark, sf_dir)
    found = symbols.count_usages(symbols.define_symbols(nodes), symbols.usages(nodes))
    return found.select("doc_id", "name", "node_type", "definition_line", "usage_count")


_SYMBOLS = [
    ("AUTOMOBILE", "complex_#", "function", 1, 0), ("AUTOMOBILE", "n", "parameter", 1, 1),
    ("AUTOMOBILE", "i", "loop_var", 2, 1), ("AUTOMOBILE", "total", "variable", 4, 0),
    ("BUILDING", "Store_#", "class", 1, 0), ("BUILDING", "find", "function", 2, 0),
    ("BUILDING", "self", "parameter", 2, 0), ("BUILDING", "cur", "parameter", 2, 1),
    ("BUILDING", "v", "parameter", 2, 2), ("FURNITURE", "x", "variable", 1, 4),
    ("FURNITURE", "y", "variable", 2, 0), ("FURNITURE", "z", "variable", 2, 0),
    ("FURNITURE", "password", "variable", 5, 0), ("FURNITURE", "ValueError", "exception_type", 6, 0),
    ("FURNITURE", "w", "variable", 7, 0), ("MACHINERY", "run_#", "async_function", 1, 0),
    ("MACHINERY", "a", "async_parameter", 1, 2), ("MACHINERY", "b", "async_parameter", 1, 0),
    ("MACHINERY", "b", "variable", 3, 1),
]
COUNT_USAGES_SQL = _per_segment(
    ["name", "node_type", "definition_line", "usage_count"],
    _SYMBOLS,
    f"{_KEYED}, node_type, definition_line, CAST(usage_count AS BIGINT) AS usage_count",
)


def define_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.define_symbols(source_nodes(customer_sources(spark, sf_dir)))
    return found.select("doc_id", "name", "node_type", "definition_line")


DEFINE_SYMBOLS_SQL = _per_segment(
    ["name", "node_type", "definition_line"],
    [row[:4] for row in _SYMBOLS],
    f"{_KEYED}, node_type, definition_line",
)


def cyclomatic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.cyclomatic_complexity(customer_nodes(spark, sf_dir))
    return found.select("doc_id", "name", "complexity")


CYCLOMATIC_SQL = _per_segment(
    ["name", "complexity"],
    [("AUTOMOBILE", "complex_#", 5), ("BUILDING", "find", 1)],
    f"{_KEYED}, CAST(complexity AS BIGINT) AS complexity",
)


def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.flow_features(customer_nodes(spark, sf_dir))
    return found.select("doc_id", "slot", *rounded("value"))


# segment, place of the assignment, height of its value; one target each
_ASSIGNED = [
    ("AUTOMOBILE", 0, 2), ("FURNITURE", 0, 1), ("FURNITURE", 1, 6), ("FURNITURE", 2, 1),
    ("FURNITURE", 3, 2), ("MACHINERY", 0, 2),
]
_FLOW_SQL = _per_segment(["k", "height"], _ASSIGNED, "k, height")
FLOW_FEATURES_SQL = f"""
SELECT doc_id, 2 * k AS slot, {r('1.0 / (height + 1.0)', 'value')} FROM ({_FLOW_SQL})
UNION ALL SELECT doc_id, 2 * k + 1, {r('ln(1.0 + height)', 'value')} FROM ({_FLOW_SQL})"""


def source_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flow_edges(customer_nodes(spark, sf_dir))


_EDGES = [
    ("AUTOMOBILE", 1, 2, "loop", "for"), ("AUTOMOBILE", 2, 3, "branch", "if"),
    ("AUTOMOBILE", 3, 4, "assign", None), ("AUTOMOBILE", 3, 2, "loop_back", "for"),
    ("FURNITURE", 1, 2, "assign", None), ("FURNITURE", 2, 3, "try", None),
    ("FURNITURE", 3, 4, "aug_assign", None), ("FURNITURE", 4, 5, "assign", None),
    ("FURNITURE", 5, 6, "exception", None), ("FURNITURE", 6, 7, "assign", None),
    ("MACHINERY", 1, 2, "loop", "while"), ("MACHINERY", 2, 3, "assign", None),
    ("MACHINERY", 3, 4, "aug_assign", None), ("MACHINERY", 4, 2, "loop_back", "while"),
]
SOURCE_FLOW_EDGES_SQL = _per_segment(
    ["source", "target", "edge_type", "condition"], _EDGES, "source, target, edge_type, condition"
)


def call_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.query_calls(customer_nodes(spark, sf_dir))
    return found.select("doc_id", "name", "line")


CALL_PATTERN_SQL = "SELECT c_custkey AS doc_id, 'execute' AS name, 3 AS line FROM customer WHERE c_mktsegment = 'BUILDING'"


def dangerous_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.dangerous_calls(source_nodes(customer_sources(spark, sf_dir)))
    return found.select("doc_id", "name", "line")


DANGEROUS_CALLS_SQL = "SELECT c_custkey AS doc_id, 'eval' AS name, 4 AS line FROM customer WHERE c_mktsegment = 'BUILDING'"


def scan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, nodes = customer_sources(spark, sf_dir), customer_nodes(spark, sf_dir)
    return flatten_struct(patterns.scan_flags(sources, nodes))


SCAN_FLAGS_SQL = """
SELECT c_custkey AS doc_id, c_mktsegment = 'BUILDING' AS security_flags_sql_injection,
       c_mktsegment = 'FURNITURE' AS security_flags_hardcoded_secrets,
       c_mktsegment = 'BUILDING' AS security_flags_eval_exec
FROM customer"""


def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names anywhere below each function."""
    nodes = customer_nodes(spark, sf_dir)
    functions = F.col("node_type").isin("FunctionDef", "AsyncFunctionDef")
    names = (F.col("node_type") == "Name").cast("int")
    return symbols.subtree_sums(nodes, functions, names, "names").select("doc_id", "names")


SUBTREE_SQL = _per_segment(
    ["names"], [("AUTOMOBILE", 9), ("BUILDING", 4), ("MACHINERY", 5)], "CAST(names AS BIGINT) AS names"
)


def subtree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag of a page that may hold others, with every opening tag inside."""
    tags = stored(page_tags(spark, sf_dir), "tags")
    holders = subtrees.tag_intervals(tags, "page_id").select("page_id", "ord", "end", F.lit(True).alias("holds"))
    nodes = tags.filter("is_open").select("page_id", "ord").join(holders, ["page_id", "ord"], "left")
    nodes = nodes.withColumn("end", F.coalesce("end", "ord"))
    return subtrees.subtree_pairs(nodes, F.col("holds"), F.lit(True), id_column="page_id", place="ord", end="end")


SUBTREE_PAIRS_SQL = f"""
WITH t AS MATERIALIZED ({TAGS_SQL}),
holders AS (
  SELECT page_id, ord, depth FROM t WHERE is_open AND tag NOT IN ('br', 'meta', 'p')),
ends AS (
  SELECT h.page_id, h.ord, min(t.ord) AS closed FROM holders h JOIN t ON t.page_id = h.page_id AND t.ord > h.ord AND t.depth < h.depth
  GROUP BY h.page_id, h.ord)
SELECT h.page_id, h.ord AS ancestor, t.ord AS descendant
FROM holders h LEFT JOIN ends e ON e.page_id = h.page_id AND e.ord = h.ord
JOIN t ON t.page_id = h.page_id AND t.is_open AND t.ord > h.ord AND t.ord < coalesce(e.closed, 1000000000)"""


def subtree_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read inside each function or class, with the place of both."""
    nodes = customer_nodes(spark, sf_dir)
    holders = F.col("node_type").isin("FunctionDef", "AsyncFunctionDef", "ClassDef")
    names = (F.col("node_type") == "Name") & F.col("is_load")
    found = subtrees.subtree_pairs(nodes, holders, names)
    named = nodes.select("doc_id", F.col("node_id").alias("descendant"), "name")
    found = found.join(named, ["doc_id", "descendant"])
    return found.groupBy("doc_id", "ancestor", "name").agg(F.count(F.lit(1)).alias("reads")).drop("ancestor")


SUBTREE_CALLS_SQL = _per_segment(
    ["name", "reads"],
    [
        ("AUTOMOBILE", "range", 1), ("AUTOMOBILE", "n", 3), ("AUTOMOBILE", "i", 3),
        ("BUILDING", "cur", 1), ("BUILDING", "v", 2), ("BUILDING", "eval", 1),
        ("BUILDING", "cur", 1), ("BUILDING", "v", 2), ("BUILDING", "eval", 1),
        ("MACHINERY", "a", 2), ("MACHINERY", "b", 1),
    ],
    "name, CAST(reads AS BIGINT) AS reads",
)


def complexity_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.complexity_vector(customer_nodes(spark, sf_dir))
    rows = found.select("doc_id", F.posexplode("complexity").alias("slot", "value"))
    return rows.select("doc_id", "slot", *rounded("value"))


# segment, values of the first eight slots, definition depths
_COMPLEXITY = [
    ("AUTOMOBILE", [1, 0, 1, 1, 2, 3, 4, 4], [1, 3, 3, 5]),
    ("BUILDING", [1, 1, 0, 0, 0, 0, 2, 0], [1, 2, 4, 4, 4]),
    ("FURNITURE", [0, 0, 5, 0, 0, 0, 7, 6], [2, 3, 3, 3, 3, 4]),
    ("MACHINERY", [0, 0, 1, 0, 2, 0, 4, 4], [1, 3, 3, 4]),
]
_LINES = [("AUTOMOBILE", 4), ("BUILDING", 2), ("FURNITURE", 7), ("MACHINERY", 4)]
_FLOW_EDGES_SQL = "SELECT * FROM (VALUES {}) t(segment, source, target)".format(
    ", ".join(f"('{s}', {a}, {b})" for s, a, b, _, _ in _EDGES)
)
_FLOW_NODES_SQL = "SELECT segment, unnest(range(1, n + 1)) AS node FROM (VALUES {}) t(segment, n)".format(
    ", ".join(f"('{s}', {n})" for s, n in _LINES)
)
COMPLEXITY_VECTOR_SQL = f"""{
    pagerank_sql(_FLOW_EDGES_SQL, _FLOW_NODES_SQL, 'segment', 100, 'target', 'source')},
v(segment, counts, depths) AS (VALUES {', '.join(f"('{s}', {c}, {d})" for s, c, d in _COMPLEXITY)}),
q AS (SELECT g AS segment, avg(rank) AS mean, stddev_pop(rank) AS std FROM r100 GROUP BY g),
d AS (SELECT segment, d, count(*) AS c FROM (SELECT segment, unnest(depths) AS d FROM v) GROUP BY segment, d),
h AS (
  SELECT segment, -sum(p * log2(p + 1e-12)) AS entropy
  FROM (SELECT segment, c / sum(c) OVER (PARTITION BY segment) AS p FROM d) GROUP BY segment),
l AS (
  SELECT segment, unnest(range(32)) AS slot,
         unnest(list_concat(list_concat(CAST(counts AS DOUBLE[]), [mean, std, entropy]), list_resize(CAST([] AS DOUBLE[]), 21, 0.0))) AS value
  FROM v JOIN q USING (segment) JOIN h USING (segment))
SELECT c_custkey AS doc_id, CAST(slot AS INTEGER) AS slot, {r('value', 'value')}
FROM customer JOIN l ON segment = c_mktsegment"""


def source_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.source_vectors(customer_nodes(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    rows = found.select("doc_id", F.size("embedding").alias("dim"), total.alias("total"))
    return rows.select("doc_id", "dim", *rounded("total"))


QUERIES = {
    "tag_nodes": Query(page_tags, TAGS_SQL),
    "tree_depth": Query(tree_depth, TREE_DEPTH_SQL),
    "kind_counts": Query(kind_counts, KIND_COUNTS_SQL),
    "first_n_per_group": Query(first_n_per_group, FIRST_N_SQL),
    "name_encoding": Query(name_encoding, NAME_ENCODING_SQL),
    "positional_encoding": Query(positional_encoding, POSITIONAL_ENCODING_SQL),
    "complexity_decay": Query(complexity_decay, COMPLEXITY_DECAY_SQL),
    "symbol_density": Query(symbol_density, SYMBOL_DENSITY_SQL),
    "resolve_symbol": Query(resolve_symbol, RESOLVE_SYMBOL_SQL),
    "flow_edges": Query(
        flow_edges,
        f"SELECT user_id, source, target, count(*) AS edges FROM ({TRANSITIONS_SQL}) GROUP BY ALL",
    ),
    "degrees": Query(degrees, DEGREES_SQL),
    "graph_nodes": Query(graph_nodes, GRAPH_NODES_SQL),
    "adjacency": Query(adjacency, ADJACENCY_SQL),
    "laplacian": Query(laplacian, LAPLACIAN_SQL),
    "pagerank_users": Query(pagerank_users, PAGERANK_USERS_SQL),
    "pagerank": Query(pagerank, _parts_sql("target", "source")),
    "pagerank_forward": Query(pagerank_forward, _parts_sql("source", "target")),
    "source_nodes": Query(source_node_counts, SOURCE_NODES_SQL),
    "define_symbols": Query(define_symbols, DEFINE_SYMBOLS_SQL),
    "count_usages": Query(count_usages, COUNT_USAGES_SQL),
    "cyclomatic_complexity": Query(cyclomatic_complexity, CYCLOMATIC_SQL),
    "flow_features": Query(flow_features, FLOW_FEATURES_SQL),
    "source_flow_edges": Query(source_flow_edges, SOURCE_FLOW_EDGES_SQL),
    "call_pattern": Query(call_pattern, CALL_PATTERN_SQL),
    "dangerous_calls": Query(dangerous_calls, DANGEROUS_CALLS_SQL),
    "scan_flags": Query(scan_flags, SCAN_FLAGS_SQL),
    "subtree": Query(subtree, SUBTREE_SQL),
    "subtree_pairs": Query(subtree_pairs, SUBTREE_PAIRS_SQL),
    "subtree_calls": Query(subtree_calls, SUBTREE_CALLS_SQL),
    "complexity_vector": Query(complexity_vector, COMPLEXITY_VECTOR_SQL),
    "source_vectors": Query(source_vectors),
}
