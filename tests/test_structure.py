"""Python sources, symbols, flow graphs and scans on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, graph, patterns, symbols
from tidemark.plans.segments import Split
from tidemark.sources.nodes import source_nodes

SOURCES = {
    "blank": "# nothing but a remark",
    "sums": "price = 3\ntax = 2\nshare = price / (price + tax)",
    "area": "def area(w, h):\n    size = w * h\n    return size",
    "shelf": "class Shelf:\n    def put(self, book):\n        return [book]",
    "roots": "from cmath import sqrt as root\nroot(-4)",
    "highest": "def highest(rows):\n    best = 0\n    for row in rows:\n        if row > best: return row",
    "branchy": (
        "def f(a, b):\n"
        "    if a and b or a:\n"
        "        with a: pass\n"
        "    else:\n"
        "        assert [c for c in b if c]\n"
        "    while a:\n"
        "        a += 1\n"
        "        def g(q=b): return q\n"
    ),
    "broken": "def (",
    "nul": "x = 1\x00",
}


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "doc_id string, text string")
    return source_nodes(df).persist()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bad_sources_give_one_error_row(nodes):
    failed = nodes.filter("node_type = '_error'")
    assert rows(failed, "doc_id") == [("broken",), ("nul",)]
    assert nodes.filter("doc_id IN ('broken', 'nul')").count() == 2


def test_orders_of_the_tree(nodes):
    import ast

    for doc, text in SOURCES.items():
        if doc in ("broken", "nul"):
            continue
        got = nodes.filter(F.col("doc_id") == doc)
        walked = [type(n).__name__ for n in ast.walk(ast.parse(text))]
        assert [r.node_type for r in got.orderBy("bfs_ord").collect()] == walked
        for row in got.collect():
            assert row.node_id <= row.dfs_end < len(walked)


def test_symbols_and_usages(nodes):
    found = symbols.count_usages(symbols.define_symbols(nodes), symbols.usages(nodes))

    def of(doc):
        return rows(found.filter(F.col("doc_id") == doc), "name", "node_type", "usage_count")

    assert of("sums") == [("price", "variable", 2), ("share", "variable", 0), ("tax", "variable", 1)]
    assert of("area") == [("area", "function", 0), ("h", "parameter", 1), ("size", "variable", 1), ("w", "parameter", 1)]
    assert of("shelf") == [("Shelf", "class", 0), ("book", "parameter", 1), ("put", "function", 0), ("self", "parameter", 0)]
    # the iterable of a loop and the test of a branch are not counted
    assert of("highest") == [
        ("best", "variable", 0), ("highest", "function", 0), ("row", "loop_var", 1), ("rows", "parameter", 0)
    ]
    density = dict(rows(symbols.symbol_density(found), "doc_id", "density"))
    assert density["sums"] == 1.0 and density["area"] == 0.75 and density["shelf"] == 0.25


def test_complexity(nodes):
    found = rows(symbols.cyclomatic_complexity(nodes), "doc_id", "name", "complexity")
    assert ("area", "area", 1) in found
    assert ("shelf", "put", 1) in found
    assert ("highest", "highest", 3) in found
    # if, with, assert, comprehension, while, or, and
    assert ("branchy", "f", 8) in found
    assert ("branchy", "g", 1) in found


def test_flow_edges(nodes):
    edges = graph.flow_edges(nodes)

    def of(doc):
        return rows(edges.filter(F.col("doc_id") == doc), "source", "target", "edge_type")

    assert of("sums") == [(1, 2, "assign"), (2, 3, "assign")]
    assert of("area") == [(1, 2, "assign")]
    assert of("shelf") == []
    assert of("highest") == [
        (1, 2, "assign"), (2, 3, "loop"), (3, 4, "branch"), (4, 3, "loop_back")
    ]
    assert of("branchy") == [
        (1, 2, "branch"), (2, 5, "branch"), (2, 6, "loop"), (6, 7, "aug_assign"), (7, 8, "call"),
        (8, 6, "loop_back"),
    ]


EXPECTED_RANKS = {
    # a chain: 0.15 / 3, and 0.85 of what the next one has
    "sums": {1: 0.128625, 2: 0.0925, 3: 0.05},
    "area": {1: 0.13875, 2: 0.075},
    "shelf": {1: 0.075, 2: 0.075},
    "highest": {1: 0.108611, 2: 0.083660, 3: 0.108611, 4: 0.083660},
}


@pytest.mark.parametrize("small_graph", [20_000, 0])
def test_pagerank(nodes, small_graph):
    wanted = nodes.filter(F.col("doc_id").isin(list(EXPECTED_RANKS)))
    edges, places = graph.flow_edges(wanted), graph.flow_nodes(wanted)
    iterations = 100 if small_graph else 60
    found = graph.pagerank(edges, places, ["doc_id"], small_graph=small_graph, iterations=iterations)
    got = {(r.doc_id, r.node): r["rank"] for r in found.collect()}
    assert len(got) == 11
    for doc, ranks in EXPECTED_RANKS.items():
        for node, rank in ranks.items():
            assert got[doc, node] == pytest.approx(rank, abs=2e-6)


def test_mixed_sizes_agree(spark):
    edges = [(g, i, (i * 7 + g) % 11) for g in range(4) for i in range(11 if g else 3)]
    df = spark.createDataFrame(edges, "g int, source int, target int")
    nodes = graph.graph_nodes(df, ["g"])

    def ranks(small):
        found = graph.pagerank(df, nodes, ["g"], iterations=12, small_graph=small)
        return {(r.g, r.node): round(r["rank"], 12) for r in found.collect()}

    assert ranks(15) == ranks(1000)


def test_pagerank_with_a_hot_node(spark):
    """Node 0 receives from everybody: its arcs are salted, the result is the same."""
    edges = [(i, 0) for i in range(1, 400)] + [(i, (i * 31) % 400) for i in range(400)]
    df = spark.createDataFrame(edges, "source int, target int")
    nodes = graph.graph_nodes(df, [])

    def ranks(**options):
        found = graph.pagerank(df, nodes, iterations=6, **options)
        return {r.node: round(r["rank"], 12) for r in found.collect()}

    plain = ranks()
    assert ranks(split=Split(hot_rows=50)) == plain
    assert len(plain) == 400
    assert ranks(direction="forward") != plain


def test_arcs_are_shuffled_once(spark):
    """Arcs to unknown nodes are no shares, those of unknown nodes give nothing; one shuffle finds both ends and equal arcs."""
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 2), (9, 2), (1, 9), (2, 1)], "source int, target int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    found = {r.node: r["rank"] for r in graph.pagerank(df, nodes, iterations=1, direction="forward").collect()}
    third = 1 / 3
    assert found == pytest.approx({1: 0.15 * third + 0.85 * third, 2: 0.15 * third + 1.7 * third, 3: 0.15 * third})
    arcs = graph._arcs(df.selectExpr("source AS _from", "target AS _to").hint("merge"), nodes)
    assert sorted(map(tuple, arcs.collect())) == [(1, 2), (2, 1), (3, 2), (9, 2)]
    plan = arcs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2  # one of the arcs, one of the nodes


def test_laplacian(nodes):
    places = graph.flow_nodes(nodes).filter("doc_id = 'highest'")
    pairs = graph.adjacency(graph.flow_edges(nodes), places, ["doc_id"])
    got = {(r["row"], r["col"]): r.value for r in graph.laplacian(pairs, places, ["doc_id"]).collect()}
    dense = [[got.get((i, j), 0.0) for j in (1, 2, 3, 4)] for i in (1, 2, 3, 4)]
    assert dense == [[1, -1, 0, 0], [0, 1, -1, 0], [0, 0, 1, -1], [0, 0, -1, 1]]


def test_edges_to_unknown_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 9)], "source int, target int")
    nodes = spark.createDataFrame([(1,), (2,)], "node int")
    assert rows(graph.adjacency(edges, nodes, []), "source", "target") == [(1, 2)]
    assert rows(graph.degrees(edges, []), "node", "in_degree", "out_degree") == [(1, 0, 2), (2, 2, 1), (9, 1, 0)]


SNIPPETS = {
    "a": ('cur.execute("select %s" % v)', (True, False, False)),
    "b": ('cur.execute("select %s", (v,))', (False, False, False)),
    "c": ('password = "hunter2hunter2"', (False, True, False)),
    "d": ('password = "short"', (False, False, False)),
    "e": ("eval(x)", (False, False, True)),
    "f": ("obj.eval(x)", (False, False, False)),
    "g": ("API_KEY = '" + "a1" * 16 + "'", (False, True, False)),
    "h": ("def (\npassword = 'hunter2hunter2'", (False, False, False)),
    "i": ("def f():\n    exec(y)\n    db.cur.executemany('%d' % n, z)", (True, False, True)),
    "j": ("cur.execute(q=('%s' % v))", (False, False, False)),
    "k": ("cur.execute(run('%s' % v))", (False, False, False)),
}


def test_flags(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in SNIPPETS.items()], "doc_id string, text string")
    found = patterns.scan_flags(df, source_nodes(df)).collect()
    assert {r.doc_id: tuple(r.security_flags) for r in found} == {k: v[1] for k, v in SNIPPETS.items()}


def test_flags_of_missing_text(spark):
    df = spark.createDataFrame([("a", None)], "doc_id string, text string")
    assert tuple(patterns.text_flags(df, "doc_id", "text").head().security_flags) == (False, False, False)
    assert tuple(patterns.scan_flags(df, source_nodes(df)).head().security_flags) == (False, False, False)


def test_complexity_vector(nodes):
    wanted = nodes.filter("doc_id IN ('highest', 'roots', 'broken')")
    got = {r.doc_id: r.complexity for r in features.complexity_vector(wanted).collect()}
    assert set(got) == {"highest", "roots"}
    assert all(len(v) == 32 for v in got.values())
    c = got["highest"]
    assert c[:4] == [1, 0, 1, 1] and c[6:8] == [4, 4]
    # ranks 0.108611, 0.083660, 0.108611 and 0.083660: node 3 gives half to each of its two sources
    assert c[8] == pytest.approx(0.096135, abs=1e-6) and c[9] == pytest.approx(0.012475, abs=2e-6)
    assert got["roots"] == [0.0] * 32


def test_source_vectors(nodes):
    found = {r.doc_id: r.embedding for r in features.source_vectors(nodes, iterations=5).collect()}
    assert set(found) == set(SOURCES) - {"broken", "nul"}
    assert all(len(v) == 1408 for v in found.values())
    # the same text gives the same vector, whoever computes it
    again = {r.doc_id: r.embedding for r in features.source_vectors(nodes.filter("doc_id = 'highest'"), iterations=5).collect()}
    assert again["highest"] == pytest.approx(found["highest"])
