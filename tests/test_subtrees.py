"""Points in intervals by dyadic blocks, and trees, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.subtrees import subtree_pairs, tag_intervals
from tidemark.plans.ranges import dyadic_cover, join_in_range
from tidemark.sources.nodes import tag_nodes


def test_cover_is_the_interval(spark):
    rng = random.Random(1)
    cases = [(a, a + n - 1) for a in range(12) for n in range(14)]
    cases += [(a, a + rng.randrange(70_000)) for a in (rng.randrange(10**6) for _ in range(50))]
    df = spark.createDataFrame(cases, "a long, b long")
    for row in df.withColumn("c", dyadic_cover(F.col("a"), F.col("b"), 17)).collect():
        got = sorted(n for level, block in row.c for n in range(block << level, (block + 1) << level))
        assert got == list(range(row.a, row.b + 1))
        assert len(row.c) <= 2 * 18


def test_join_equals_brute_force(spark):
    rng = random.Random(2)
    keys = ["x", "y", None]
    points = [(rng.choice(keys), rng.randrange(300), k) for k in range(400)] + [("x", None, 400)]
    spans = [(rng.choice(keys), a, a + rng.choice([-1, 0, 1, 7, 250]), k) for k, a in enumerate(rng.randrange(300) for _ in range(120))]
    spans += [("x", None, 5, 120), ("x", 5, None, 121)]
    p = spark.createDataFrame(points, "g string, at int, p int")
    s = spark.createDataFrame(spans, "g string, lo int, hi int, s int")
    found = join_in_range(p, s, ["g"], "at", "lo", "hi")
    expected = sorted(
        (b[2], c[3]) for b in points for c in spans
        if b[0] == c[0] and b[1] is not None and c[1] is not None and c[2] is not None and c[1] <= b[1] <= c[2]
    )
    assert sorted((r.p, r.s) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert join_in_range(p, s.limit(0), ["g"], "at", "lo", "hi").count() == 0
    assert join_in_range(p.limit(0), s, ["g"], "at", "lo", "hi").count() == 0


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_trees(spark, shape):
    rng, parent = random.Random(3), [-1]
    for k in range(1, 150):
        # depth-first order: a new node hangs on the last one or on one of its ancestors
        above = [k - 1]
        while parent[above[-1]] >= 0:
            above.append(parent[above[-1]])
        parent.append(above[0] if shape == "chain" else rng.choice(above))
    end = list(range(150))
    for k in reversed(range(1, 150)):
        end[parent[k]] = max(end[parent[k]], end[k])
    df = spark.createDataFrame([(7, k, end[k]) for k in range(150)], "doc_id int, node_id int, dfs_end int")
    found = subtree_pairs(df, F.col("node_id") % 2 == 0, F.col("node_id") % 3 == 0)
    expected = set()
    for k in range(0, 150, 3):
        up = parent[k]
        while up >= 0:
            if up % 2 == 0:
                expected.add((up, k))
            up = parent[up]
    assert {(r.ancestor, r.descendant) for r in found.collect()} == expected


def test_tag_intervals(spark):
    html = "<html><body><div><p>x<br></div><div><ul><li>a</li></ul></div></body><b>"
    pages = spark.createDataFrame([(1, html), (2, "</div><div></div></div><i>"), (3, "")], "page_id int, html string")
    rows = tag_intervals(tag_nodes(pages, "page_id", "html"), "page_id").collect()
    got = {(r.page_id, r.ord): (r.tag, r.end) for r in rows}
    assert got == {
        (1, 0): ("html", 13), (1, 1): ("body", 11), (1, 2): ("div", 4), (1, 6): ("div", 10), (1, 7): ("ul", 9), (1, 8): ("li", 8),
        (1, 13): ("b", 13), (2, 1): ("div", 1), (2, 4): ("i", 4),
    }
