"""Edit scripts against a plain table of common lengths, and their application."""

import random

import pytest

from tidemark.catalog.reports import document_versions
from tidemark.operators import hunks, snapshots


def longest(a, b):
    """Length of the longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]


@pytest.mark.parametrize("letters", [1, 2, 4, 30])
def test_script_is_shortest(letters):
    rng = random.Random(letters)
    for _ in range(120):
        a = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        b = [rng.randrange(letters + 1) for _ in range(rng.randrange(40))]
        kept = hunks.kept_lines(a, b)
        assert all(a[i] == b[j] for i, j in kept)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:]))
        assert len(kept) == longest(a, b)


def test_long_texts():
    rng = random.Random(9)
    a = [f"line {rng.randrange(3000)}" if rng.random() < 0.8 else "" for _ in range(12_000)]
    b = [line if rng.random() > 0.02 else f"new {rng.random()}" for line in a if rng.random() > 0.01]
    b[2000:2000], b[7000:7400] = b[5000:5200], []
    kept = hunks.kept_lines(a, b)
    assert len(kept) > 11_000 and all(a[i] == b[j] for i, j in kept)
    script = [(r[1], r[4], r[5]) for r in hunks.hunks_of("\n".join(a), "\n".join(b))]
    assert hunks.patched("\n".join(a), script) == "\n".join(b)


@pytest.mark.parametrize("old, new", [("a\nb\nc", "a\nx\nc\n"), ("", "\n"), (None, ""), ("", None), (None, "a\n\nb"), ("a\na\na", "a"), ("é\r\n", "é\n"), ("x", "x")])
def test_patch_gives_the_new_text(old, new):
    found = list(hunks.hunks_of(old, new))
    assert hunks.patched(old, [(r[1], r[4], r[5]) for r in found]) == new
    assert bool(found) == (old != new)


def test_places():
    found = list(hunks.hunks_of("a\nb\nc\nd\ne", "a\nB\nc\ne\nf"))
    assert found == [(0, 2, 2, 0, "-", "b"), (0, 2, 2, 1, "+", "B"), (1, 4, 4, 0, "-", "d"), (2, 6, 5, 0, "+", "f")]
    with pytest.raises(ValueError):
        hunks.patched("a\nb", [(1, "-", "x")])


VERSIONS = {
    "a.py": ("x\ny", "x\nz"), "b.py": ("same", "same"), "c.py": (None, "new\n"), "d.py": ("gone", None), "e.txt": ("x", "y"),
    "f.py": ("", "\n"), "g.py": ("was", ...), "h.py": (..., ""), "i.py": (None, None), "j.py": (None, ...),
}


def versions(spark):
    def one(side):
        rows = [(p, v[side], 1) for p, v in VERSIONS.items() if v[side] is not ...]
        return spark.createDataFrame(rows, "path string, text string, line int")

    return one(0), one(1)


def test_tables(spark):
    base, target = versions(spark)
    changed = {r.path: r.change_type for r in hunks.changed_paths(base, target, "path", "text", ".py").collect()}
    assert changed == {"a.py": "modified", "c.py": "added", "d.py": "removed", "f.py": "modified", "g.py": "removed", "h.py": "added"}
    found = hunks.line_hunks(base, target, "path", "text")
    again = {r.path: r.text for r in hunks.apply_hunks(base, found, "path", "text").collect()}
    assert again == {p: (None if VERSIONS[p][1] is ... else VERSIONS[p][1]) for p in changed}
    diff = {r.path: (r.change_type, r.new_content) for r in snapshots.snapshot_diff(base, target, "path", "text").collect()}
    assert diff == {p: (kind, again[p]) for p, kind in changed.items()}
    empty = base.limit(0)
    assert hunks.line_hunks(empty, empty, "path", "text").count() == 0
    assert hunks.line_hunks(base, base, "path", "text").count() == 0


def test_unchanged_texts_stay(spark, sf_dir, monkeypatch):
    """The filter before the join lets only changed paths pass, but for clashes of the bitmap."""
    base, target = document_versions(spark, sf_dir)
    changes = hunks.changed_paths(base, target, "path", "text")
    kept = hunks.only_changed(target, changes, "path")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    wanted = {r.path for r in changes.filter("change_type != 'removed'").collect()}
    assert {r.path for r in kept.collect()} == wanted
    # a bitmap of one bit lets everything pass, and the join still decides
    monkeypatch.setattr(hunks, "BITMAP_BITS", 1)
    assert {r.path for r in hunks.only_changed(target, changes, "path").collect()} == wanted


@pytest.mark.parametrize("bits", [1 << 26, 1, 40_000])
def test_without(spark, monkeypatch, bits):
    monkeypatch.setattr(hunks, "BITMAP_BITS", bits)
    df = spark.range(300).selectExpr("if(id = 7, null, id) AS k", "id AS n")
    gone = spark.range(0, 900, 3).selectExpr("id AS k").unionByName(spark.sql("SELECT cast(null AS long) AS k"))
    assert {r.n for r in hunks.without(df, gone, "k").collect()} == {n for n in range(300) if n % 3} | {7}
    assert hunks.without(df, gone.limit(0), "k").count() == 300
    assert {r.n for r in hunks.only_changed(df, gone, "k").collect()} == set(range(0, 300, 3))
