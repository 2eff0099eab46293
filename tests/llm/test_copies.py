"""Exact copies, near copies, fingerprints and shards against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import connect, differences

from tidemark.llm import exact_dedup, fingerprints, ngram_join, sharding
from tidemark.llm.catalog import QUERIES, SQL
from tidemark.llm.components import components


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("least", [2, 0])
def test_exact_groups(odd, monkeypatch, least):
    """With every digest taken for frequent, too."""
    if not least:
        every = lambda rows, column: rows.select(exact_dedup._short(column).alias("_short")).distinct()
        monkeypatch.setattr(exact_dedup, "frequent", every)
    rows = exact_dedup.duplicate_groups(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in texts:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    assert len(rows) == len(texts)
    for digest, members in groups.items():
        name = hashlib.sha256(digest.encode()).hexdigest()
        own = [r for r in rows if r.text_sha256 == name]
        best = min(members)
        assert [r.group_size for r in own] == [len(members)] * len(members)
        assert {r.keep_id for r in own} == {None if best[1] else best[2]}
        assert sum(r.kept for r in own) == 1
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(normal(r["text"]) for r in kept.collect()) == Counter(list(groups))


def test_exact_empty(none):
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def least_ids(docs):
    """Brute force: every pair is compared."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            common = len(one & two)
            if one and two and 100 * common >= 75 * (len(one) + len(two) - common):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[find(k)].append(i)
    return sorted(
        ((i, len(s), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)), key=repr
    )


def answer(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_near_components_of_odd_rows(odd, none):
    assert answer(ngram_join.near_components(odd)) == least_ids([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert ngram_join.near_components(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and 9 not in ids and 12 not in ids
    assert {3, 4, 5, 8, 11} <= set(ids)


@pytest.mark.parametrize("small", [4, 1])
def test_near_components_of_families(spark, monkeypatch, small):
    """Families around a base whose members often link through the base only, and a passage that all share."""
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    rng, docs = random.Random(3), []
    passage = [f"p{k}" for k in range(30)]
    for family in range(6):
        size = rng.choice([3, 5, 8, 12, 25, 60, 130])
        base = [f"f{family}x{k}" for k in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                words[rng.randrange(size)] = f"n{rng.random()}"
            docs.append(" ".join(words[: rng.randint(size * 9 // 10, size)]))
        docs += [" ".join([*passage, *(f"q{rng.random()}" for _ in range(rng.randint(5, 40)))]) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert answer(ngram_join.near_components(df)) == least_ids(list(enumerate(docs)))


@pytest.mark.parametrize("ids", ["xxhash64(doc_id, text)", "if(doc_id = 3, 1152921504606846976, doc_id)", "cast(null as long)", "if(doc_id < 7, -9223372036854775808 + doc_id, 9223372036854775807 - doc_id)"])
def test_fingerprints_of_wide_ids(odd, ids):
    """Ids over the whole range of longs, one far away, and none at all."""
    docs = odd.selectExpr(f"{ids} AS doc_id", "text")
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    expected = []
    for k, r in enumerate(rows):
        third = len(r.text) // 3
        edited = r.text[: len(r.text) - third] + rows[(k + 1) % len(rows)].text[:third]
        expected.append((r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest()))
    found = fingerprints.fingerprint_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(expected, key=repr)


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 102), (101, 102), (7, 7)]
    random.Random(1).shuffle(links)
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {found[k] for k in range(61)} == {0} and {found[k] for k in (100, 101, 102)} == {100}


def test_near_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(QUERIES["op3_ngram_join"](spark, sf_dir)) == least_ids(docs)


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.fingerprint_documents(odd).collect()
    order = sorted(((i is None, -(i or 0)), t or "") for i, t in ((r["doc_id"], r["text"]) for r in odd.collect()))
    assert len(rows) == len(order)
    assert fingerprints.fingerprint_documents(none).count() == 0
    by_text = defaultdict(set)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
        by_text[r.doc_id].add(r.fingerprint)
    assert by_text[0] == by_text[2] and by_text[3] == by_text[4] and by_text[0] != by_text[1]
    one = next(r for r in rows if r.doc_id == 14)
    text = dict((i, t) for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()])
    cut = len(text[14]) // 3
    edited = text[14][: len(text[14]) - cut] + text[13][:cut]
    assert one.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert one.changed_sections == [0] and one.changed_paragraphs[0] == 2


def test_neighbours_over_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 3)
    ids = [*range(0, 40), *range(1000, 1007), 10**12, -5, 2**40]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    keyed = df.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("_key"), "doc_id")
    found = fingerprints.with_next(keyed, keyed.select("_key"), {"doc_id": "next"}).collect()
    fall = sorted(ids, reverse=True)
    assert {r.doc_id: r.next for r in found} == dict(zip(fall, [*fall[1:], fall[0]]))
    assert len(found) == len(ids)


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_by_bytes(odd).collect()
    assert len(rows) == odd.count()
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    for r in rows:
        if r.doc_id == 14:
            text = "first line\n\nthird line; more, and more! end\n".encode()
            assert (r["size"], r.text_crc32) == (len(text) + 1, zlib.crc32(text))
    assert sharding.shard_by_bytes(none).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(5)
    docs = [f"d{k} " * rng.randint(5, 60) for k in range(1500)] + ["small group "] * 7 + ["a group of a third " * 3] * 900
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(df).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 8
    assert set(size) == set(range(8)) and all(abs(s - mean) <= 0.01 * mean for s in size.values())
    assert len({r.shard for r in rows if 1500 <= r.doc_id < 1507}) == 1


def test_shard_query(spark, sf_dir):
    rows = QUERIES["op8_sharding"](spark, sf_dir).collect()
    size, largest = Counter(), max(r["size"] for r in rows)
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) <= largest
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_long_sets_are_told_apart_without_their_texts(spark, monkeypatch):
    # 3,000 shingles: a sketch of 512 bits allows any pair; a third of the first two texts is common, nine tenths of the last two
    from tidemark.llm import ngram_join

    words = [[f"{name}{k}" for k in range(3_000)] for name in "xyz"]
    shared = words[0][:1_000]
    texts = [shared + words[1][1_000:], shared + words[2][1_000:], words[0], words[0][:2_850] + words[1][2_850:]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r.doc_id: r.key for r in ngram_join._sets(df, "doc_id", "text").collect()}
    held = ngram_join._zipped(ngram_join._texts(df, "doc_id", "text"))
    keys = spark.createDataFrame([*sets.items()], "doc_id long, key long")
    held = held.join(keys, "doc_id").select("key", "zipped")
    pairs = [tuple(sorted((sets[a], sets[b]))) for a in range(4) for b in range(a)]
    near = ngram_join._near(spark.createDataFrame(pairs, "a long, b long"), ngram_join._wide_sketches(held)).collect()
    assert {(r.a, r.b) for r in near} == {tuple(sorted((sets[2], sets[3])))}
    for name in ("MANY_PAIRS", "MANY_IN_GROUPS"):
        monkeypatch.setattr(ngram_join, name, 0)
    found = {r.doc_id: r.component_id for r in ngram_join.near_components(df).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 2}


def spoiled(rng, words, share):
    return [w if rng.random() > share else f"n{rng.random()}" for w in words]


def test_linked_sets_share_more_signatures_than_they_spare():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 5, 8, 13, 20, 33, 50, 70, 99, 100, 130, 200, 396, 640, 1500, 4000]:
        for _ in range(12):
            n = size + int(rng.integers(0, size // 3 + 1))
            pool = rng.integers(1, 1 << 63, 3 * n + 3, np.uint64) * np.uint64(2) + np.uint64(1)
            own, gone = int(rng.integers(0, n // 3 + 1)), 0
            while 100 * (n - gone - 1) >= 75 * (n + own):
                gone += 1
            one, two = pool[:n], np.concatenate([pool[gone:n], pool[n : n + own]])
            if 100 * (n - gone) < 75 * (n + own):
                continue
            common = np.intersect1d(ngram_join.signatures(one), ngram_join.signatures(two)).astype(np.uint64)
            shared = [int((common % np.uint64(2) == k).sum()) for k in (0, 1)]
            spares = [ngram_join.spare_signatures(one), ngram_join.spare_signatures(two)]
            # the instance that the bands of both have in common
            own_bands = [{j for j, _ in ngram_join.instances(len(x))} for x in (one, two)]
            both = own_bands[0] & own_bands[1]
            assert any(shared[j & 1] > max(s[j & 1] for s in spares) for j in both), (n, len(two))


def test_pairs_of_unlinked_families_are_left_out_in_blocks(spark, monkeypatch):
    """Members of a family share many signatures and are too far apart: none of their 780 pairs is formed as a row."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(2_000)]
    texts = [" ".join(spoiled(rng, base, 0.06)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = ngram_join._sets(df, "doc_id", "text").select("doc_id", "key").collect()
    members = [(sig, r.key, r.key) for r in sets for sig in range(r.doc_id % 3, 30, 3 if r.doc_id % 2 else 1)]
    members = spark.createDataFrame(members, "sig long, key long, label long")
    held = ngram_join._zipped(ngram_join._texts(df, "doc_id", "text"))
    held = held.join(spark.createDataFrame(sets), "doc_id").select("key", "zipped")
    for part, block in ((1_000, 50_000), (4, 30), (7, 50_000)):
        monkeypatch.setattr(ngram_join, "PART_MEMBERS", part)
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
        dealt = ngram_join._blocks(members).collect()
        met = defaultdict(list)
        for r in dealt:
            met[r.block, r.sig].append((r.side, r.key))
        pairs = {(s, *sorted((a, b))) for (_, s), m in met.items() for x, a in m for y, b in m if a < b and (x, y) in ((0, 0), (1, 2), (2, 1))}
        groups = defaultdict(set)
        for r in members.collect():
            groups[r.sig].add(r.key)
        assert pairs == {(s, a, b) for s, g in groups.items() for a in g for b in g if a < b}
        assert ngram_join._cross_pairs(members, ngram_join._wide_sketches(held)).count() == 0


@pytest.mark.parametrize("limits", [(1_000, 50_000), (3, 20), (2, 50_000)])
def test_families_without_leaders(spark, monkeypatch, limits):
    for name, value in (("PART_MEMBERS", limits[0]), ("BLOCK_ROWS", limits[1]), ("ROUNDS", 0), ("SMALL_GROUP", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, docs = random.Random(11), []
    for family in range(4):
        base = [f"f{family}x{k}" for k in range([30, 90, 150, 260][family])]
        docs += [" ".join(spoiled(rng, base, share)) for share in (0, 0.01, 0.02, 0.03, 0.05) for _ in range(7)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert answer(ngram_join.near_components(df)) == least_ids(list(enumerate(docs)))


def test_components_of_parts(spark, monkeypatch):
    """Forests of parts, then stars: the same as one part, whatever the parts are."""
    from tidemark.llm import components as module

    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    whole = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr(module, "PART_LINKS", 20)
    assert sorted(map(tuple, components(df).collect())) == whole
    labels = dict(whole)
    assert all(labels[a] == labels[b] for a, b in links if a != b) and {labels[k] for k in range(500, 561)} == {500}
    assert all(label <= node for node, label in whole) and len(labels) == len(whole)
