"""Toxicity, language-model scores, the address filter and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lm_scoring, toxicity, url_filter
from tidemark.llm.catalog import QUERIES


def english_costs():
    words = "idiot moron clown pathetic stupid loser trash worthless disgusting the and of to in is that it for was on with"
    table, counts = toxicity._classes(), Counter()
    for word in words.split() * 50:
        c = table[np.frombuffer(f"  {word} ".encode(), np.uint8)]
        counts.update((c[:-2] * 729 + c[1:-1] * 27 + c[2:]).tolist())
    return toxicity.trigram_costs(counts)


@pytest.mark.parametrize(
    "written, meant",
    [("1d10t", "idiot"), ("p@th3t1c", "pathetic"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("cl0wnnnn", "clown"),
     ("iiidiiiooot", "idiot"), ("l0ser!!", "loser"), ("tr@sh###", "trash"), ("The,", "the"), ("w0rthl3ss", "worthless")],
)
def test_restores(written, meant):
    assert toxicity.Restorer(english_costs()).chunk(written) == (meant,)


def test_restores_spaced_letters():
    restorer = toxicity.Restorer(english_costs())
    assert restorer.words("you i d i o t and s t u p 1 d") == ["you", "and", "idiot", "stupid"]
    assert restorer.words("") == [] and restorer.words("12 345 --- 6 7 8") == []


def prose_costs():
    words = "an ass is such a stupid fool you idiot and a sit as this idiot said that was a good day for us all in it you and i"
    table, counts = toxicity._classes(), Counter()
    c = table[np.frombuffer(f"  {words * 50} ".replace("  ", " ").encode(), np.uint8)]
    counts.update((c[:-2] * 729 + c[1:-1] * 27 + c[2:]).tolist())
    return toxicity.trigram_costs(counts)


@pytest.mark.parametrize(
    "written, meant",
    [("a$$", "ass"), ("@$$", "ass"), ("!d!0t", "idiot"), ("@55", "ass"), ("$1+", "sit"), ("idiot!", "idiot"), ("(idiot)", "idiot")],
)
def test_restores_signs_at_edges(written, meant):
    assert toxicity.Restorer(prose_costs()).chunk(written) == (meant,)


def test_restores_words_in_spaced_runs():
    restorer = toxicity.Restorer(prose_costs())
    assert restorer.words("such a s t u p i d fool") == ["such", "fool", "a", "stupid"]
    assert restorer.words("y o u i d i o t") == ["you", "idiot"]
    assert restorer.words("s\tt\tu\tp\ti\td") == ["stupid"] and restorer.words("y o u  i d i o t") == ["you", "idiot"]


def toxic_table(spark):
    rows, labels = [], []
    for k in range(1200):
        bad = k % 6 == 0
        words = [f"w{k * 7 % 50}x", "the", "and", "of", chr(97 + k % 26) * 2 + "word"]
        words[1:1] = ["1d10t", "clown"] if bad and k % 4 == 2 else ["idiot", "clown"] if bad else []
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(None, None), (5000, ""), (5001, "idiot clown " * 30_000), (5002, "nice " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("evidence", F.lit("x")).withColumn("_row", F.lit(1))
    return docs, spark.createDataFrame([*labels, (None, 1), (5000, None), (3, 0)], "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == docs.count()
    for k in range(1200):
        assert rows[k].predicted == int(k % 6 == 0) and 0 <= rows[k].score <= 1
        assert rows[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert [rows[k].predicted for k in (None, 5000, 5001, 5002)] == [0, 0, 1, 0]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows.values() if not r.predicted}
    restored = toxicity.restore(docs.where("doc_id = 6"), model.costs).head()
    assert restored.restored.startswith("w42x") is False and "clown" in restored.restored


def test_toxicity_never_sees_held_out_labels(spark):
    docs, labels = toxic_table(spark)
    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out_remainder(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert one.weights == two.weights and (one.intercept, one.slope) == (two.intercept, two.slope)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels.where("1 = 0"))
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0
    empty = docs.where("1 = 0")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op2_toxicity"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    found = sum(r.predicted and r.toxic for r in rows)
    assert found >= 0.6 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows) <= found + 2


def log_gamma(x):
    return math.lgamma(x)


class PlainTrees:
    """The same model from plain dictionaries."""

    def __init__(self, counts):
        depth = lm_scoring.DEPTH
        self.bits = defaultdict(lambda: [0, 0])
        for word, n in counts.items():
            for context, byte in self.coded(word):
                node = 1
                for k in range(7, -1, -1):
                    bit = byte >> k & 1
                    for d in range(depth + 1):
                        self.bits[context[depth - d :], node][bit] += n
                    node = 2 * node + bit
        weighted, below, self.own = {}, defaultdict(float), {}
        for (context, node), (a, b) in sorted(self.bits.items(), key=lambda item: -len(item[0][0])):
            block = log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)
            if len(context) == depth:
                value, self.own[context, node] = block, 1.0
            else:
                other = below[context, node]
                value = max(block, other) + math.log1p(math.exp(-abs(block - other))) - math.log(2)
                self.own[context, node] = 1 / (1 + math.exp(min(700, other - block)))
            weighted[context, node] = value
            below[context[1:], node] += value if context else 0

    @staticmethod
    def coded(word):
        text = bytes(lm_scoring.DEPTH) + (word if word == b"\n" else word + b" ")
        return [(text[k - lm_scoring.DEPTH : k], text[k]) for k in range(lm_scoring.DEPTH, len(text))]

    def log10(self, word):
        depth, total = lm_scoring.DEPTH, 0.0
        for context, byte in self.coded(word):
            node = 1
            for k in range(7, -1, -1):
                done, left, chance = 0.0, 1.0, 0.5
                for d in range(depth + 1):
                    seen = self.bits.get((context[depth - d :], node))
                    if seen is None:
                        break
                    kt = (seen[1] + 0.5) / (sum(seen) + 1)
                    chance = done + left * kt
                    own = self.own[context[depth - d :], node]
                    done, left = done + left * own * kt, left * (1 - own)
                bit = byte >> k & 1
                total += math.log10(chance if bit else 1 - chance)
                node = 2 * node + bit
        return total


def check_scores(df, rows):
    docs = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    counts, held = Counter(), {}
    for i, text in docs:
        held[i] = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        if not held[i]:
            counts.update([*text.encode().lower().split(), b"\n"])
    n, v, trees = sum(counts.values()), len(counts), PlainTrees(counts)
    known = {}
    want = defaultdict(list)
    for i, text in docs:
        words = [*text.encode().lower().split(), b"\n"]
        for w in words:
            if w not in known:
                known[w] = trees.log10(w)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[i].append((held[i], len(words), sum(counts[w] > 0 for w in words), n, base, sum(known[w] for w in words)))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for i in want:
        for one, two in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert one == pytest.approx(two, rel=1e-6)


def fold(column):
    return F.crc32(column.cast("string").cast("binary")) % 7 == 2


def test_scores_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH_CHARS", 300)
    check_scores(odd, lm_scoring.score(odd, fold(F.col("doc_id"))).collect())
    assert lm_scoring.score(none, fold(F.col("doc_id"))).count() == 0
    nothing = lm_scoring.score(odd, F.lit(True)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.score < 0 for r in nothing)


def test_score_query(spark, sf_dir):
    rows = QUERIES["op9_lm_scoring"](spark, sf_dir).collect()
    check_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), rows)


class RunningTrees(PlainTrees):
    """The plain model over running texts: contexts reach over spaces and words."""

    @staticmethod
    def coded(words):
        text = bytes(lm_scoring.DEPTH) + b" ".join(words)
        return [(text[k - lm_scoring.DEPTH : k], text[k]) for k in range(lm_scoring.DEPTH, len(text))]


@pytest.mark.parametrize("sizes", [{}, {"BATCH_CHARS": 90, "CHUNK_BYTES": 40, "PIECE_GRAMS": 10}])
def test_running_text_is_scored_over_spaces(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lm_scoring, name, value)
    texts = [
        "the cat sat on the mat", "The cat  sat on\nthe hat", "", None, " ", "mat the on sat cat the", "x\x00\x00y \x00\x00\x00\x00\x00\x00\x00\x00 b",
        "Größe 中文 \U0001f600 naïve", "the cat sat on the mat", "a b c d e f g h", "longerthansevenbytes longerthansevenbytes",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, "the cat"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = lm_scoring.score(df, F.col("doc_id").isin(1, 5, 7)).collect()
    coded = [(r.doc_id, (*(r.text or "").encode().lower().split(), b"\n")) for r in df.collect()]
    trees = RunningTrees(Counter(words for i, words in coded if i not in (1, 5, 7)))
    want = sorted((i is None, i, trees.log10(words)) for i, words in coded)
    found = sorted((r.doc_id is None, r.doc_id, r.running_score) for r in got)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], rel=1e-9)
    # the same words in another order are another text
    one, two = (next(r for r in got if r.doc_id == i) for i in (0, 5))
    assert one.score == pytest.approx(two.score) and one.running_score > two.running_score + 1


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    return {r.page_id: r for r in url_filter.judge(df, url_filter.fit(spark)).collect()}


def test_rules_and_parts(spark):
    rows = judged(spark, [
        "http://A.Example.COM/en/x?q=1", "https://www.example.com/en/1", "https://x.www.example.com/en/", "ftp://com/de",
        "http://notcom/en/", "https://b.net/es/1", "https://net/fr/", "https://b.net/de/1", "no scheme", None, "",
        "a://b://c/d", "https://Ünï.com/É#x", "https://example.com/en", "http://h?x/y", "x\n://k.com/p\nq#r",
    ])
    parts = [(r.host, r.path, r.rule) for _, r in sorted(rows.items())]
    assert parts == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"),
        ("x.www.example.com", "/en/", "www.example.com/en/"), ("com", "/de", "com/"), ("notcom", "/en/", None),
        ("b.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("b.net", "/de/1", None), ("", "", None), ("", "", None),
        ("", "", None), ("b:", "//c/d", None), ("Ünï.com", "/É", "com/"), ("example.com", "/en", "com/"), ("h", "", None),
        ("k.com", "/p\nq", "com/"),
    ]
    verdicts = {rows[k].verdict for k in (0, 5, 6)}, {rows[k].verdict for k in (1, 2, 3, 12, 13, 15)}
    assert verdicts == ({"block"}, {"allow"})


def test_labelled_names_are_not_sites_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(url_filter.host(F.col("url")).alias("host"))
    labels = {label for r in pages.distinct().collect() for label in r.host.split(".")}
    assert not labels & {*url_filter.BLOCKED_NAMES, *url_filter.ALLOWED_NAMES}


def test_regression_on_fitted_and_unseen_names(spark):
    # every other name is fitted; the rest shows how the verdict does on new names
    halves = [(url_filter.BLOCKED_NAMES[k::2], url_filter.ALLOWED_NAMES[k::2]) for k in (0, 1)]
    model = url_filter.fit(spark, url_filter.labelled_table(*halves[0]))
    right = []
    for half in halves:
        rows = [(label, url) for url, label in url_filter.labelled_table(*half)]
        df = spark.createDataFrame(rows, "page_id int, url string")
        counts = Counter((r.page_id, r.verdict) for r in url_filter.judge(df, model, rules=()).collect())
        blocked, allowed = counts[1, "block"], counts[0, "allow"]
        right.append((blocked / (blocked + counts[1, "allow"]), allowed / (allowed + counts[0, "block"])))
    assert min(right[0]) > 0.98
    # measured: 132 of 216 and 229 of 289
    assert right[1][0] > 0.6 and right[1][1] > 0.7


def test_probability_by_hand(spark, sf_dir):
    model = url_filter.fit(spark)
    for r in url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).collect():
        grams = set()
        for tag, text in (("h", f"^{r.host}$"), ("p", f"/{r.path}$")):
            for size in url_filter.SIZES:
                grams |= {tag + text[at : at + size] for at in range(max(1, len(text) - size + 1))}
        slots = {xxhash.xxh64_intdigest(g.encode(), seed=42) % url_filter.BUCKETS for g in grams}
        z = model.intercept + sum(model.weights[k] for k in slots) / math.sqrt(len(slots))
        assert r.probability == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if r.probability >= 0.5 else "allow")


def test_address_query_is_native(spark, sf_dir):
    df = QUERIES["op10_url_filter"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    docs = stages["toxicity"](spark, docs, sf_dir).cache()
    assert docs.columns == before.columns
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - toxic
    groups = exact_dedup.duplicate_groups(docs).where("kept").collect()
    docs = stages["exact_dedup"](spark, docs, sf_dir).cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in groups)
    from test_copies import least_ids

    best = {c for _, n, c in least_ids([(r.doc_id, r.text) for r in docs.collect()])}
    docs = stages["ngram_join"](spark, docs, sf_dir).cache()
    assert docs.columns == before.columns and {r.doc_id for r in docs.collect()} == best
    packed = stages["packing"](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == best
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == sorted(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect()
    )


def test_score_learns_from_seven_bytes(spark):
    # "c" or "d" after "xbbbbbb": only the seventh byte back tells which one
    rows = [(k, "xbbbbbbc ybbbbbbd " * 40) for k in range(8)] + [(100, "xbbbbbbc"), (101, "xbbbbbbd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm_scoring.score(df, F.col("doc_id") >= 100).collect()}
    assert found[100] > found[101] + 1.5


def test_score_moves_no_texts(spark, odd, monkeypatch):
    kept = []

    def keep(df, name, codec=None):
        kept.append((name, df.columns))
        return df.localCheckpoint()

    monkeypatch.setattr(lm_scoring, "stored", keep)
    found = lm_scoring.score(odd, fold(F.col("doc_id")))
    assert kept and not [name for name, columns in kept if "text" in columns]
    shuffled = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "text" in x]
    assert not shuffled
    check_scores(odd, found.collect())


def test_score_finds_decisions_by_place(spark):
    grams = spark.createDataFrame([(97, 3), (97 << 8 | 98, 2), (98 << 8 | 32, 2)], "gram long, n long")
    for table in lm_scoring.build(grams):
        assert table.schema["nodes"].dataType.typeName() == "array"
        assert {len(r.nodes) for r in table.collect()} == {256}
        # the first decision of a byte is node 1
        assert all(r.nodes[0] is None and r.nodes[1] is not None for r in table.collect())


def test_score_in_many_batches_and_with_large_texts(spark, monkeypatch):
    # batches that end inside an Arrow batch, and more tokens than a batch holds at once
    rows = [(k, " ".join(f"w{j % (k + 2)}" for j in range(30 * k))) for k in range(1, 40)] + [(None, "w1 w2"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for chars in (200, 1_000):
        monkeypatch.setattr(lm_scoring, "BATCH_CHARS", chars)
        check_scores(df, lm_scoring.score(df, fold(F.col("doc_id"))).collect())
