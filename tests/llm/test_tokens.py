"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing, token_counts
from tidemark.llm.catalog import QUERIES
from tidemark.llm.word_tokens import WordCounts, WordTokens, whole_words

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def by_ranks():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts():
    rng = random.Random(8)
    parts = [*"abcXYZ  \n\t.,!'0129éßÀñ¼²µ\xa0\x85\x1c\x1f\xad<|>́ 中文😀İΣσςﬁªº½", "'s", "'re", "<|endoftext|>", "  ", "the "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]


def test_words_equal_the_library(library):
    tokens, counts = WordTokens(WORDS), WordCounts(WORDS, whole_words(WORDS))
    for text in some_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", tokens.ids(text))) == ids and counts.count(text) == len(ids), repr(text)


def test_bytes_equal_the_ranks(by_ranks):
    tokens = byte_bpe.ByteTokens(RANKS, public_tokenizers.PATTERN)
    for text in some_texts():
        assert list(array("i", tokens.ids(text))) == by_ranks.encode_ordinary(text), repr(text)


def test_counts(odd, none, library):
    for r in token_counts.count_tokens(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS).collect():
        text = next(x["text"] for x in odd.where(f"doc_id = {r.doc_id}").collect()) or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.count_tokens(odd, WORDS).count() == odd.count()
    assert token_counts.count_tokens(none, WORDS).count() == 0


def test_encode_and_decode(odd, none, by_ranks):
    encoded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN, offsets=True)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    texts = sorted((x["text"] or "" for x in odd.collect()))
    assert sorted(r.decoded.decode() for r in rows) == texts
    for r in rows:
        assert r.ids == by_ranks.encode_ordinary(r.decoded.decode())
        assert r.ends == [len(by_ranks.decode_bytes(r.ids[: k + 1])) for k in range(len(r.ids))] if len(r.ids) < 500 else True
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_queries(spark, sf_dir, library, by_ranks):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op4_token_counts"](spark, sf_dir).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
    for r in QUERIES["op5_byte_bpe"](spark, sf_dir).collect():
        ids = by_ranks.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def packed_right(rows, texts, library, capacity=4096):
    places, lengths = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r.start == r.piece * capacity and 0 < r.length <= capacity
        places[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(array("I", ids).tobytes()) == r.ids_crc32
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return places, sum(lengths.values())


def test_packing(spark, odd, none, library):
    one_each = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in one_each.collect()}
    places, total = packed_right(packing.pack(one_each, WORDS).collect(), texts, library)
    assert len(places) == -(-total // 4096)
    assert packing.pack(odd, WORDS).groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    assert packing.pack(none, WORDS).count() == 0


def test_packing_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    places, total = packed_right(QUERIES["op6_packing"](spark, sf_dir).collect(), texts, library)
    assert len(places) <= 1.01 * total / 4096 + 1


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_plan_uses_as_many_bins_as_best_fit_by_piece():
    rng = random.Random(2)
    for capacity in (1, 7, 50, 200):
        for _ in range(20):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
            histogram = defaultdict(int)
            for x in lengths:
                histogram[x] += 1
            plan, used = packing.plan_best_fit(histogram, capacity), defaultdict(set)
            for length, first, last, per_bin, bin_, offset in plan:
                for nth in range(last - first):
                    at = offset + nth % per_bin * length
                    places = set(range(at, at + length))
                    assert not places & used[bin_ + nth // per_bin] and max(places) < capacity
                    used[bin_ + nth // per_bin] |= places
            assert sum(map(len, used.values())) == sum(lengths)
            assert len(used) <= plain_best_fit(lengths, capacity)


def test_plan_size_follows_lengths_not_documents():
    histogram = {k: 1_000_000_007 + k * k for k in range(1, 4097)}
    assert len(packing.plan_best_fit(histogram, 4096)) < 40_000
