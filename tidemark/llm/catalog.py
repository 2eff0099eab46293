"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, exact_dedup, fill_middle, fingerprints, lm_scoring, ngram_join, packing, sharding, simhash, token_counts, toxicity,
    url_filter, whitening,
)
from tidemark.llm.common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, threshold=0.3)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(documents(spark, sf_dir), vocabulary, capacity=4096, closing=1)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    # lists as text, so that every engine writes them alike
    written = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("changed_sections", "changed_paragraphs")]
    return found.select(*[c for c in found.columns if not c.startswith("changed_")], *written)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score(documents(spark, sf_dir), held_out)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(spark)
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_middle(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore("output", "form"), 256).alias("restored_sha256"),
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_fill_middle": op12_fill_middle,
    "op13_simhash": op13_simhash,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        best AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
            FROM normal WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               place = 1 AS kept, text_sha256
        FROM best
    """,
    "op7_fingerprints": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        pairs AS (
            SELECT *, coalesce(lead(body) OVER w, first_value(body) OVER w) AS following
            FROM texts WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
        edits AS (
            SELECT *, length(body) AS n_chars,
                   substr(body, 1, length(body) - length(body) // 3)
                   || substr(following, 1, length(body) // 3) AS edited FROM pairs),
        parts AS (
            SELECT *, LEAVES(body) AS a, LEAVES(edited) AS b, LEAVES(following) AS c,
                   LINES(body) AS lines, LINES(edited) AS edited_lines FROM edits),
        nodes AS (SELECT *, SECTIONS(lines) AS secs, SECTIONS(edited_lines) AS edited_secs FROM parts)
        SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
               sha256(array_to_string(secs, '')) AS fingerprint,
               sha256(array_to_string(edited_secs, '')) AS edited_fingerprint,
               NEAR(a, b) AS near_edited, NEAR(a, c) AS near_next,
               CHANGED(secs, edited_secs) AS changed_sections,
               CHANGED(lines, edited_lines) AS changed_paragraphs
        FROM nodes
    """,
    "op12_fill_middle": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        units AS (
            SELECT *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1,
                   ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM texts),
        cuts AS (
            SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
                   greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                   CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
        parts AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
                   coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM parts
    """,
}


def _expand(sql: str, name: str, body: str) -> str:
    """Replace ``name(x, y)`` by ``body`` with ``$1`` and ``$2`` filled in."""
    def fill(found: re.Match) -> str:
        out = body
        for k, part in enumerate(found[1].split(", "), 1):
            out = out.replace(f"${k}", part)
        return out

    return re.sub(rf"\b{name}\(([^()]*)\)", fill, sql)


for _name, _body in {
    "LEAVES": "list_transform(regexp_extract_all($1, '%s'), lambda x: ('0x' || md5(x)[1:15])::BIGINT)"
    % fingerprints.LEAF_PATTERN,
    "LINES": r"list_transform(string_split($1, chr(10)), lambda x: sha256(x))",
    "SECTIONS": f"list_transform(range((len($1) + {fingerprints.SECTION - 1}) // {fingerprints.SECTION}), "
    f"lambda k: sha256(array_to_string($1[k * {fingerprints.SECTION} + 1 : (k + 1) * {fingerprints.SECTION}], '')))",
    "NEAR": "CASE WHEN len($1) = 0 AND len($2) = 0 THEN 1.0::DOUBLE ELSE greatest("
    "len(list_filter(range(1, least(len($1), len($2)) + 1), lambda k: $1[k] = $2[k])) / greatest(len($1), len($2)), "
    "(2 * len(list_distinct(list_intersect($1, $2)))) / (len(list_distinct($1)) + len(list_distinct($2)))) END",
    "CHANGED": "array_to_string(list_transform(list_filter(range(1, greatest(len($1), len($2)) + 1), "
    "lambda k: $1[k] IS DISTINCT FROM $2[k]), lambda k: k - 1), ' ')",
}.items():
    SQL["op7_fingerprints"] = _expand(SQL["op7_fingerprints"], _name, _body)
