"""The review of Python sources from end to end: text, vector, verdict, flags, stored row.

``vectorise`` parses every text once and gives its vector and flags.  ``review_sources`` scores the vectors in order against
the stored ones and those before, and ``store_rows`` makes the rows that go back into the store, with the verdict as JSON.
``source_drift`` compares two versions of changed sources, ``search_sources`` finds stored vectors near to a text.

A text that does not parse has no vector: its record has NULL metrics and all-false flags, it counts for no other
source and is not stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import wide_softmax_entropies
from tidemark.functions.hashing import random_projection
from tidemark.operators import features, patterns, profile, scoring, similarity, snapshots
from tidemark.operators.hunks import changed_paths, only_changed
from tidemark.plans.segments import DEFAULT_SPLIT, Split
from tidemark.plans.wide import vector_moments
from tidemark.session import joined_by_sort, stored
from tidemark.sources.nodes import source_nodes
from tidemark.sources.store import metadata_to_json

#: Values of a source's vector, and of the projection that is scored: a source that is part of its own profile is always
#: ``sqrt(n - 1)`` away while it has as many features as there are sources.
VECTOR_DIM = features.SYNTAX_DIM + features.DATAFLOW_DIM + features.INTENT_DIM + features.SYMBOL_DIM
SCORED_DIM = 16
#: Expected reliability before any outcome is known: 1 / (1 + 1).
FIRST_RELIABILITY = 0.5
METADATA = ["mahalanobis", "entropy", "z_score", "confidence", "security_flags"]


def vectorise(sources: DataFrame, *, patterns_of_secrets: dict[str, str] = patterns.SECRET_PATTERNS) -> DataFrame:
    """Add ``embedding`` (NULL where a text does not parse) and ``security_flags`` to ``source_id source ...``.

    Ids are unique.  Nodes are stored once; every part of the vector reads its columns of them.
    """
    texts = sources.select(F.col("source_id").alias("doc_id"), F.col("source").alias("text"))
    nodes = joined_by_sort(stored(source_nodes(texts), "source-nodes"))
    flags = patterns.scan_flags(texts, nodes, patterns_of_secrets)
    # the planes are projected behind all joins: rows that went through Python would be dealt anew
    planes = features.source_planes(nodes)
    found = joined_by_sort(planes).join(flags, ["doc_id"], "right").withColumnRenamed("doc_id", "_id")
    rows = sources.join(joined_by_sort(found), sources["source_id"] == found["_id"], "left").drop("_id")
    none = F.struct(*[F.lit(False).alias(name) for name in patterns.FLAGS])
    embedding, flagged = features.embedding().alias("embedding"), F.coalesce("security_flags", none).alias("security_flags")
    return rows.select(*sources.columns, embedding, flagged)


def scored_part(embedding: str, dim: int | None = SCORED_DIM) -> Column:
    """The projection of a vector that is scored; the whole vector without ``dim``."""
    return F.col(embedding) if dim is None else random_projection(VECTOR_DIM, dim, "review")(F.col(embedding))


def review_sources(
    vectorised: DataFrame,
    order_by: Sequence[str],
    *,
    keys: Sequence[str] = (),
    store: DataFrame | None = None,
    score_column: str = "embedding",
    dim: int | None = SCORED_DIM,
    row_id: str | None = None,
    split: Split = DEFAULT_SPLIT,
    **limits: float,
) -> DataFrame:
    """A record per source of ``vectorise``: its metrics and verdict, beside its flags and own columns.

    ``store`` holds stored vectors (``embedding``, and the keys): they come before all sources.  Entropies are those
    of the softmax of ``score_column``.  ``row_id`` names a column of a stored table that tells all its rows apart: then only what is
    scored is put in order, and the other columns that are asked for meet their verdict by it.
    """
    rows = vectorised.withColumn("_scored", scored_part("embedding", dim))
    if row_id is not None:
        entropies = wide_softmax_entropies(F.col(score_column).cast("array<double>"))
        rows = rows.withColumn("_entropies", entropies)
        rows = rows.select(*dict.fromkeys([row_id, *keys, *order_by]), "_scored", "_entropies")
        score_column = "_entropies"
    prior = None
    if store is not None:
        known = store.withColumn("_scored", scored_part("embedding", dim))
        prior = vector_moments(known, keys, "_scored", split=split)
    found = scoring.review_vectors(rows, keys, order_by, "_scored", score_column, prior=prior, split=split, **limits)
    if row_id is None:
        return found.drop("_scored")
    metrics = [c for c in found.columns if c not in rows.columns]
    found = joined_by_sort(found.select(F.col(row_id).alias("_row_of"), *metrics))
    return vectorised.join(found, vectorised[row_id] == found["_row_of"]).drop("_row_of")


def store_rows(reviewed: DataFrame, at: Column, *, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the vector table for reviewed sources that have a vector: id, vector, verdict as JSON, reliability, time."""
    rows = reviewed.filter(F.col("embedding").isNotNull()).select(
        F.col("source_id").cast("string").alias("vector_id"),
        "embedding",
        F.lit(FIRST_RELIABILITY).alias("reliability"),
        at.cast("timestamp").alias("timestamp"),
        *keep,
        F.col("mahalanobis_distance").alias("mahalanobis"),
        "entropy",
        "z_score",
        "confidence",
        "security_flags",
    )
    packed = metadata_to_json(rows, METADATA)
    return packed.select("vector_id", "embedding", "metadata", "reliability", "timestamp", *keep)


def source_drift(
    base: DataFrame,
    target: DataFrame,
    path: str,
    text: str,
    *,
    suffix: str = ".py",
    ratio: float = snapshots.DRIFT_RATIO,
    dim: int = SCORED_DIM,
) -> DataFrame:
    """``path base_distance new_distance drift_detected`` of the changed paths that parse in both versions.

    Both versions are measured against the profile of all vectors of the base.
    """
    kept = base.filter(F.col(path).endswith(suffix)).select(path, text)
    changes = stored(changed_paths(kept, target, path, text, suffix), "changes")

    def vectors(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(path).alias("source_id"), F.col(text).alias("source"))
        found = vectorise(rows).withColumn("scored", scored_part("embedding", dim))
        return found.filter("scored is not null").select(F.col("source_id").alias(path), "scored")

    old = stored(vectors(kept), "base-vectors")
    fitted = profile.fit_profile(old, "scored")

    def far(rows: DataFrame) -> DataFrame:
        return profile.score_profile(rows, "scored", fitted).select(path, "mahalanobis_distance")

    new = vectors(only_changed(target.select(path, text), changes, path))
    before = only_changed(old, changes, path)
    return snapshots.drift(far(before), far(new), [path], "mahalanobis_distance", ratio=ratio)


def search_sources(
    store: DataFrame, queries: DataFrame, k: int = 5, **sizes: int
) -> DataFrame:
    """``source_id vector_id similarity rank``: the stored vectors nearest to each text of ``source_id source``."""
    asked = vectorise(queries).select("source_id", "embedding")
    return similarity.similarity_search(
        store, asked, id_column="vector_id", vector="embedding", query_id="source_id", query_vector="embedding", k=k, **sizes
    )
