"""Token counts by the whole-token shortcut.

Before the scan it is proven, with the library itself, which vocabulary strings
encode as one token when they stand alone (``word_tokens.whole_words``).  In the
tasks a word among them counts as one; only other words are merged.

Cases: a null or empty text has no bytes and no tokens; special strings inside a
text count as the library's default has it, one token each; long texts are
counted whole; an empty table gives an empty result; repeated rows repeat;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.word_tokens import WordCounts, per_worker, texts, whole_words


def count_tokens(
    df: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id n_bytes n_tokens over_limit``.  ``vocabulary`` is a path on every worker."""
    # at most the vocabulary's size, whatever the table's
    proven = df.sparkSession.sparkContext.broadcast(whole_words(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker(WordCounts, vocabulary, proven.value)
        for batch in batches:
            found = pa.array([counts.count(t) for t in texts(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_column)
    rows = df.select(
        F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
