"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library merges; its vocabulary is built from a file of ranks: a
byte stands as one visible character, and the merge of a token joins the two
parts that lower ranks leave of it.  Texts are split by a pattern first.  As no
match runs from a non-space over a single space, chunks between single spaces
can be encoded on their own; each worker keeps those it met lately.  A text with
two spaces side by side is split as a whole.

``encode`` gives ids and, if asked, the byte offset at which each token ends, so
tokens that hold a part of a character only can be placed.  ``decode`` reverses
the byte table over the joined bytes; characters split over tokens come out whole.

Cases: a null or empty text has no ids; strings of special tokens are plain text;
an empty table gives an empty result; repeated rows repeat; ``encode`` ignores
other columns.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.common import text_or_empty
from tidemark.llm.word_tokens import BYTE_TABLE, KEPT_CHUNKS, Recent, as_byte_characters, texts


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merges of a lower rank than the token's own leave of it."""
    limit, parts = ranks[token], [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[k] + parts[k + 1], limit), k) for k in range(len(parts) - 1))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def model_of(ranks: dict[bytes, int]):
    from tokenizers.models import BPE

    shown = {token: token.decode("latin-1").translate(BYTE_TABLE) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        parts = parts_of(token, ranks) if len(token) > 1 else []
        if len(parts) == 2:
            merges.append((shown[parts[0]], shown[parts[1]]))
    vocabulary = {shown[token]: rank for token, rank in ranks.items()}
    # a match that is a token is that token, whether or not merges reach it
    return BPE(vocab=vocabulary, merges=merges, ignore_merges=True)


class ByteTokens:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.model = model_of(ranks)
        self.matches = regex.compile(pattern).findall
        self.spaced = Recent(self._spaced)
        self.pieces = Recent(self._piece, KEPT_CHUNKS // 2)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def _piece(self, piece: str) -> bytes:
        return array("i", [t.id for t in self.model.tokenize(as_byte_characters(piece))]).tobytes()

    def _ids(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[piece] for piece in self.matches(text)])

    def _spaced(self, chunk: str) -> bytes:
        # letters alone are one match with the space before them
        return self._piece(" " + chunk) if chunk.isalpha() and chunk.isascii() else self._ids(" " + chunk)

    def ids(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if "  " in text:
            return self._ids(text)
        first, *rest = text.split(" ")
        spaced = self.spaced
        return self._ids(first) + b"".join([spaced[chunk] for chunk in rest])


_LOADED: dict[tuple[str, str], ByteTokens] = {}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def encode(
    df: DataFrame, ranks_path: str, pattern: str, offsets: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id ids``, and ``ends`` (byte offsets) if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern)
        if key not in _LOADED:
            _LOADED[key] = ByteTokens(*key)
        tokens = _LOADED[key]
        for batch in batches:
            found = [tokens.ids(t) for t in texts(batch.column(1))]
            ids = np.frombuffer(b"".join(found), "<i4")
            places = np.cumsum([0, *(len(f) // 4 for f in found)])
            bounds = pa.array(places, pa.int32())
            columns, names = [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(ids))], ["doc_id", "ids"]
            if offsets:
                ends = np.cumsum(tokens.sizes[ids])
                before = np.concatenate([[0], ends])[places[:-1]]
                ends = ends - np.repeat(before, np.diff(places))
                columns, names = [*columns, pa.ListArray.from_arrays(bounds, pa.array(ends))], [*names, "ends"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", ends array<long>" if offsets else ""))


def decode(df: DataFrame, ranks_path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes of the ids as column ``into``; a null list gives null.  ``into`` must not be a column yet."""
    if into in df.columns:
        raise ValueError(f"column {into} exists")
    place = df.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _TABLES:
            ranks = read_ranks(ranks_path)
            table = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            sizes = np.array([len(t) for t in table], np.int64)
            _TABLES[ranks_path] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes
        flat, first, sizes = _TABLES[ranks_path]
        for batch in batches:
            found = []
            for ids in batch.column(place):
                if not ids.is_valid:
                    found.append(None)
                    continue
                ids = ids.values.to_numpy(zero_copy_only=False)
                size = sizes[ids]
                ends = np.cumsum(size)
                # the place in the table of every byte
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[ids] - ends + size, size)
                found.append(flat[at].tobytes())
            columns = [*batch.columns, pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, BinaryType())]))
