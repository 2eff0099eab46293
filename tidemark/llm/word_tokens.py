"""Token ids of texts under a public BPE vocabulary with word ends, for use inside tasks.

White space is dropped by that tokenizer and never merged over, so the ids of a
text are the ids of its white-space separated chunks one after the other.
Chunks repeat; each worker keeps those it met lately.  A chunk of plain letters,
digits and signs below U+0100 is split by the tokenizer's own pattern and given
to the library's merge model; any other chunk, and a text with separator
controls, which Python and the library see differently, goes through the whole
library.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import regex

#: Chunks kept per worker, twice over; longer chunks are not kept.
KEPT_CHUNKS = 400_000
KEPT_LENGTH = 48

# Fixed value: the pre-tokenizer's pattern in the vocabulary file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
END = "</w>"


class Recent(dict):
    """A mapping that makes missing values and keeps those used lately, in two generations."""

    def __init__(self, make: Callable, room: int = KEPT_CHUNKS, longest: int = KEPT_LENGTH):
        self.make, self.room, self.longest, self.older = make, room, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


BYTE_TABLE = {b: c for b, c in enumerate(byte_characters())}


def as_byte_characters(piece: str) -> str:
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_TABLE)


def load(path: str):
    """The library's tokenizer without truncation and padding, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def lowered(text: str) -> str:
    """The text in lower case where that is certain to be what the library does: fewer different chunks."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def whole_words(path: str) -> frozenset[str]:
    """Vocabulary strings that, as a word of their own, are proven to be one token: themselves."""
    tokenizer = load(path)
    model = tokenizer.model
    proven = []
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        word = entry.removesuffix(END)
        if word and word != entry and [t.id for t in model.tokenize(word)] == [number]:
            proven.append(word)
    return frozenset(proven)


class WordTokens:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.recent = Recent(self._chunk)
        self.words = Recent(self._word, KEPT_CHUNKS // 2)

    def pieces(self, chunk: str) -> list[str] | None:
        """The byte-character words of a plain chunk; None when the library has to see the chunk."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk.isprintable() and "<|" not in chunk:
                return SPLIT.findall(chunk.lower())
        elif chunk.isprintable() and max(chunk) < "Ā" and "<|" not in chunk:
            return [as_byte_characters(p) for p in SPLIT.findall(chunk.lower())]
        return None

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isalpha() and chunk.isascii():
            return words[chunk.lower()]
        found = self.pieces(chunk)
        if found is None:
            return array("I", self._library(chunk)).tobytes()
        return b"".join([words[word] for word in found])

    def ids(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers."""
        if any(c in text for c in SEPARATORS):
            return array("I", self._library(text)).tobytes()
        recent = self.recent
        return b"".join([recent[chunk] for chunk in lowered(text).split()])


class WordCounts(WordTokens):
    """Counts tokens: words proven to be one token count directly, only the rest is merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(path)
        self.whole = whole

    def _word(self, word: str) -> int:
        return len(self.model.tokenize(word))

    def _chunk(self, chunk: str) -> int:
        found = self.pieces(chunk)
        if found is None:
            return len(self._library(chunk))
        whole, words = self.whole, self.words
        return sum([1 if word in whole else words[word] for word in found])

    def count(self, text: str) -> int:
        if any(c in text for c in SEPARATORS):
            return len(self._library(text))
        recent = self.recent
        return sum([recent[chunk] for chunk in lowered(text).split()])


_LOADED: dict[tuple, WordTokens] = {}


def per_worker(kind: type, *args) -> WordTokens:
    """One instance per Python worker, so that later tasks find its recent chunks."""
    key = (kind, args[0])
    if key not in _LOADED:
        _LOADED[key] = kind(*args)
    return _LOADED[key]


def texts(column) -> Iterator[str]:
    """The texts of an Arrow column one by one; null as empty."""
    for value in column:
        yield value.as_py() or ""
