"""Encoding of a whole corpus with a byte-level BPE vocabulary.

The vocabulary (ranks of byte strings) is serialised, field by field, into a sentencepiece BPE
model: each byte string is mapped to printable characters, its score is the negated rank, and the
normaliser changes nothing. Pre-tokens are encoded once per worker and remembered; decoding maps
the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the public vocabulary's pattern for splitting text before the merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokens a worker remembers before it starts anew.
REMEMBERED = 1_000_000


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where it is one, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: an int as varint, a float as 32 bits, bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                word, rank = line.split()
                found[int(rank)] = base64.b64decode(word)
    return [found[i] for i in range(len(found))]


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the id after the last is the unknown piece."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in word).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, word in enumerate(ranks)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(n, 2**64 - 1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Encodes and decodes texts; ``encode(None)`` and ``encode("")`` are empty lists."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(path)))
        self.split = regex.compile(PRE_TOKEN).findall
        chars = byte_characters()
        self.map = {b: c for b, c in enumerate(chars)}
        self.back = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for t in (t for t in tokens if t not in self.known):
            self.known[t] = self.model.encode(t.encode("utf-8", "replace").decode("latin-1").translate(self.map))

    def _pre_tokens(self, tokens: list[str]) -> list[int]:
        try:
            return [i for t in tokens for i in self.known[t]]
        except KeyError:
            self._learn(set(tokens))
            return [i for t in tokens for i in self.known[t]]

    def encode(self, text: str | None) -> list[int]:
        """No pre-token crosses a space that precedes a character other than white space, so such words are looked up whole."""
        if not text:
            return []
        first, *rest = text.split(" ")
        if any(not w or w[0].isspace() for w in rest):
            return self._pre_tokens(self.split(text))
        ids = self._pre_tokens(self.split(first))
        words = self.words
        try:
            for w in rest:
                ids += words[w]
        except KeyError:
            if len(words) > REMEMBERED:
                words.clear()
            words.update((w, self._pre_tokens(self.split(" " + w))) for w in {*rest} if w not in words)
            return self._pre_tokens(self.split(first)) + [i for w in rest for i in words[w]]
        return ids

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row. Null and empty texts give an empty list, never null.

    Repeated rows stay repeated; other columns are not read; an empty table gives an empty one.
    Whole texts are encoded, without special tokens; marker-like strings are ordinary text.
    """
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat += enc.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
