"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from a vocabulary.

The rank file holds byte strings and ranks. Every byte is mapped to one printable character, every piece is scored by its
negative rank, and the model gets identity normalisation; sentencepiece then joins, again and again, the adjacent pair whose
union has the lowest rank (the leftmost of equals), which is what the rank file means. Text is first cut by the vocabulary's
pre-token pattern, so no merge crosses a pre-token. Decoding maps ids back to characters and those to bytes.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmerge.llm.common import over_batches, texts_of

#: A space between two characters that no definition of white space contains: no pre-token reaches across it.
_GAP = re.compile(r"(?<=\S) (?=\S)")


class Chunks(dict):
    """chunk -> what `encode` makes of it, as bytes; at most `limit` chunks are remembered.

    A text is cut at single spaces between other characters, the space staying with what follows it. No pre-token crosses
    such a cut, so chunks are encoded one by one and the common ones only once a worker.
    """

    class Irregular(Exception):
        pass

    def __init__(self, encode: Callable[[str], bytes], limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest, self.heads = encode, limit, longest, {}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Chunks.Irregular
        found = self.encode(" " + word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found

    def _head(self, word: str) -> bytes:
        if (found := self.heads.get(word)) is None:
            found = self.encode(word)
            if len(word) <= self.longest and len(self.heads) < self.limit // 8:
                self.heads[word] = found
        return found

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        head = words[0]
        if head and not head[-1].isspace():
            words[0] = ""
            try:
                return self._head(head) + b"".join(map(self.__getitem__, words[1:]))
            except Chunks.Irregular:
                pass
        words = _GAP.split(text)
        return self._head(words[0]) + b"".join([self[w] if not w[-1].isspace() else self.encode(" " + w) for w in words[1:]])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next free one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol buffer field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; the id after the last is the unknown piece that it must have.

    Fixed values (sentencepiece's public model format): pieces 1 (piece 1, score 2, type 3: normal 1, unknown 2);
    trainer 2 (model type 3: BPE 2; size 4; unknown, begin, end, padding ids 40 to 43); normaliser 3 (name 1, dummy prefix 3,
    extra white space 4, escaped white space 5).
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    letters = byte_letters()
    pieces = []
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        mapped = "".join(letters[b] for b in piece).encode()
        pieces.append(_field(1, _field(1, mapped) + _field(2, -float(rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, -float(len(ranks))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """encode() and decode() with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        back = {x: b for b, x in self.letters.items()}
        self.pieces = [bytes(back[x] for x in self.model.id_to_piece(i)) for i in range(len(ranks))]
        # A pre-token that is a piece as a whole is that piece, even one that no chain of merges reaches.
        mapped = [self._mapped(p) for p in self.pieces]
        self.whole = {m: i for i, (m, ids) in enumerate(zip(mapped, self.model.encode(mapped, num_threads=1), strict=True)) if ids != [i]}
        self.chunks = Chunks(self._chunk)

    def _mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.letters)

    def _ids(self, token: str, found: list[int]) -> list[int]:
        return [self.whole[token]] if token in self.whole else found

    def _chunk(self, text: str) -> bytes:
        tokens = [self._mapped(x.encode()) for x in self.split(text)]
        return np.array([i for t in tokens for i in self._ids(t, self.model.encode(t))], "<i4").tobytes()

    def _learn(self, texts: list[str]) -> None:
        """Puts the new chunks of a batch into the cache with one call of the model, which costs far less than one call each."""
        words: set[str] = set()
        for text in texts:
            words.update(text.split(" "))
        new = [w for w in words if w not in self.chunks and w and len(w) <= self.chunks.longest and not w[0].isspace() and not w[-1].isspace()]
        if len(self.chunks) + len(new) > self.chunks.limit:
            self.chunks.clear()
        split = [[self._mapped(x.encode()) for x in self.split(" " + w)] for w in new]
        found = iter(self.model.encode([t for tokens in split for t in tokens], num_threads=1))
        for word, tokens in zip(new, split, strict=True):
            self.chunks[word] = np.array([i for t in tokens for i in self._ids(t, next(found))], "<i4").tobytes()

    def encode(self, texts: list[str], step: int = 2000) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for k in range(0, len(texts), step):
            self._learn(part := texts[k : k + step])
            out += map(self.chunks.of, part)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<i4").tolist()))


@functools.lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """Once a worker."""
    return ByteBpe(read_ranks(path), pattern)


def list_array(packed: list[bytes]) -> pa.ListArray:
    """Rows of packed ids as an Arrow list column."""
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for each row of docs: the ids of its whole text, and the bytes those ids stand for.

    Scan-local: no shuffle, a batch at a time. A null text is empty; an empty text has no ids and empty bytes; rows that
    repeat, also with one doc_id, each give a row; a null doc_id stays null; other columns are not read.
    """

    def make():
        bpe = load(path, pattern)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = bpe.encode(batch.column(1).to_pylist())
            decoded = pa.array([bpe.decode(x) for x in packed], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), list_array(packed), decoded], ["doc_id", "ids", "decoded"])

        return apply

    return over_batches(texts_of(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded binary")
