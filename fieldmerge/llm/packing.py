"""Packing token sequences into fixed-length rows: bounded-space online best fit.

Pieces are placed as they come. A fixed number of bins is open; a bitset has bit f set where an open bin has f tokens free, so
the best bin for n tokens is the lowest set bit from n on. When no bin fits, a new one opens, and if too many are then open
the fullest closes, the one with the lowest set bit. Every task packs what it reads, so nothing is shuffled, memory is the
open bins, and what a task leaves unfilled does not grow with its input.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldmerge.llm.bpe import Chunks, read_ranks
from fieldmerge.llm.common import over_batches, texts_of


class BestFit:
    """place(n) -> (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.mask, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} tokens")
        if fits := self.mask >> n:
            free = n + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            chosen, free, self.next = self.next, self.capacity, self.next + 1
        if left := free - n:
            if self.open == self.open_bins:
                fullest = (self.mask & -self.mask).bit_length() - 1
                if left < fullest:
                    return chosen, self.capacity - free
                self._take(fullest)
            self.by_free[left].append(chosen)
            self.mask |= 1 << left
            self.open += 1
        return chosen, self.capacity - free


@functools.lru_cache(2)
def _encoding(path: str, pattern: str):
    """Once a worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def _encoder(path: str, pattern: str) -> Chunks:
    """Its chunks are remembered as long as the task runs: the worker goes on to other stages, which need the memory."""
    encoding = _encoding(path, pattern)
    return Chunks(lambda x: np.array(encoding.encode_ordinary(x), "<u4").tobytes())


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of a tokenizer file, which stand for themselves wherever they occur in a text."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in listed):
        raise ValueError("an added token that is more than its own string")
    return tuple((t["content"], t["id"]) for t in listed)


def encoded(text: str, chunks: Chunks, added: dict[str, bytes], cut: re.Pattern | None) -> bytes:
    """Ids of a text; added tokens split it, and what lies between them is encoded apart."""
    if cut is None or not any(x in text for x in added):
        return chunks.of(text)
    return b"".join(added[x] if x in added else chunks.of(x) for x in cut.split(text) if x)


def pack_documents(docs: DataFrame, path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), end_id: int = 2, capacity: int = 1024, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids binary (little-endian unsigned 32-bit), sequence_id, offset.

    A document is the ids of its whole text and then end_id. One of at most `capacity` tokens stays whole; a longer one is cut
    into pieces of `capacity`, of which the first may be shorter. Sequences are gapless from offset 0. Texts are encoded by the
    rank file, whose ids are those of the tokenizer file with the same vocabulary; the strings listed in added (see added_tokens)
    have their own ids wherever they occur, the leftmost and of those the longest first.

    A null text is empty and has the one token end_id; a null doc_id stays null; rows that repeat are packed each. An empty
    table gives no rows. sequence_id holds the task's number above its own count, so a task that runs again gives the same ones.
    """

    def make():
        chunks, end = _encoder(path, pattern), np.array([end_id], "<u4").tobytes()
        own = {x: np.array([i], "<u4").tobytes() for x, i in added}
        cut = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, pieces, starts, lengths, parts, sequences, offsets = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoded(text, chunks, own, cut) + end
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    size = (total - at) % capacity or capacity
                    sequence, offset = bins.place(size)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(size)
                    parts.append(ids if size == total else ids[4 * at : 4 * (at + size)])
                    sequences.append(sequence)
                    offsets.append(offset)
                    at, piece = at + size, piece + 1
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), long(starts), long(lengths), pa.array(parts, pa.binary()), long(sequences), long(offsets)],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

        return apply

    return over_batches(texts_of(docs, id_col, text_col), make, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
