"""Periodic runs of words, caught online.

A catcher watches one completed block of L words, L a power of two, that starts at a multiple of L. A square of period p in
2L .. 4L - 1 has such a block whole in its first half, so the block comes again p words later. With each word that is appended,
the last L words are the newest suffix; it is compared, by its name, with the two blocks that lie 2L .. 4L - 1 words back (for
L = 1 also with the word before). Equal ones are caught: the block's period p. Catches of neighbouring blocks with one period
belong together and grow with the text; when the next block no longer follows, what is left on either side is shorter than a
block and is compared by halves. What then spans two periods is a square, and the whole stretch is its run.

Names are 64-bit mixtures of the names of the two halves of a block, so all blocks that end at a word are named as it is
appended. Runs are compared word by word before they are told, so a clash of names cannot make one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import WORD, over_batches, texts_of

SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"

#: Words that are appended at a time.
STRETCH = 1 << 16


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class SquareCatcher:
    """The runs of a stream of word numbers: append() words as they come, runs() when all are there.

    capacity: how many words may come; longest: no run is longer, which bounds the sizes of blocks.
    """

    def __init__(self, capacity: int, longest: int):
        self.n, self.words = 0, np.empty(capacity, np.int64)
        sizes = [1]
        while 4 * sizes[-1] <= longest:
            sizes.append(2 * sizes[-1])
        self.sizes = sizes
        self.names = [np.empty(capacity, np.uint64) for _ in sizes]
        none = np.empty((0, 3), np.int64)
        self.open = [none for _ in sizes]  # (period, first block, last block) that may still grow
        self.found = [none for _ in sizes]  # (start, end, period) of stretches of two periods and more
        self.long = [none for _ in sizes]  # (start, end, period) of stretches so long that their multiples need no catching

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        self.words[before : self.n] = words
        for k, size in enumerate(self.sizes):
            lo, hi = max(0, before - size + 1), self.n - size + 1  # windows of this size that are now complete
            if hi <= lo:
                break
            if k == 0:
                self.names[0][lo:hi] = _mixed(words.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
            else:
                half, below = size // 2, self.names[k - 1]
                self.names[k][lo:hi] = _mixed(_mixed(below[lo:hi]) + np.uint64(0xD6E8FEB86659FD93) * below[lo + half : hi + half])
            self._grow(k, self._caught(k, lo, hi))

    def _caught(self, k: int, lo: int, hi: int) -> np.ndarray:
        """(period, block, block) of the new windows that equal a block two or three blocks back."""
        size, names, out = self.sizes[k], self.names[k], []
        for back in (2, 3) if k else (1, 2, 3):
            first = max(lo, back * size)
            if first >= hi:
                continue
            at = np.arange(first, hi)
            block = (at // size - back) * size if k else at - back
            hit = names[first:hi] == names[block]
            out.append(np.column_stack([(at - block)[hit], block[hit], block[hit]]))
        caught = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        known = np.concatenate([x for x in self.long[: max(0, k - 1)]] or [np.empty((0, 3), np.int64)])
        if len(known) and len(caught):  # inside a run of a period of at most a block, longer periods are its multiples
            known = known[np.argsort(known[:, 0], kind="stable")]
            reach = np.maximum.accumulate(known[:, 1])
            place = np.searchsorted(known[:, 0], caught[:, 1], "right") - 1
            caught = caught[~((place >= 0) & (reach[place] >= caught[:, 1] + caught[:, 0] + size))]
        return caught

    def _grow(self, k: int, caught: np.ndarray) -> None:
        """Joins catches of neighbouring blocks; closes those whose next block is there and did not follow."""
        size = self.sizes[k]
        all_ = np.concatenate([self.open[k], caught])
        if not len(all_):
            return
        all_ = all_[np.lexsort((all_[:, 1], all_[:, 0]))]
        new = np.ones(len(all_), bool)
        new[1:] = (all_[1:, 0] != all_[:-1, 0]) | (all_[1:, 1] != all_[:-1, 2] + size)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(all_)) - 1
        chains = np.column_stack([all_[first, 0], all_[first, 1], all_[last, 2]])
        waits = chains[:, 2] + chains[:, 0] + 2 * size > self.n
        self.open[k] = chains[waits]
        self._close(k, chains[~waits])
        inner = np.column_stack([self.open[k][:, 1], self.open[k][:, 2] + self.open[k][:, 0] + size, self.open[k][:, 0]])
        told = np.concatenate([self.found[k], inner])
        self.long[k] = told[told[:, 1] - told[:, 0] >= 8 * told[:, 2]]

    def _close(self, k: int, chains: np.ndarray) -> None:
        """Compares what is left on both sides by halves of blocks, and keeps stretches of two periods and more."""
        size = self.sizes[k]
        chains = chains[chains[:, 2] - chains[:, 1] + chains[:, 0] + 3 * size > 2 * chains[:, 0]]
        if not len(chains):
            return
        p, start, end = chains[:, 0], chains[:, 1].copy(), chains[:, 2] + chains[:, 0] + size
        for j in range(k - 1, -1, -1):
            half, names = self.sizes[j], self.names[j]
            there = end + half <= self.n
            at = np.where(there, end, p)
            end = end + half * (there & (names[at] == names[at - p]))
            there = start >= half
            at = np.where(there, start - half, 0)
            start = start - half * (there & (names[at] == names[at + p]))
        square = end - start >= 2 * p
        self.found[k] = np.concatenate([self.found[k], np.column_stack([start, end, p])[square]])

    def runs(self, min_length: int = 2, min_periods: int = 2) -> np.ndarray:
        """(start, end, period) of the runs among the words so far, by start and period: those of min_length words and of
        min_periods periods, at least two."""
        kept = [np.empty((0, 3), np.int64)]
        for k in range(len(self.sizes)):
            closed, opened = self.found[k], self.open[k]
            self._close(k, opened)
            kept.append(self.found[k])
            self.found[k] = closed  # what is open stays open: more words may come
        found = np.concatenate(kept)
        found = found[found[:, 1] - found[:, 0] >= np.maximum(min_length, min_periods * found[:, 2])]
        found = found[np.lexsort((found[:, 2], -found[:, 1], found[:, 0]))]
        # a stretch inside one of a shorter period repeats that one
        out, wide = [], []
        for start, end, p in found.tolist():
            wide = [x for x in wide if x[1] > start]
            if not any(x[1] >= end and x[2] < p for x in wide):
                out += self._exact(start, end, p)
                wide.append((start, end, p))
        return np.array(sorted(set(out), key=lambda x: (x[0], x[2])), np.int64).reshape(-1, 3)

    def _exact(self, start: int, end: int, p: int) -> list[tuple[int, int, int]]:
        """The stretch itself where all words agree, or the parts of it that do."""
        differ = np.flatnonzero(self.words[start : end - p] != self.words[start + p : end])
        if not len(differ):
            return [(start, end, p)]
        edges = [-1, *differ.tolist(), end - p - start]
        return [(start + a + 1, start + b + p, p) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a - 1 >= p]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, where each text's begin and the last one's end)."""
    trimmed = pc.utf8_trim(pc.fill_null(column, ""), characters=_BLANKS)
    lists = pc.split_pattern_regex(trimmed, SPACE)
    sizes = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, lists.value_lengths().to_numpy())
    words = lists.flatten()
    if len(words) != sizes.sum():
        words = words.filter(pc.not_equal(words, ""))
    return words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def runs_of_texts(words: pa.Array, at: np.ndarray, min_length: int, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, (start, length, period)) of all runs of a batch of texts, which are one stream with a word of its own after each text."""
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes, n_texts = np.diff(at), len(at) - 1
    stream = np.insert(numbers, at[1:], np.arange(n_texts) + len(numbers))  # no other word has these numbers
    begins = at[:-1] + np.arange(n_texts)
    catcher = SquareCatcher(len(stream), int(sizes.max(initial=0)))
    for k in range(0, len(stream), STRETCH):
        catcher.append(stream[k : k + STRETCH])
    runs = catcher.runs(min_length, min_periods)
    text = np.searchsorted(begins, runs[:, 0], "right") - 1
    return text, np.column_stack([runs[:, 0] - begins[text], runs[:, 1] - runs[:, 0], runs[:, 2]])


def strongest(runs: list[list[int]]) -> int:
    """Which (start, length, period) has the greatest length / period; of equal ones the first start, then the shortest period."""
    best = 0
    for k, (_, length, period) in enumerate(runs):
        if length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


def periodic_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, best, collapsed) per row: runs as arrays of (start, length, period) in words, by start and period; the
    strongest one (none: null); the text without the words that a run holds after its first period, joined by one space.

    A run is a stretch of words with smallest period q, of min_length words and min_periods * q at least, that no neighbouring
    word extends. Scan-local over whole texts. A null or empty text has no run and an empty collapsed text; a null doc_id stays
    null; rows that repeat each give a row; an empty table gives no rows; other columns are not read. Time is n log n in the
    words of a batch of texts, memory 8 bytes a word and size of block (about 160 a word in the longest texts).
    """
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, at = split_words(batch.column(1))
            text, runs = runs_of_texts(words, at, min_length, min_periods)
            told, best = [[] for _ in range(len(at) - 1)], [None] * (len(at) - 1)
            whole = pc.binary_join(pa.LargeListArray.from_arrays(at, words), " ")
            shorter = {}
            for t in np.unique(text).tolist():
                mine = runs[text == t].tolist()
                told[t] = [{"start": a, "length": b, "period": q} for a, b, q in mine]
                best[t] = told[t][strongest(mine)]
                drop = np.zeros(at[t + 1] - at[t] + 1, np.int64)
                for a, b, q in mine:
                    drop[a + q] += 1
                    drop[a + b] -= 1
                left = np.flatnonzero(np.cumsum(drop[:-1]) == 0) + at[t]
                shorter[t] = " ".join(words.take(pa.array(left)).to_pylist())
            if shorter:
                whole = pa.array([shorter.get(t, x) for t, x in enumerate(whole.to_pylist())], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(one)), pa.array(best, one), whole.cast(pa.string())], ["doc_id", "runs", "best", "collapsed"])

        return apply

    kind = "struct<start:long,length:long,period:long>"
    return over_batches(texts_of(docs, id_col, text_col), make, f"doc_id long, runs array<{kind}>, best {kind}, collapsed string")


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where one text of ten, by h = crc32 of its doc_id, repeats a stretch of its words up to its end.

    With g = floor(h / 10): from word a = g % n on, the p = 1 + floor((n - a) / (3 + g % 8)) words there are said again and again.
    Texts without words stay; a null doc_id counts as the empty string; an empty table gives no rows.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = texts_of(docs, id_col, text_col).withColumn("h", h)
    words = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    cut = words.withColumn("a", F.when(n > 0, g % n).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), n - F.col("a"))
    tail = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))
