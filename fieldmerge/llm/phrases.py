"""Collocations: phrases of 2 to 4 words whose words stand together far more often than apart, counted in quotient filters.

1. Texts become chunks of word numbers (`encoded`): each task numbers the words of the stretch it reads and stores the numbers,
   compressed, with its own dictionary. So texts are split once, and only dictionaries are shuffled to count words.
2. A word that a language has fewer than min_count times is in no candidate; it ends the piece it stands in. The others get
   dense numbers of b bits over all languages (`numbered`), and each chunk's dictionary is joined to them. A task gets a chunk's numbers
   after the rows of its dictionary, sorted, so that it holds one chunk at a time however many it has.
3. Phrases of n words are n * b bits. An invertible permutation spreads them; its first bits, the quotient, choose the bucket
   and the place in a counting quotient filter, the rest, the full remainder, is stored there: nothing is lost. Tasks write a
   filter per bucket for every `shard` phrases (`counted`), and the filters of a bucket, sorted as they are, are merged.
4. What reaches min_count is permuted back to words and scored by DataFrame joins (`collocations`).
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.session import LARGE_ROWS, stored
from fieldmerge.llm.common import STEP_BYTES, bounded_batches, steps

MAX_WORDS = 4

#: What ends a piece, between which words are separated by spaces and tabs.
PIECE_END = r"[.,;:!?\x0A-\x0D]"


# ---- the filter ---------------------------------------------------------------------------------------------------------------


def _round(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    """bits pseudo-random bits of each x, for round k."""
    h = (x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))) & np.uint64((1 << bits) - 1)


def permuted(high: np.ndarray, low: np.ndarray, high_bits: int, low_bits: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all (high, low) of the given widths: each half in turn is masked by a mixture of the other; back undoes it."""
    for k in reversed(range(6)) if back else range(6):
        if k % 2:
            low = low ^ _round(high, k, low_bits)
        else:
            high = high ^ _round(low, k, high_bits)
    return high, low


@dataclasses.dataclass(frozen=True)
class Layout:
    """How phrases of n words of b bits lie in filters of 2**bucket_bits buckets: two halves of at most 64 bits."""

    n: int
    b: int
    bucket_bits: int

    @property
    def high_bits(self) -> int:
        return self.b * (self.n - self.n // 2)

    @property
    def low_bits(self) -> int:
        return self.b * (self.n // 2)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted halves of phrases, given as one array of numbers for each place."""
        half, b = self.n - self.n // 2, np.uint64(self.b)
        halves = []
        for part in (words[:half], words[half:]):
            x = part[0].astype(np.uint64)
            for w in part[1:]:
                x = x << b | w.astype(np.uint64)
            halves.append(x)
        return permuted(*halves, self.high_bits, self.low_bits)

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        high, low = permuted(high, low, self.high_bits, self.low_bits, back=True)
        half, mask = self.n - self.n // 2, np.uint64((1 << self.b) - 1)
        take = lambda x, m: [x >> np.uint64(self.b * (m - 1 - k)) & mask for k in range(m)]
        return take(high, half) + take(low, self.n // 2)


def tallied(high: np.ndarray, low: np.ndarray, low_bits: int, high_bits: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in order, and the sum of counts (default: one each) of each."""
    if high_bits + low_bits <= 64:  # one number tells a phrase
        key = high << np.uint64(low_bits) | low
        order = None
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        sums = np.diff(np.append(new, len(key))) if order is None else (np.add.reduceat(counts[order], new) if len(new) else np.empty(0, np.int64))
        key = key[new]
        return key >> np.uint64(low_bits), key & np.uint64((1 << low_bits) - 1), sums
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.empty(0, np.int64)
    sums = np.diff(np.append(new, len(high))) if counts is None else (np.add.reduceat(counts[order], new) if len(new) else np.empty(0, np.int64))
    return high[new], low[new], sums


def _bytes_of(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def filled(high: np.ndarray, low: np.ndarray, counts: np.ndarray, high_bits: int, low_bits: int) -> dict[str, object]:
    """The counting quotient filter of distinct sorted (high, low), whose high has high_bits that differ (the bucket's are cut off).

    Quotient: the first bits of high, about as many as there are items' bits, so that remainders are whole bytes. `occupied`: a bit
    for each quotient, whether it has items; `run_end`: a bit for each item, whether it is the last of its quotient; `remainder`:
    the bytes of each item's other bits; `many`: a bit for each item, whether its count is over 1; `counts`: those counts.
    """
    n = len(high)
    wanted = min(high_bits, max(0, n.bit_length()))  # bits of the quotient, before rounding
    rest = 8 * -(-(high_bits - wanted + low_bits) // 8)  # bits of the remainder, in whole bytes
    q_bits = max(0, high_bits + low_bits - rest)
    r_high = high_bits - q_bits
    quotient = high >> np.uint64(r_high) if q_bits else np.zeros(n, np.uint64)
    occupied = np.zeros(1 << q_bits, bool)
    occupied[quotient.astype(np.int64)] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True) if n else np.empty(0, bool)
    left = high & np.uint64((1 << r_high) - 1)
    parts = [_bytes_of(left, -(-r_high // 8)), _bytes_of(low, -(-low_bits // 8))]
    if r_high + low_bits <= 64:
        parts = [_bytes_of(left << np.uint64(low_bits) | low, -(-(r_high + low_bits) // 8))]
    many = counts > 1
    return {
        "q_bits": q_bits,
        "n_items": n,
        "occupied": np.packbits(occupied).tobytes(),
        "run_end": np.packbits(run_end).tobytes(),
        "remainder": np.hstack(parts).tobytes(),
        "many": np.packbits(many).tobytes(),
        "counts": counts[many].astype("<u8" if counts.max(initial=0) >> 32 else "<u4").tobytes(),
    }


def listed(f: dict, high_bits: int, low_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, counts) of a filter, in order: what filled() was given."""
    n, q_bits = f["n_items"], f["q_bits"]
    r_high = high_bits - q_bits
    bits = lambda x, m: np.unpackbits(np.frombuffer(x, np.uint8), count=m).astype(bool)
    quotients = np.flatnonzero(bits(f["occupied"], 1 << q_bits)).astype(np.uint64)
    run_end = bits(f["run_end"], n)
    quotient = quotients[np.concatenate([[0], np.cumsum(run_end[:-1])]).astype(np.int64)] if n else np.empty(0, np.uint64)
    whole = np.frombuffer(f["remainder"], np.uint8)

    def number(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        if x.shape[1]:
            out[:, 8 - x.shape[1] :] = x
        return out.view(">u8").reshape(-1).astype(np.uint64)

    if r_high + low_bits <= 64:
        rest = number(whole.reshape(n, -1) if n else whole.reshape(0, 0))
        left, low = (rest >> np.uint64(low_bits) if low_bits < 64 else np.zeros(n, np.uint64)), rest & np.uint64((1 << low_bits) - 1)
    else:
        cut = -(-r_high // 8)
        both = whole.reshape(n, -1)
        left, low = number(both[:, :cut]), number(both[:, cut:])
    counts, many = np.ones(n, np.int64), bits(f["many"], n)
    told = f["counts"]
    counts[many] = np.frombuffer(told, "<u8" if many.any() and len(told) == 8 * many.sum() else "<u4")
    return quotient << np.uint64(r_high) | left if r_high < 64 else left, low, counts


def merged(filters: list[dict], layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, counts) of all filters of one bucket together; high without the bucket's bits."""
    width = layout.high_bits - layout.bucket_bits
    parts = [listed(f, width, layout.low_bits) for f in filters]
    high, low, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tallied(high, low, layout.low_bits, width, counts)


# ---- texts to numbers ---------------------------------------------------------------------------------------------------------


def _chunk(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """(numbers, languages, words, counts) of (lang, text): the numbers index the other three from 1; 0 ends a piece or a text."""
    text = pc.replace_substring_regex(pc.ascii_lower(batch.column(1)), PIECE_END, " \n ")
    lists = pc.split_pattern_regex(text, r"[ \t]+")
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
    lang = batch.column(0).dictionary_encode()
    coded = words.dictionary_encode()
    kinds, word = coded.dictionary, coded.indices.to_numpy()
    stops = pc.equal(kinds, "\n").to_numpy(zero_copy_only=False)
    none = stops | pc.equal(kinds, "").to_numpy(zero_copy_only=False)
    both = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes) * len(kinds) + word
    used, number = np.unique(both, return_inverse=True)
    real = ~none[used % max(1, len(kinds))]
    new = np.where(real, np.cumsum(real), 0).astype(np.uint32)
    number = new[number]
    ends = np.cumsum(sizes)
    number, gaps = np.insert(number, ends, 0), np.insert(~none[word] | stops[word], ends, True)  # a text ends a piece
    number = number[gaps]
    used = used[real]
    counts = np.bincount(number, minlength=len(used) + 1)[1:]
    take = lambda a, k: a.take(pa.array(k)).to_pylist()
    return number, take(lang.dictionary, used // max(1, len(kinds))), take(kinds, used % max(1, len(kinds))), counts


def encoded(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Stored chunks (chunk, numbers, words): 4 MB of texts or one longer text each, their words as numbers and the dictionary."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    word = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("numbers", pa.binary()), ("words", pa.list_(word))])
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in steps(batch, 1 << 20):
                numbers, langs, words, counts = _chunk(part)
                told = [{"lang": a, "word": b, "n": int(c)} for a, b, c in zip(langs, words, counts, strict=True)]
                packed = pa.compress(numbers.astype("<u4").tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_pylist([{"chunk": TaskContext.get().partitionId() << 32 | at, "n": len(numbers), "numbers": packed, "words": told}], schema)
                at += 1

    return stored(rows.mapInArrow(run, "chunk long, n long, numbers binary, words array<struct<lang:string,word:string,n:long>>"), "chunks", **LARGE_ROWS)


def numbered(chunks: DataFrame, min_count: int, part_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(words, totals): (id, lang, word, f) of words that a language has min_count times or more, and (lang, n) of all words.

    Numbers are dense but for the unevenness of their parts of about part_rows words; each part is numbered in a task of its own.
    """
    seen = chunks.select(F.explode("words").alias("w")).select("w.*")
    sums = stored(seen.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    often = sums.where(F.col("f") >= min_count)
    parts = max(1, math.ceil(often.count() / part_rows))
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts))
    within = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word")) - 1
    words = often.withColumn("part", part).withColumn("id", (within * parts + F.col("part") + 1).cast("long")).drop("part")
    return stored(words, "words"), sums.groupBy("lang").agg(F.sum("f").alias("n"))


# ---- counting -----------------------------------------------------------------------------------------------------------------

_FILTER = "n int, bucket long, q_bits int, n_items int, occupied binary, run_end binary, remainder binary, many binary, counts binary"


def _layouts(b: int, n_words: int, bucket_items: int) -> list[Layout]:
    bits = max(0, math.ceil(math.log2(max(1, n_words) / bucket_items)))
    return [Layout(n, b, min(bits, b * (n - n // 2))) for n in range(2, MAX_WORDS + 1)]


def _filters(numbers: np.ndarray, layout: Layout) -> Iterator[dict]:
    """A filter a bucket of the phrases of layout.n words in numbers, where 0 ends a piece."""
    n = layout.n
    if len(numbers) < n:
        return
    shifted = [numbers[k : len(numbers) - n + 1 + k] for k in range(n)]
    whole = np.logical_and.reduce([x > 0 for x in shifted])
    high, low = layout.pack([x[whole] for x in shifted])
    high, low, counts = tallied(high, low, layout.low_bits, layout.high_bits)
    width = layout.high_bits - layout.bucket_bits
    bucket = high >> np.uint64(width) if layout.bucket_bits else np.zeros(len(high), np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(high) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        inner = high[i:j] & np.uint64((1 << width) - 1)
        yield {"n": n, "bucket": int(bucket[i]), **filled(inner, low[i:j], counts[i:j], width, layout.low_bits)}


def counted(chunks: DataFrame, words: DataFrame, min_count: int, shard: int = 4_000_000, bucket_items: int = 1_000_000) -> DataFrame:
    """(n, w1..w4, a) of phrases of n = 2 to 4 words with a >= min_count; w: numbers of `words`, 0 beyond the phrase.

    shard: words of a task that go into one set of filters; bucket_items: words of the corpus per bucket, so that what is merged
    in one task is bounded by both. A phrase that is everywhere is one counter of each shard.
    """
    seen = chunks.select("chunk", F.posexplode("words").alias("place", "w"))
    known = seen.join(words.select("id", "lang", "word"), (F.col("w.lang") == F.col("lang")) & (F.col("w.word") == F.col("word")))
    # rows of a dictionary, and after them the numbers that they are for: sorted and spilled by Spark, and never a list of them in a task
    known = known.select("chunk", "place", "id", F.lit(None).cast("binary").alias("numbers"))
    ends = chunks.select("chunk", F.lit((1 << 31) - 1).alias("place"), F.col("n").alias("id"), "numbers")
    both = known.unionByName(ends).repartition("chunk").sortWithinPartitions("chunk", "place")
    bounded_batches(chunks.sparkSession)
    total, top = chunks.agg(F.sum("n")).first()[0] or 0, words.agg(F.max("id")).first()[0] or 1
    b = max(1, int(top).bit_length())
    layouts = _layouts(b, total, bucket_items)
    names = [x.split()[0] for x in _FILTER.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + 5 * [pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            stream = np.concatenate(held) if held else np.empty(0, np.uint32)
            for layout in layouts:
                rows, told = [], 0
                for row in _filters(stream, layout):
                    rows.append(row)
                    told += sum(len(x) for x in row.values() if isinstance(x, bytes))
                    if len(rows) == 256 or told > STEP_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, told = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

        places, ids = [], []  # of the chunk that is read
        for batch in batches:
            place, id_, packed = (batch.column(c) for c in (1, 2, 3))
            at = 0
            for end in [*np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)), None]:
                upto = batch.num_rows if end is None else int(end)
                places.append(place[at:upto].to_numpy().copy())  # a view would hold the batch
                ids.append(id_[at:upto].to_numpy().copy())
                if end is None:
                    break
                at = upto + 1
                numbers = np.frombuffer(pa.decompress(packed[upto].as_buffer(), 4 * id_[upto].as_py(), codec="zstd"), "<u4")
                known, number = np.concatenate(places), np.concatenate(ids)
                places, ids = [], []
                if not len(known):
                    continue
                new = np.zeros(max(int(numbers.max(initial=0)), int(known.max()) + 1) + 1, np.uint32)
                new[known + 1] = number
                held += [new[numbers], np.zeros(1, np.uint32)]
                size += len(numbers)
                if size >= shard:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        layout = layouts[key[0].as_py() - 2]
        high, low, counts = merged(rows.to_pylist(), layout)
        keep = counts >= min_count
        high = high[keep] | np.uint64(key[1].as_py() << (layout.high_bits - layout.bucket_bits))
        told = layout.unpack(high, low[keep])
        told += [np.zeros(keep.sum(), np.uint64)] * (MAX_WORDS - layout.n)
        return pa.table([pa.array(np.full(keep.sum(), layout.n, np.int32)), *[pa.array(x.astype(np.int64)) for x in told], pa.array(counts[keep])], names=["n", "w1", "w2", "w3", "w4", "a"])

    filters = both.mapInArrow(fill, _FILTER)
    return filters.groupBy("n", "bucket").applyInArrow(merge, "n int, w1 long, w2 long, w3 long, w4 long, a long")


# ---- scores -------------------------------------------------------------------------------------------------------------------

_W = [f"w{k}" for k in range(1, MAX_WORDS + 1)]


def _part(first: Column | int, size: Column | int) -> Column:
    """The words first .. first + size - 1 (from 1) of w, filled with 0."""
    w = F.slice("w", first, size)
    return F.concat(w, F.array_repeat(F.lit(0).cast("long"), F.lit(MAX_WORDS) - F.size(w)))


def collocations(docs: DataFrame, min_count: int = 30, absorbed: int = 80, top: int = 2_000, text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score, then a, both falling, then phrase.

    a: occurrences of the phrase within pieces, overlaps included, min_count at least; l, r: those of the two parts at the cut with
    the lowest score floor(2,000,000 a / (l + r)), the first of equal ones; n: all words of the language. A phrase inside a longer
    candidate with absorbed % of its occurrences or more is left out. Figures are exact: products are decimals of 38 digits.
    A null language is `und`, a null text empty; rows that repeat count each; other columns are not read; empty tables give no rows.
    """
    chunks = encoded(docs, text_col, lang_col)
    words, totals = numbered(chunks, min_count)
    phrases = stored(counted(chunks, words, min_count, **sizes), "phrases").withColumn("w", F.array(*_W))
    single = words.select(F.concat(F.array("id"), F.array_repeat(F.lit(0).cast("long"), MAX_WORDS - 1)).alias("key"), F.col("f").alias("times"))
    known = phrases.select(F.col("w").alias("key"), F.col("a").alias("times")).unionByName(single)

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("w", "n", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("times").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("key").alias("right"), F.col("times").alias("r")), "right")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("twice", wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("both", wide("l") + wide("r"))
    cuts = cuts.withColumn("score", F.expr("twice div both"))
    scored = cuts.groupBy("w", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("w", "n", "a", "cut.score", "cut.l", "cut.r")

    size = F.explode(F.sequence(F.lit(2), F.col("n") - 1))
    inner = phrases.where("n > 2").select("w", "n", "a", size.alias("m"))
    inner = inner.select("w", "m", "a", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("first"))
    longer = inner.select(_part(F.col("first"), F.col("m")).alias("w"), F.col("a").alias("longest")).groupBy("w").agg(F.max("longest").alias("longest"))
    own = scored.join(longer, "w", "left").where(F.coalesce(wide("longest") * F.lit(100).cast("decimal(3,0)") < wide("a") * F.lit(absorbed).cast("decimal(3,0)"), F.lit(True)))

    spelled = own.select("*", F.posexplode(F.slice("w", 1, F.col("n"))).alias("place", "id")).join(words.select("id", "lang", "word"), "id")
    told = spelled.groupBy("w", "lang", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
