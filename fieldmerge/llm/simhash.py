"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most r bits apart have a number between them that is at most r/2 bits from either. So every
distinct fingerprint emits all numbers within half the radius, rows are shuffled on those, and what collides is verified.
All fingerprints that meet on one number are within that half radius of it, so a group has at most as many members as the
ball has numbers (65 for radius 2); each is linked to the group's smallest, which keeps every chain of links and emits no
more rows than came in.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored
from fieldmerge.llm.common import one_of_each_part, over_batches, texts_of
from fieldmerge.operators.graph import connected_components

#: Shingle hashes whose bits are counted at once, 64 bytes each.
_BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of so many words of A-Z-lower-cased text, joined by single spaces; of all words if fewer."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxh64_intdigest(joined, 42)]
    ends = list(itertools.accumulate(map(len, tokens), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: len(tokens) - words])]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from the highest bit down."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        total += np.unpackbits(hashes[k : k + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def signature(hashes: np.ndarray) -> int:
    """Signed 64-bit; a bit is 1 if over half the hashes have it."""
    bits = 2 * _bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit; a bit is 1 if over half the shingles have it; 0 for a text without words."""
    return signature(np.array(shingle_hashes(text, words), np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, h long) per row, from the whole text; null and empty texts and such without words have 0; h is xxhash64 of the text."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(x, words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], ["doc_id", "fp", "h"])

        return apply

    return over_batches(texts_of(docs, id_col, text_col).withColumn("h", F.xxhash64("text")), make, "doc_id long, fp long, h long")


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst) fingerprints of a one-column table fp of distinct ones: links that join whatever is within radius bits, step by step."""
    if radius % 2 or radius > 4:
        raise ValueError("an even radius of at most 4 bits, so that all who meet on a number are within it of each other")
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    masks = [sum(c) for k in range(radius // 2 + 1) for c in itertools.combinations(bits, k)]
    variants = distinct.select("fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m.cast("long")))).alias("variant"))
    low = variants.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("low"))
    met = low.where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst")).distinct()
    return met.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)


def near_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, h, part): documents whose fingerprints are linked, directly or by others, at `radius` or fewer bits.

    component_id is the smallest doc_id reachable, itself included (null only if no doc_id of the component is known). Rows
    that repeat, also with one doc_id, each give a row; all texts without words have fingerprint 0 and are linked like any
    other; an empty table gives no rows. h is xxhash64 of the text; part, the smallest fingerprint linked, names the component
    also where doc_ids repeat. Work after the fingerprints is on distinct ones, so copies cost nothing more.
    """
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    parts = connected_components(stored(ball_links(first.select("fp"), radius), "links"))
    named = first.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    least = named.groupBy("part").agg(F.min("low").alias("component_id"))
    labels = stored(named.select("fp", "part").join(least, "part").select("fp", "component_id", "part"), "labels")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id", "h", "part")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: the one with the smallest doc_id (see common.one_of_each_part)."""
    placed = stored(near_components(docs, words, radius, id_col, text_col).select("doc_id", "h", "part"), "placed")
    return one_of_each_part(docs, placed, id_col, text_col)
