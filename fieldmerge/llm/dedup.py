"""Exact duplicates by two passes over a Bloom filter: only rows whose hash may be repeated are shuffled.

Pass 1 reads 64-bit hashes of the texts. Each task marks, in shards of a bit table, the two cells of each hash, and tells the
cells that it marked once from those it marked again; shards meet in one group each, where cells of two tasks also count as
marked again. Pass 2 tests every row: a repeated text has both its cells marked again, so a row without is alone for certain
and goes straight to the result. The rest, repeated texts and a few false alarms, are grouped by SHA-256.

The marked table grows with the corpus (bits_per_row bits a row) and is broadcast in parts of at most max_filter_bytes, one after
the other: the rows whose hashes belong to a part's shards are tested and stored, and the broadcast is destroyed before the next
part. A row is tested in one round only, so a text that is alone never shuffles, whatever the size. exact_duplicates() tests stored
hashes, so it reads the texts twice; drop_exact_duplicates() reads them once more for each part, of 8 * max_filter_bytes /
bits_per_row rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored
from fieldmerge.llm.common import one_of_each, texts_of

#: Bits of a shard: 128 KB, some 65,000 rows at 16 bits a row.
SHARD_BITS = 1 << 20


def cells(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each signed 64-bit hash, both in the shard that is its remainder."""
    shard = h % shards * SHARD_BITS
    mixed = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return shard + (mixed >> np.uint64(44)).astype(np.int64), shard + (mixed >> np.uint64(22) & np.uint64(SHARD_BITS - 1)).astype(np.int64)


def _mark(shards: int):
    def run(batches):
        seen = [np.empty(0, np.int64)]
        for batch in batches:
            first, second = cells(batch.column(0).to_numpy(zero_copy_only=False), shards)
            # a row whose two cells are one must not look repeated
            seen.append(np.concatenate([first, second[second != first]]))
        found, count = np.unique(np.concatenate(seen), return_counts=True)
        if len(found):
            shard = found // SHARD_BITS
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = [*starts[1:], len(found)]
            local, again = (found % SHARD_BITS).astype("<u4"), count > 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[starts], pa.int64()),
                    pa.array([local[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([np.packbits(again[a:b]).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ],
                ["shard", "marked", "again"],
            )

    return run


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """The cells of one shard that were marked more than once."""
    count = np.zeros(SHARD_BITS, np.uint8)
    for marked, again in zip(group["marked"], group["again"], strict=True):
        at = np.frombuffer(marked, "<u4")
        new = count[at] + 1 + np.unpackbits(np.frombuffer(again, np.uint8), count=len(at))
        count[at] = np.minimum(new, 2)
    return pd.DataFrame({"shard": [group["shard"].iloc[0]], "bits": [np.packbits(count > 1, bitorder="little").tobytes()]})


def repeated_cells(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, bits) of a one-column table of 64-bit hashes."""
    marks = hashes.mapInArrow(_mark(shards), "shard long, marked binary, again binary")
    return marks.groupBy("shard").applyInPandas(_meet, "shard long, bits binary")


def maybe_repeated(filters: DataFrame, shards: int, rounds: range, h: Column) -> tuple[Column, Broadcast]:
    """A boolean column: the hash, whose shard is within rounds, may be repeated; and what it has broadcast, 128 KB a shard of rounds."""
    first_bit, size = rounds.start * SHARD_BITS, len(rounds) * SHARD_BITS // 8
    bits = np.zeros(size, np.uint8)
    for row in filters.where(F.col("shard").between(rounds.start, rounds.stop - 1)).toLocalIterator():
        at = (row["shard"] - rounds.start) * SHARD_BITS // 8
        bits[at : at + SHARD_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = filters.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        found = [x - first_bit for x in cells(column.to_numpy(np.int64), shards)]
        at = shared.value
        hit = [at[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in found]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return test(h), shared


def tested(rows: DataFrame, h: str, flag: str, filters: DataFrame, shards: int, max_filter_bytes: int) -> list[DataFrame]:
    """rows with flag, whether their hash h may be repeated: one table for each part of the filter, every row in one of them.

    One part of the filter is there at a time: where there are several, the rows of each are tested and stored, and its broadcast is
    destroyed before the next part is read. A filter of one part leaves its rows to the caller's plan.
    """
    step = max(1, max_filter_bytes * 8 // SHARD_BITS)
    if shards <= step:
        return [rows.withColumn(flag, maybe_repeated(filters, shards, range(shards), F.col(h))[0])]
    out = []
    for start in range(0, shards, step):
        part = range(start, min(start + step, shards))
        test, shared = maybe_repeated(filters, shards, part, F.col(h))
        own = rows.where(F.pmod(F.col(h), F.lit(shards)).between(part.start, part.stop - 1))
        out.append(stored(own.withColumn(flag, test), "tested"))
        shared.destroy()
    return out


def _filter_for(texts: DataFrame, bits_per_row: int) -> tuple[DataFrame, int]:
    shards = max(1, -(-texts.count() * bits_per_row // SHARD_BITS))
    return stored(repeated_cells(texts.select(F.xxhash64("text").alias("h")), shards), "cells"), shards


def _classes(rows: DataFrame) -> DataFrame:
    """Of rows that may be repeated: sha, h, the row that stays and the size, one row per text."""
    return rows.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"), F.first("h").alias("h"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha binary) for every row of docs.

    Texts are equal when identical; a null text equals the empty one. Of equal texts the row with the largest doc_id stays (a
    null doc_id is the smallest); of rows that also share that doc_id, exactly one stays. Other columns are not read; an empty
    table gives no rows. A text that a third of all rows share is one partial count a task, and its rows only meet their
    class in a join whose two sides are plain exchanges, which AQE splits.
    """
    texts = texts_of(docs, id_col, text_col)
    filters, shards = _filter_for(texts, bits_per_row)
    rows = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("h"))
    several = shards * SHARD_BITS > 8 * max_filter_bytes
    parts = tested(stored(rows, "rows") if several else rows, "h", "maybe", filters, shards, max_filter_bytes)
    rows = functools.reduce(DataFrame.unionByName, parts if several else [stored(x, "hashed") for x in parts])
    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = rows.where("maybe")
    found = maybe.join(_classes(maybe), ["sha", "h"])
    return alone.unionByName(found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs that stay, with all their columns; texts, nulls and ties as in exact_duplicates().

    Rows that are alone by the filter pass straight through, however large it is; only the others are shuffled. Of rows that
    share text and doc_id but not the other columns, the one whose columns, told as JSON, come first stays.
    """
    texts = texts_of(docs, id_col, text_col)
    filters, shards = _filter_for(texts, bits_per_row)
    text, key = F.coalesce(F.col(text_col), F.lit("")), "__fm_"  # by name: parts of a large filter are read back from files
    rows = docs.withColumns({f"{key}h": F.xxhash64(text), f"{key}id": F.col(id_col).cast("long")})
    parts = tested(rows, f"{key}h", f"{key}maybe", filters, shards, max_filter_bytes)
    rows = functools.reduce(DataFrame.unionByName, parts)
    maybe = rows.where(f"{key}maybe").withColumn(f"{key}sha", F.unhex(F.sha2(text, 256)))
    best = maybe.select(F.col(f"{key}id").alias("doc_id"), F.col(f"{key}h").alias("h"), F.col(f"{key}sha").alias("sha"), F.lit(0).alias("row"))
    best = _classes(best).select(F.col("sha").alias(f"{key}s"), F.col("best.doc_id").alias(f"{key}best"))
    stay = maybe.join(best, (F.col(f"{key}sha") == F.col(f"{key}s")) & F.col(f"{key}id").eqNullSafe(F.col(f"{key}best")), "left_semi")
    return rows.where(~F.col(f"{key}maybe")).select(*docs.columns).unionByName(one_of_each(stay, [f"{key}id", f"{key}sha"], docs.columns))
