"""Document fingerprints of closed syncmers.

A k-mer of code points is chosen if, of the s-mers within it, the one with the least hash is the first or the last. Whether
it is chosen depends on its own letters only, so the same passage gives the same anchors in any document, at any place, and
every window of k - s k-mers has one. The fingerprint of a text is all its anchors with their positions, so it grows with the
text; an anchor that repeats counts as often as it stands there, its n-th place for its n-th. A text too short for any anchor
has one for all of it; the empty text has none.

Two fingerprints are compared by position: of the anchors that both have, those count that come in one order in both. Their
share of all anchors of either is the overlap J; the likeness is 2J / (1 + J), the share of text in common.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import over_batches, texts_of

#: s-mer and window; a k-mer has S + W - 1 = 23 code points and one in W / 2 = 8 is chosen.
S, W = 8, 16
K = S + W - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: k-mer starts looked at together.
_BLOCK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of runs of 2 * length letters from those of length letters."""
    return h[:-length] * np.uint64(pow(int(_BASE), length, 1 << 64)) + h[length:]


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the closed syncmers of one array of code points."""
    h = _mixed(codes.astype(np.uint64) + _BASE)
    for length in (1, 2, 4):
        h = _doubled(h, length)
    low = order = _mixed(h)
    for length in (1, 2, 4, 8):
        low = np.minimum(low[:-length], low[length:])
    n = len(low)
    at = np.flatnonzero((low == order[:n]) | (low == order[W - 1 : W - 1 + n]))
    # the 16 letters from the start and the 8 that end the k-mer
    pair = h[at] * np.uint64(pow(int(_BASE), S, 1 << 64)) + h[at + S]
    return at, _mixed(pair ^ _mixed(h[at + W - 1]))


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, position, hash) of all anchors, by number and position."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k in range(0, max(0, len(codes) - K + 1), _BLOCK):
        a, b = _anchors(codes[k : k + _BLOCK + K - 1])
        at.append(a + k)
        hashes.append(b)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    owner = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[owner] if len(at) else np.empty(0, bool)
    return owner[inside], (at - (ends - lengths)[owner])[inside], hashes[inside]


def _of_whole(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def anchor_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its anchors: keys ascending, and their positions. The n-th of equal hashes has a key of its own."""
    owner, position, hashes = anchors(texts)
    order = np.lexsort((position, hashes, owner))
    owner, position, hashes = owner[order], position[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    again = np.flatnonzero(~new)
    if len(again):
        nth = again - starts[np.searchsorted(starts, again, side="right") - 1]
        hashes[again] = _mixed(hashes[again] + nth.astype(np.uint64) * _BASE)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        keys, places = hashes[cuts[i] : cuts[i + 1]], position[cuts[i] : cuts[i + 1]]
        if len(keys) and not new[cuts[i] : cuts[i + 1]].all():
            by = np.argsort(keys, kind="stable")
            keys, places = keys[by], places[by]
        if not len(keys) and text:
            keys, places = np.array([_of_whole(text)], np.uint64), np.zeros(1, np.int64)
        out.append((keys, places))
    return out


def in_order(positions: np.ndarray) -> int:
    """The longest run of rising positions, not necessarily adjacent."""
    if len(positions) < 2 or (positions[1:] > positions[:-1]).all():
        return len(positions)
    ends: list[int] = []
    for p in positions.tolist():
        k = bisect.bisect_left(ends, p)
        ends[k : k + 1] = [p]
    return len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    found = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    shared = hb[found] == ha
    if not shared.any():
        return 0.0
    mine, theirs = pa_[shared], pb[found[shared]]
    common = in_order(theirs[np.argsort(mine, kind="stable")])
    j = common / (len(ha) + len(hb) - int(shared.sum()))
    return 2 * j / (1 + j)


def spelled(found: tuple[np.ndarray, np.ndarray]) -> str:
    """All anchors by position in base64, six bytes each: how far from the one before (W at most), and the upper 40 bits of the key."""
    keys, position = found
    order = np.argsort(position, kind="stable")
    rows = np.empty((len(keys), 6), np.uint8)
    rows[:, 0] = np.diff(position[order], prepend=0)
    rows[:, 1:] = keys[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return base64.b64encode(rows.tobytes()).decode()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, anchors array<struct<position, key>>) per row, by position: scan-local, a batch at a time, whole texts.

    A null text is empty and has no anchors; a null doc_id stays null; rows that repeat each give a row; an empty table gives
    no rows; other columns are not read.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = anchor_sets(batch.column(1).to_pylist())
            order = [np.argsort(p, kind="stable") for _, p in found]
            ends = np.cumsum([0, *(len(x) for x in order)])
            keys = np.concatenate([np.empty(0, np.uint64), *(k[o] for (k, _), o in zip(found, order, strict=True))]).view(np.int64)
            places = np.concatenate([np.empty(0, np.int64), *(p[o] for (_, p), o in zip(found, order, strict=True))])
            listed = pa.StructArray.from_arrays([pa.array(places, pa.int64()), pa.array(keys, pa.int64())], ["position", "key"])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)], ["doc_id", "anchors"])

        return apply

    return over_batches(texts_of(docs, id_col, text_col), make, "doc_id long, anchors array<struct<position:long,key:long>>")


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accuracy: int = 4) -> DataFrame:
    """(doc_id, text, h, bucket, copy), of which _pairs() makes (doc_id, text, next); next is the text that follows, the first after the last.

    Rows come by doc_id (null first), then xxhash64 of the text, then text. They are dealt out by ranges of doc_id, whose bounds
    are approximate quantiles, and a doc_id that fills several ranges, null too, by ranges of the hash as well. The first row of
    each range also goes to the range before it. So texts are shuffled once, no task needs more than its range in order, and
    the driver sees two numbers per range. One row is its own next.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * accuracy
    shares = [i / n for i in range(1, n)]
    found = texts.agg(F.percentile_approx("doc_id", shares, 8 * n).alias("b"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("known")).first()
    cuts, times = np.unique(np.array(found["b"] or [], np.int64), return_counts=True)
    # ranges of the hash for the null doc_id and for the one at which each range starts; what follows in the range comes after them
    times = np.concatenate([[-(-(found["rows"] - found["known"]) * n // max(1, found["rows"]))], times])
    many, least = int(times.max()) + 1, int(np.iinfo(np.int64).min)

    @F.pandas_udf("long")
    def bucket(none, doc_id, h):
        null, ids = none.to_numpy(bool), doc_id.to_numpy(np.int64)
        at = np.where(null, 0, np.searchsorted(cuts, ids, side="right"))
        low, own = np.concatenate([[least], cuts])[at], times[at]
        part = np.floor((h.to_numpy(np.int64).astype(float) + 2.0**63) / 2.0**64 * own).astype(np.int64)
        hot = null | ((at > 0) & (ids == low))
        return pd.Series(at * many + np.where(hot, np.minimum(part, np.maximum(own - 1, 0)), own))

    rows = texts.withColumn("bucket", bucket(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(least).cast("long")), "h"))
    first = {r["bucket"]: r["low"] for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("low")).collect()}
    used = sorted(first)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    heads = spark.createDataFrame([(before[b], *first[b]) for b in used] or [(0, None, 0)], "before long, low long, low_h long")
    copies = texts.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h")))
    copies = copies.groupBy(F.col("before").alias("bucket")).agg(F.min(F.struct("doc_id", "text", "h")).alias("r")).select("r.*", "bucket", F.lit(1).alias("copy"))
    dealt = rows.withColumn("copy", F.lit(0)).unionByName(copies).repartitionByRange(n // accuracy, "bucket")
    return dealt.sortWithinPartitions("bucket", "copy", "doc_id", "h", "text").select("doc_id", "text", "bucket", "copy")


def _pairs(batches):
    """Batches of (doc_id, text, next) from batches of sorted (doc_id, text, bucket, copy)."""
    last = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and last[2] == row[2] and not last[3]:
                out.append((last[0], last[1], row[1]))
            last = row
        yield out


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = 1 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    The edited text has its last half (rounded down, in code points) replaced by as many of the next text (see edited_by_next).
    Likenesses are of whole fingerprints. Equal texts have equal fingerprints and likeness 1, two empty ones too; an empty and
    another text have likeness 0. A null text is empty; rows that repeat each give a row; an empty table gives no rows.
    """

    def run(batches):
        def emit(pairs):
            k = len(pairs)
            texts = [x for _, x, _ in pairs]
            edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for _, x, y in pairs]
            # the next text is mostly that of the next pair, whose anchors are known then
            place, other = [], []
            for i, (_, _, y) in enumerate(pairs):
                known = i + 1 < k and y is texts[i + 1]
                place.append(i + 1 if known else 2 * k + len(other))
                if not known:
                    other.append(y)
            found = anchor_sets([*texts, *edited, *other])
            own, changed, following = found[:k], found[k : 2 * k], [found[i] for i in place]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in pairs], pa.int64()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
                    pa.array([spelled(x) for x in own]),
                    pa.array([spelled(x) for x in changed]),
                    pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        waiting, chars = [], 0
        for pairs in _pairs(batches):
            for pair in pairs:
                waiting.append(pair)
                chars += 2 * len(pair[1]) + len(pair[2])
                if chars >= step:
                    yield emit(waiting)
                    waiting, chars = [], 0
        if waiting:
            yield emit(waiting)

    return edited_by_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
