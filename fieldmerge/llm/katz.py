"""A Katz backoff language model of order 2, counted, normalised and applied by Spark jobs.

P(w | v) = d(r) r / (c(v) + 1) for a pair seen r times in training, else a(v) P(w), where P(w) = d1(c) c / N for a known word and
the mass that the discounts free, N - sum d1(c) c, over N for any unknown one. d and d1 are Katz's Good-Turing discounts for
counts up to 5. Each context holds one count more than it was seen, so that some mass is always left, and
a(v) = (1 - sum of its seen P(w | v)) / (1 - sum of P(w) over the same words): both sums are exact, so P(. | v) sums to 1. The
recursion ends at order 1; a context that training does not know backs off with weight 1.

Words are 64-bit hashes, made for a whole batch at once from its bytes. Tokens, as (word, word before, row), are dealt to shards
by word, packed and compressed; a shard counts its words and pairs, knows for each token how often both were seen, and adds up
what that means for each row. So the counts live in tables partitioned by word and every token is evaluated where its counts
are. Words with more tokens than an eighth of a shard are dealt by pair instead, their counts being broadcast (at most eight a
shard), and pairs as common as that (at most sixteen a shard) are resolved where they are read and not dealt at all.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored
from fieldmerge.llm.common import remainder

#: Discounts reach counts up to this.
KATZ = 5
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C13)
_UNBASE = _U(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
END, START = _U(11), _U(13)
#: Bytes looked at together, and tokens that are packed together.
_SLICE, _BLOCK = 1 << 20, 1 << 20
#: Rows of an Arrow batch that a shard gives back.
_PART = 50_000


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(v * _U(0x9FB21C651E98DF25) + w)


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(n - 1, _BASE))])
            self.down = np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(n - 1, _UNBASE))])
        return self.up, self.down


_POWERS = _Powers()


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, text number) of each token of texts that lie one after another in data; ends: where each ends."""
    n, docs = len(data), len(ends)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[0] = True
    begins[ends] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
    stop = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_LETTER[data] * up[:n], out=total[1:])
    words = _mixed((total[stop] - total[start]) * down[start])
    per_doc = np.diff(np.searchsorted(start, ends), prepend=0)
    at = np.cumsum(per_doc)
    w = np.insert(words, at, END)
    doc = np.repeat(np.arange(docs), per_doc + 1)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.concatenate([[0], at[:-1] + np.arange(1, docs)])] = START
    return w, v, doc


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of (text, ...) of about _SLICE bytes: first row, end row, bytes, ends of the texts within them."""
    column = batch.column(0).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + _SLICE, side="right")) - 1)
        yield a, b, data[at[a] : at[b]], at[a + 1 : b + 1] - at[a]
        a = b


def _press(values: np.ndarray) -> bytes:
    """zstandard over the values' byte planes."""
    flat = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes() if len(flat) else b"")


def _unpress(data: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if raw else np.empty(0, kind)


def _press_sorted(values: np.ndarray) -> bytes:
    return _press(np.diff(values, prepend=_U(0)))


def _unpress_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpress(data, _U), dtype=_U)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys starts in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64), pa.int64())


# ---- pass 1: words -------------------------------------------------------------------------------------------------------


def _count_words(shards: int, share: float):
    """Per block of training tokens, its words with counts by shard, and pairs that take more than half of `share` of it, with theirs."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]):
        w, v = (np.concatenate(x) for x in zip(*held, strict=True))
        words, counts = np.unique(w, return_counts=True)
        shard = (words % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        words, counts, shard = words[order], counts[order], shard[order]
        starts = _starts(shard)
        cuts = [*starts.tolist(), len(words)]
        pairs = _pair(v, w)
        order = np.argsort(pairs, kind="stable")
        first = _starts(pairs[order])
        many = np.diff(np.append(first, len(pairs)))
        often = many > share / 2 * len(pairs)
        at = order[first[often]]
        k, hot = len(starts), len(at)
        shard_of = np.concatenate([shard[starts], (pairs[at] % _U(shards)).astype(np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(shard_of, pa.int64()),
                pa.array([_press_sorted(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] + [None] * hot, pa.binary()),
                pa.array([_press(counts[a:b].astype(np.uint32)) for a, b in zip(cuts, cuts[1:], strict=False)] + [None] * hot, pa.binary()),
                pa.array([None] * k + v[at].view(np.int64).tolist(), pa.int64()),
                pa.array([None] * k + w[at].view(np.int64).tolist(), pa.int64()),
                pa.array([None] * k + many[often].tolist(), pa.int64()),
            ],
            ["shard", "words", "counts", "v", "w", "n"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a, b, data, ends in _slices(batch):
                w, v, doc = tokens(data, ends)
                use = np.asarray(batch.column(1).slice(a, b - a))[doc]
                held.append((w[use], v[use]))
                size += len(held[-1][0])
                if size >= _BLOCK:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _meet_words(hot: int):
    """Of one shard: tokens, words, words by count up to KATZ + 1, words over `hot`, and pairs that may be.

    Blocks that did not name a pair hold less than half of `hot` of it together, so one that is over has half of it named.
    """

    def run(table: pa.Table) -> pa.Table:
        words = [_unpress_sorted(x) for x in table["words"].to_pylist() if x is not None]
        counts = [_unpress(x, np.uint32) for x in table["counts"].to_pylist() if x is not None]
        rows: list[tuple] = []
        if words:
            words, counts = np.concatenate(words), np.concatenate(counts).astype(np.int64)
            order = np.argsort(words, kind="stable")
            starts = _starts(words[order])
            words, counts = words[order][starts], _sums(counts[order], starts)
            rows = [("total", int(counts.sum()), 0), ("words", len(words), 0), *((f"n{r}", int((counts == r).sum()), 0) for r in range(1, KATZ + 2))]
            rows += [("hot", a, b) for a, b in zip(words[counts > hot].view(np.int64).tolist(), counts[counts > hot].tolist(), strict=True)]
        named: Counter = Counter()
        for v, w, n in zip(*(table[c].to_pylist() for c in "vwn"), strict=True):
            if v is not None:
                named[v, w] += n
        rows += [("pair", v, w) for (v, w), n in named.items() if n > hot / 2]
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.string()), "a": pa.array([r[1] for r in rows], pa.int64()), "b": pa.array([r[2] for r in rows], pa.int64())})

    return run


# ---- pass 2: pairs that may be too common for one shard --------------------------------------------------------------------


def _count_pairs(wanted: np.ndarray):
    def run(batches):
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for a, b, data, ends in _slices(batch):
                w, v, doc = tokens(data, ends)
                use = np.asarray(batch.column(1).slice(a, b - a))[doc]
                pairs = _pair(v[use], w[use])
                at = np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)
                found += np.bincount(at[wanted[at] == pairs], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted)), pa.int64()), pa.array(found, pa.int64())], ["pair", "n"])

    return run


# ---- pass 3: all tokens to their shards ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """Totals of the training tokens, order-1 discounts, and the words and pairs that are too common for one shard."""

    total: int
    words: int
    docs: int
    discounts: tuple[float, ...]
    mass: int
    unknown: float
    hot: np.ndarray
    hot_counts: np.ndarray
    pairs: np.ndarray
    pair_v: np.ndarray
    pair_w: np.ndarray
    pair_counts: np.ndarray

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) by the count of w."""
        d = np.ones(KATZ + 2)
        d[1 : KATZ + 1] = self.discounts
        return np.where(c > 0, d[np.minimum(c, KATZ + 1)] * c / self.mass, self.unknown)

    def count_of(self, w: np.ndarray, own: np.ndarray) -> np.ndarray:
        """own, or the broadcast count where w is a common word."""
        if not len(self.hot):
            return own
        at = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        return np.where(self.hot[at] == w, self.hot_counts[at], own)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _deal(shards: int, model: Words):
    """Rows of packed tokens per block and shard, and one packed list of the block's rows, with what its common pairs add."""

    def flush(base: int, held: list[tuple], rows: list[tuple]):
        w, v, row = (np.concatenate(x) for x in zip(*held, strict=True))
        at, common = _find(model.pairs, _pair(v, w))
        n = sum(len(r[0]) for r in rows)
        ids, null, use, count = (np.concatenate(x) for x in zip(*rows, strict=True))
        s1, big, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if common.any():
            place, cw = row[common] >> 1, model.count_of(w[common], np.zeros(int(common.sum()), np.int64))
            s1 = np.bincount(place, weights=np.where(w[common] == END, 0, np.log10(cw + 1)), minlength=n)
            big = np.bincount(place, weights=np.log10(model.pair_counts[at[common]]), minlength=n)
            known = np.bincount(place, minlength=n)
            w, v, row = w[~common], v[~common], row[~common]
        _, is_hot = _find(model.hot, w)
        shard = (np.where(is_hot, _pair(v, w), w) % _U(shards)).astype(np.int32)
        order = np.lexsort((row, v, w, shard))
        w, v, row, shard = w[order], v[order], row[order], shard[order]
        starts = _starts(shard)
        cuts = [*starts.tolist(), len(w)]
        parts = list(zip(cuts, cuts[1:], strict=False))
        own = -1 - base // (1 << 36) % shards
        listed = [_press(x) for x in (ids, null, use, count, s1, big, known)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*shard[starts].tolist(), own], pa.int64()),
                pa.array([base] * (len(starts) + 1), pa.int64()),
                pa.array([[_press_sorted(w[a:b]), _press(v[a:b]), _press(row[a:b])] for a, b in parts] + [listed], pa.list_(pa.binary())),
            ],
            ["shard", "base", "packed"],
        )

    def run(batches):
        base, held, rows, size, n = TaskContext.get().partitionId() << 36, [], [], 0, 0
        for batch in batches:
            for a, b, data, ends in _slices(batch):
                w, v, doc = tokens(data, ends)
                use = np.asarray(batch.column(1).slice(a, b - a))
                ids = batch.column(2).slice(a, b - a)
                rows.append((np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_null()), use, np.bincount(doc, minlength=b - a)))
                held.append((w, v, ((doc + n) * 2 + use[doc]).astype(np.uint32)))
                n += b - a
                size += len(w)
                if size >= _BLOCK:
                    yield flush(base, held, rows)
                    base, held, rows, size, n = base + n, [], [], 0, 0
        if rows:
            yield flush(base, held, rows)

    return run


_ROW = {
    "kind": pa.int8(), "key": pa.int64(), "row": pa.int64(), "x": pa.float64(), **{f"k{r}": pa.int64() for r in range(1, KATZ + 2)}, "packed": pa.list_(pa.binary()),
}
_SQL = {pa.int8(): "byte", pa.int64(): "long", pa.float64(): "double", pa.list_(pa.binary()): "array<binary>"}
SCHEMA = ", ".join(f"{k} {_SQL[t]}" for k, t in _ROW.items())
#: Kinds of rows: packed rows of a block (key: its base), packed sums over them (row: the shard), seen words of a context, a token whose pair is unseen, pairs by count, a pair.
BLOCK, SUMS, CONTEXT, UNSEEN, PAIRS, PAIR = range(6)
_BLOCK_TYPES = (np.int64, bool, bool, np.int64, float, float, np.int64)
_SUM_TYPES = (np.uint32, np.int32, float, float, float, *([np.int32] * KATZ))


def _table(kind: int, n: int, **columns) -> pa.Table:
    given = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, _ROW[k]) for k, v in columns.items()}
    return pa.table([given[k] if k in given else pa.array(np.full(n, kind), t) if k == "kind" else pa.nulls(n, t) for k, t in _ROW.items()], names=list(_ROW))


def _evaluate(model: Words, keep_pairs: bool):
    """What the tokens of one shard add to their rows, contexts and the counts of pairs."""

    def run(table: pa.Table) -> pa.Table:
        packed, bases = table["packed"].to_pylist(), table["base"].to_pylist()
        own = table["shard"][0].as_py()
        if own < 0:
            return _table(BLOCK, len(bases), key=bases, packed=packed)
        w = np.concatenate([_unpress_sorted(p[0]) for p in packed])
        v = np.concatenate([_unpress(p[1], _U) for p in packed])
        row = np.empty(len(w), np.int64)
        use, at = np.empty(len(w), bool), 0
        for base, p in zip(bases, packed, strict=True):
            part = _unpress(p[2], np.uint32)
            row[at : at + len(part)] = (part >> 1).astype(np.int64) + base
            use[at : at + len(part)] = part & 1
            at += len(part)
        del packed
        order = np.lexsort((v, w))
        w, v, row, use = w[order], v[order], row[order], use[order].astype(np.int32)
        words, pairs = _starts(w), _starts(w, v)
        cw = model.count_of(w[words], _sums(use, words)).astype(np.int64)
        r = _sums(use, pairs)
        pair_w, pair_v = w[pairs], v[pairs]
        pair_cw = cw[np.searchsorted(words, pairs, side="right") - 1]
        size = np.diff(np.append(pairs, len(w)))
        lone = np.flatnonzero(np.repeat(r == 0, size))
        out = [_table(UNSEEN, len(lone), key=_signed(v[lone]), row=row[lone])]
        del w, v, use, lone
        # what the tokens add to their rows, packed by block
        order = np.argsort(row, kind="stable")
        row = row[order]
        pair_of = np.repeat(np.arange(len(pairs)), size)[order]
        del order
        starts = _starts(row)
        rows = row[starts]
        tell = lambda x: _sums(x[pair_of], starts)
        sums = [tell((pair_cw > 0).astype(np.int32)), tell(np.where(pair_w == END, 0.0, np.log10(pair_cw + 1.0))), tell(np.where(r > KATZ, np.log10(np.maximum(r, 1)), 0.0))]
        sums += [tell(np.where(r == 0, np.log10(model.probability(pair_cw)), 0.0)), *(tell((r == i).astype(np.int32)) for i in range(1, KATZ + 1))]
        del row, pair_of
        known = np.unique(np.array(bases, np.int64))
        cuts = [*np.searchsorted(rows, known).tolist(), len(rows)]
        told = [[_press(np.diff((rows[a:b] - base).astype(np.uint32), prepend=np.uint32(0))), *(_press(x[a:b].astype(t)) for x, t in zip(sums, _SUM_TYPES[1:], strict=True))] for base, a, b in zip(known, cuts[:-1], cuts[1:], strict=True)]
        out.append(_table(SUMS, len(known), key=known, row=np.full(len(known), own), packed=told))
        # contexts
        seen = r > 0
        pv, pr, pc = pair_v[seen], r[seen].astype(np.int64), pair_cw[seen]
        if keep_pairs:
            out.append(_table(PAIR, len(pv), key=_signed(pv), row=_signed(pair_w[seen]), k1=pr, k2=pc))
        out.append(_table(PAIRS, 1, **{f"k{i}": [int((pr == i).sum())] for i in range(1, KATZ + 2)}))
        order = np.argsort(pv, kind="stable")
        starts = _starts(pv[order])
        tell = lambda x: _sums(x[order], starts)
        out.append(_table(CONTEXT, len(starts), key=_signed(pv[order][starts]), x=tell(model.probability(pc)), **{f"k{i}": tell((pr == i).astype(np.int64)) for i in range(1, KATZ + 1)}))
        # in parts, so that no batch is as large as a shard
        whole = pa.concat_tables(out)
        return pa.concat_tables([whole.slice(k, _PART) for k in range(0, len(whole), _PART)])

    return run


def _add_up(d: tuple[float, ...]):
    """The rows of a block with their sums over all shards; what is unseen still lacks its context's weight."""

    def run(table: pa.Table) -> pa.Table:
        base = table["key"][0].as_py()
        parts = sorted(zip(table["kind"].to_pylist(), table["row"].to_pylist(), table["packed"].to_pylist(), strict=True), key=lambda p: (p[0], p[1] or 0))
        ids, null, use, count, x, gain, known = (_unpress(p, t) for p, t in zip(parts[0][2], _BLOCK_TYPES, strict=True))
        x, gain, known = x.copy(), gain.copy(), known.copy()
        for _, _, packed in parts[1:]:
            at, n, px, py, pz, *low = (_unpress(p, t) for p, t in zip(packed, _SUM_TYPES, strict=True))
            at = np.cumsum(at, dtype=np.int64)
            known[at] += n
            x[at] += px
            gain[at] += py + pz
            for i, k in enumerate(low):
                gain[at] += k * math.log10(d[i] * (i + 1))
        n = len(ids)
        return pa.table({
            "row": pa.array(base + np.arange(n), pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=null), "held_out": pa.array(~use), "n_tokens": pa.array(count, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "x": pa.array(x), "gain": pa.array(gain),
        })

    return run


# ---- the model -------------------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, ...]:
    """Katz's discounts of the counts 1 to KATZ from n[r - 1] = how many have count r, r up to KATZ + 1.

    Where the counts are too few for a discount within (0, 1), the absolute discount n1 / (n1 + 2 n2) is taken off instead,
    one half if there are no single counts.
    """
    cut = (KATZ + 1) * n[KATZ] / n[0] if n[0] else 1.0
    flat = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    flat = min(max(flat, 0.1), 0.9)
    out = []
    for r in range(1, KATZ + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - flat) / r)
    return tuple(out)


def _texts(docs: DataFrame, fold: int, folds: int, id_col: str, text_col: str) -> DataFrame:
    doc_id = docs[id_col].cast("long")
    return docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"), (remainder(doc_id, folds) != fold).alias("use"), doc_id.alias("doc_id"))


def _learn_words(texts: DataFrame, per_shard: int) -> tuple[Words, int]:
    sizes = texts.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("use"), 1))).first()
    shards, docs = max(1, round((sizes[0] or 0) / 6 / per_shard)), sizes[1]
    hot = max(1, per_shard // 8)
    share = hot / max(1.0, (sizes[0] or 0) / 6)
    counted = texts.where("use").select("text", "use").mapInArrow(_count_words(shards, min(share, 0.5)), "shard long, words binary, counts binary, v long, w long, n long")
    met = stored(counted.groupBy("shard").applyInArrow(_meet_words(hot), "kind string, a long, b long"), "words")
    facts = {r["kind"]: r["n"] for r in met.where("kind not in ('hot', 'pair')").groupBy("kind").agg(F.sum("a").alias("n")).collect()}
    total, n = facts.get("total", 0), [facts.get(f"n{r}", 0) for r in range(1, KATZ + 2)]
    d = discounts(n)
    # what the discounts free goes to unknown words; if no count is low enough, one count more does
    freed = sum((1 - d[r - 1]) * r * n[r - 1] for r in range(1, KATZ + 1))
    mass = total if freed else total + 1
    common = sorted(((a % (1 << 64), b) for a, b in met.where("kind = 'hot'").select("a", "b").toLocalIterator()), key=lambda x: x[0])
    words = np.array([a for a, _ in common], _U)
    named = [(a % (1 << 64), b % (1 << 64)) for a, b in met.where("kind = 'pair'").orderBy("a", "b").select("a", "b").toLocalIterator()]
    v, w = np.array([a for a, _ in named], _U), np.array([b for _, b in named], _U)
    keys = _pair(v, w)
    order = np.argsort(keys)
    keys, v, w, exact = keys[order], v[order], w[order], np.zeros(len(keys), np.int64)
    if len(keys):
        for row in texts.where("use").select("text", "use").mapInArrow(_count_pairs(keys), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            exact[row["pair"]] = row["n"]
    often = exact > max(hot, KATZ)
    model = Words(total, facts.get("words", 0), docs, d, mass, (freed or 1) / mass, words, np.array([b for _, b in common], np.int64), keys[often], v[often], w[often], exact[often])
    return model, shards


def _evaluated(docs: DataFrame, fold: int, folds: int, per_shard: int, id_col: str, text_col: str, keep_pairs: bool = False) -> tuple[DataFrame, Words, tuple[float, ...]]:
    texts = _texts(docs, fold, folds, id_col, text_col)
    model, shards = _learn_words(texts, per_shard)
    dealt = texts.mapInArrow(_deal(shards, model), "shard long, base long, packed array<binary>")
    rows = stored(dealt.groupBy("shard").applyInArrow(_evaluate(model, keep_pairs), SCHEMA), "evaluated")
    n = rows.where(F.col("kind") == PAIRS).agg(*(F.sum(f"k{r}") for r in range(1, KATZ + 2))).first()
    return rows, model, discounts([x or 0 for x in n])


def _contexts(rows: DataFrame, model: Words, d: tuple[float, ...]) -> DataFrame:
    """(v, weight): log10 of (c(v) + 1) a(v) for every context of training.

    Unknown words are never among a context's seen ones, so what they leave of P is at least that of the unknown.
    """
    spark = rows.sparkSession
    k = [f"k{r}" for r in range(1, KATZ + 1)]
    seen = rows.where(F.col("kind") == CONTEXT).select("key", "x", *k)
    if len(model.pairs):
        p = model.probability(model.count_of(model.pair_w, model.pair_counts))
        extra = [(int(a), float(b)) for a, b in zip(model.pair_v.view(np.int64), p, strict=True)]
        seen = seen.unionByName(spark.createDataFrame(extra, "key long, x double").select("key", "x", *(F.lit(0).cast("long").alias(c) for c in k)))
    left = F.lit(1.0)
    for r in range(1, KATZ + 1):
        left = left + F.sum(f"k{r}") * F.lit(r * (1 - d[r - 1]))
    return seen.groupBy("key").agg((F.log10(left) - F.log10(F.greatest(1 - F.sum("x"), F.lit(model.unknown)))).alias("weight"))


def score_documents(docs: DataFrame, fold: int = 2, folds: int = 7, per_shard: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs.

    Training takes the rows whose crc32(doc_id as text) mod folds is not fold. Tokens are the A-Z-lower-cased words of the whole
    text, then one end. score is log10 of the model's probability of the tokens; base_score that of add-one counts.
    A null or empty text has the end alone; a null doc_id counts as the empty text in the split and stays null; rows that repeat
    are counted and scored each; an empty table gives no rows; without training rows only unknown words exist.
    """
    rows, model, d = _evaluated(docs, fold, folds, per_shard, id_col, text_col)
    weights = _contexts(rows, model, d).withColumn("h", F.xxhash64("key"))
    unseen = rows.where(F.col("kind") == UNSEEN).groupBy("key", "row").agg(F.count(F.lit(1)).alias("times")).withColumn("h", F.xxhash64("key"))
    # the second key makes both sides exchange for the join itself, which lets AQE split a common context
    backed = unseen.join(weights, ["key", "h"], "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("weight", F.lit(0.0))).alias("w"))
    blocks = rows.where(F.col("kind").isin(BLOCK, SUMS)).select("kind", "key", "row", "packed")
    done = blocks.groupBy("key").applyInArrow(_add_up(d), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, x double, gain double")
    start = math.log10(model.docs + 1)
    return done.join(backed, "row", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("x") + F.lit(start) - F.col("n_tokens") * F.lit(math.log10(model.total + model.words + 1))).alias("base_score"),
        (F.col("gain") + F.coalesce("w", F.lit(0.0)) - F.col("x") - F.lit(start)).alias("score"),
    )


def model_tables(docs: DataFrame, fold: int = 2, folds: int = 7, per_shard: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The model as tables: pairs (v, w, log10_p) and contexts (v, log10_backoff), words being their 64-bit hashes.

    Pairs that are too common for one shard are left to the broadcast and not listed in the first.
    """
    rows, model, d = _evaluated(docs, fold, folds, per_shard, id_col, text_col, keep_pairs=True)
    pairs = rows.where(F.col("kind") == PAIR).select(F.col("key").alias("v"), F.col("row").alias("w"), F.col("k1").alias("r"))
    common = [(int(a), int(b)) for a, b in zip(model.pair_v.view(np.int64), model.pair_counts, strict=True)]
    more = docs.sparkSession.createDataFrame(common, "v long, r long")
    sizes = pairs.select("v", "r").unionByName(more).groupBy("v").agg(F.sum("r").alias("c"))
    factor = F.lit(1.0)
    for r in range(1, KATZ + 1):
        factor = F.when(F.col("r") == r, F.lit(d[r - 1])).otherwise(factor)
    listed = pairs.join(sizes, "v").select("v", "w", F.log10(factor * F.col("r") / (F.col("c") + 1)).alias("log10_p"))
    backoff = _contexts(rows, model, d).join(sizes, F.col("key") == F.col("v")).select("v", (F.col("weight") - F.log10(F.col("c") + 1)).alias("log10_backoff"))
    return listed, backoff
