"""Near-duplicates by similarity of whole word-shingle sets, proven for every link.

Pairs are proposed twice: by meet-in-the-middle balls around the SimHash fingerprints of the sets (simhash.ball_links), which
find what differs in next to nothing, and by MinHash bands for the rest, since texts at 0.8 differ by some ten bits of 64 and
balls of five bits would be millions of numbers.

Each distinct set of shingles has `bands` hashes of `rows` minima each, and sets that share one meet in a bucket. Two sets at
similarity s miss each other with chance (1 - s^rows)^bands, 3e-6 at 0.8 and less above. First every set of a bucket is compared
with the bucket's smallest, so a large group of copies costs a row each; then, in buckets that links have not joined whole, with
members that a hash picks for each bucket anew, which joins most of what is alike by other ways than the smallest; at last the
sets that are still apart meet by their rarest shingles (see `across`), unless sizes or parities prove them too different. Sets that
were proposed are built again and compared whole.

Parities: of the shingles that fall on each of 512 places, whether they are odd in number. A shingle that only one of two sets
has changes one place, so sets differ in at least as many shingles as their parities differ in places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldmerge.functions.session import stored
from fieldmerge.llm.common import one_of_each_part, over_batches, steps, texts_of
from fieldmerge.llm.simhash import ball_links, shingle_hashes, signature
from fieldmerge.operators.graph import connected_components

#: Shingles whose minima are taken at once.
_BLOCK = 2048
#: Longs that hold the parities of a set.
_PARITIES = [f"p{i}" for i in range(8)]
#: Rows that one copy of a set meets when sets are brought to pairs.
_SHARE = 64
#: Times that buckets which are not joined yet are compared with a member picked by hash.
_ROUNDS = 2
#: Places by which it is counted how often shingles were seen: 8 MB on the driver and in each task, whatever the corpus.
_PLACES = 1 << 20


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingle hashes in order; empty for a text without words."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_key(found: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.array(xxh64_intdigest(found.tobytes(), 7), np.uint64).astype(np.int64))


def parities(found: np.ndarray) -> list[int]:
    odd = np.bincount((found % np.uint64(64 * len(_PARITIES))).astype(np.int64), minlength=64 * len(_PARITIES)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 64, (n, 1), np.uint64), rng.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray, bands: int, rows: int, functions: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One signed 64-bit number for each band of minima; none for an empty set."""
    if not len(found):
        return []
    flip, factor = functions
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), _BLOCK):
        mixed = (found[k : k + _BLOCK] ^ flip) * factor
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=1))
    raw = least.tobytes()
    return np.array([xxh64_intdigest(raw[b * rows * 8 : (b + 1) * rows * 8], b) for b in range(bands)], np.uint64).astype(np.int64).tolist()


def _marked(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def make():
        functions = _functions(bands * rows)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes, buckets, odd, fps = [], [], [], [], []
            for x in batch.column(1).cast(pa.binary()):
                found = shingle_set(x.as_py(), words)
                keys.append(set_key(found))
                sizes.append(len(found))
                buckets.append(band_keys(found, bands, rows, functions))
                odd.append(parities(found))
                fps.append(signature(found))
            columns = [batch.column(0), batch.column(2), pa.array(fps, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(buckets, pa.list_(pa.int64()))]
            columns += [pa.array([x[i] for x in odd], pa.int64()) for i in range(len(_PARITIES))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "fp", "key", "n", "buckets", *_PARITIES])

        return apply

    return over_batches(texts.withColumn("h", F.xxhash64("text")), make, "doc_id long, h long, fp long, key long, n int, buckets array<long>, " + ", ".join(f"{p} long" for p in _PARITIES))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(x.as_py(), words) for x in batch.column(1).cast(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], ["key", "shingles"])

        return apply

    return over_batches(texts, make, "key long, shingles array<long>")


def _with_bucket(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with what found has for their bucket. The second key makes both sides exchange here, so that AQE may split a bucket."""
    found = found.withColumnRenamed("bucket", "fb").withColumn("fh", F.xxhash64("fb"))
    return members.withColumn("h", F.xxhash64("bucket")).join(found, (F.col("bucket") == F.col("fb")) & (F.col("h") == F.col("fh"))).drop("h", "fb", "fh")


def _with_set(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """pairs with the shingles of one side; a set that many pairs ask for is dealt in copies, one for each _SHARE of them."""
    asked = pairs.groupBy(F.col(side).alias("key")).agg(F.ceil(F.count(F.lit(1)) / _SHARE).cast("int").alias("copies"))
    many = asked.where("copies > 1")
    own = sets.join(many, "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    own = own.select(F.col("key").alias(side), "copy", F.col("shingles").alias(f"s_{side}"))
    # the second key makes both sides exchange in the join itself, so that AQE may split a set that many pairs ask for
    many = many.select(F.col("key").alias("__key"), F.xxhash64("key").alias("__hash"), "copies")
    dealt = pairs.join(many, (F.col(side) == F.col("__key")) & (F.xxhash64(side) == F.col("__hash")), "left").drop("__key", "__hash")
    return dealt.withColumn("copy", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1)).cast("long")).cast("int")).drop("copies").join(own, [side, "copy"]).drop("copy")


def _proven(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those pairs whose whole sets are similar enough."""
    both = _with_set(_with_set(pairs, sets, "a"), sets, "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(common / (F.size("s_a") + F.size("s_b") - common) >= similarity).select("a", "b")


def _rarest_first(sets: DataFrame, seen: np.ndarray, similarity: float) -> DataFrame:
    """(key, n, part, shingle, at) of the first shingles of each set, in the order of how often their place was seen; one more than may be alien to a set that is alike."""
    places = sets.sparkSession.sparkContext.broadcast(seen)

    def apply(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            keys, sizes, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            counts, first = [], []
            for x in batch.column(3):
                found = np.array(x.values, np.int64)
                upto = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
                order = np.lexsort((found, places.value[found % _PLACES]))[:upto]
                counts.append(len(order))
                first.append(found[order])
            n = np.array(counts, np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.repeat(keys, n), np.repeat(sizes, n), np.repeat(parts, n), np.concatenate(first), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "n", "part", "shingle", "at"])

    return sets.select("key", F.size("shingles").alias("n"), "part", "shingles").mapInArrow(apply, "key long, n int, part long, shingle long, at int")


def across(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, one, two): keys a < b and parts of all sets of open_ (key, part) of two parts that may be alike; none that are is missing.

    Sets that are alike share one of their rarest shingles, so sets meet by these and not by what all of a form have. If x is no larger
    than y, they have at least 2s/(1+s) of x and s of y in common at similarity s; so, in one order of all shingles, they share one
    among the first of x and of y which the rest is too small to make up for. What follows the first one shared bounds
    what is common as well. The order is by how often shingles of the same of _PLACES places were seen: any order is exact, this
    one is short where it matters.
    """
    sets = sets.join(open_.select("key", "part"), "key")
    counted = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(_PLACES)).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("f")).toArrow()
    seen = np.zeros(_PLACES, np.int64)
    seen[counted.column("place").to_numpy()] = counted.column("f").to_numpy()
    first = stored(_rarest_first(sets, seen, similarity), "rarest")
    two = first.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select(F.col("shingle").alias("shared"))
    # hashes as second keys: both sides exchange for the join itself, and AQE may split a shingle that many have
    met = first.withColumn("h", F.xxhash64("shingle")).join(two.withColumn("g", F.xxhash64("shared")), (F.col("shingle") == F.col("shared")) & (F.col("h") == F.col("g")), "left_semi")
    x, y = (met.select(*(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "part", "shingle", "h", "at"))) for s in "xy")
    share = F.lit(similarity / (1 + similarity))
    x = x.where(F.col("at_x") <= F.col("n_x") - F.ceil(2 * share * F.col("n_x") - 1e-9))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("key_x") < F.col("key_y")))
    rest = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= share * (F.col("n_x") + F.col("n_y")) - 1e-6
    on = (F.col("shingle_x") == F.col("shingle_y")) & (F.col("h_x") == F.col("h_y")) & (F.col("part_x") != F.col("part_y")) & smaller & rest & (F.col("n_x") >= similarity * F.col("n_y") - 1e-6)
    low = F.col("key_x") < F.col("key_y")
    pick = lambda c, name, least: F.when(low, F.col(f"{c}_{'x' if least else 'y'}")).otherwise(F.col(f"{c}_{'y' if least else 'x'}")).alias(name)
    return x.join(y, on).select(pick("key", "a", True), pick("key", "b", False), pick("part", "one", True), pick("part", "two", False)).distinct()


def _near_parities(pairs: DataFrame, odd: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b, one, two) whose sizes and parities allow the similarity; odd: key, size and parities, a row a key."""
    for side in "ab":
        own = odd.select(F.col("key").alias("__key"), F.xxhash64("key").alias("__hash"), *(F.col(p).alias(f"{p}_{side}") for p in ("n", *_PARITIES)))
        pairs = pairs.join(own, (F.col(side) == F.col("__key")) & (F.xxhash64(side) == F.col("__hash"))).drop("__key", "__hash")
    apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in _PARITIES), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    return pairs.where((total - apart) / (total + apart) >= similarity).select("a", "b", "one", "two")


def _split(members: DataFrame) -> DataFrame:
    """The buckets of members (bucket, part) that hold two parts."""
    return members.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")


def _picked(members: DataFrame, turn: int) -> DataFrame:
    """(a, b, one, two): each member (bucket, key, part) with one of its bucket, if that is of another part; which one, a hash decides by bucket and turn."""
    one = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "key", F.lit(turn)).alias("by"), "key", "part")).alias("pick"))
    pairs = _with_bucket(members, one).where(F.col("part") != F.col("pick.part"))
    ends = F.struct("key", "part"), F.struct("pick.key", "pick.part")
    low, high = F.least(*ends), F.greatest(*ends)
    return pairs.select(low["key"].alias("a"), high["key"].alias("b"), low["part"].alias("one"), high["part"].alias("two")).distinct()


def _joined(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(component, wider): parts that those pairs (a, b, one, two) which are proven link, with the name of what they form."""
    # what is proven joins whole components, so only their names meet here
    links = stored(_proven(pairs.select("a", "b"), sets, similarity).join(pairs, ["a", "b"]).select("one", "two").distinct(), "joined")
    return stored(connected_components(links, "one", "two").select(F.col("node").alias("component"), F.col("component").alias("wider")), "wider")


def _widened(parts: DataFrame, wider: DataFrame) -> DataFrame:
    """parts (key, component) under their wider names."""
    known = parts.join(wider, "component", "left").select("key", F.coalesce("wider", "component").alias("component"))
    # a set without a link so far is a component of its own name
    lone = wider.join(parts.select(F.col("key").alias("component")).distinct(), "component", "left_anti").select(F.col("component").alias("key"), F.col("wider").alias("component"))
    return known.unionByName(lone)


def _met_in_balls(sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b) keys of sets whose fingerprints are within two bits, by way of one set for each fingerprint; sizes that rule it out do not count."""
    one = sets.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("one"))
    links = ball_links(one.select("fp"))
    for end in ("src", "dst"):
        links = links.join(one.select(F.col("fp").alias(end), F.col("one").alias(f"{end}_one")), end)
    across = links.select("src_one.key", "src_one.n", F.col("dst_one.key").alias("other"), F.col("dst_one.n").alias("m"))
    within = sets.join(one, "fp").select("key", "n", F.col("one.key").alias("other"), F.col("one.n").alias("m"))
    both = across.unionByName(within).where("key <> other").where(F.least("n", "m") >= similarity * F.greatest("n", "m"))
    return both.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, h, part) per row: documents linked, directly or by others, at `similarity` or more of their shingle sets.

    component_id is the smallest doc_id reachable, itself included (null only if no doc_id of the component is known). Equal
    sets are linked, also the empty ones of null texts and texts without words; a text of fewer words than a shingle is
    one shingle. Rows that repeat each give a row; an empty table gives no rows. h is xxhash64 of the text; part, the smallest key
    of a set that is linked, names the component also where doc_ids repeat. Work after the sets is on distinct ones.
    """
    texts = texts_of(docs, id_col, text_col)
    marked = stored(_marked(texts, words, bands, rows), "sets")
    first = stored(marked.groupBy("key").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("n").alias("n")), "distinct")
    balls = stored(_met_in_balls(first, similarity), "balls")
    spread = marked.select("key", "n", F.explode("buckets").alias("bucket"))
    met = spread.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("least"), F.max("key").alias("most")).where("least.key <> most")
    members = stored(_with_bucket(spread.distinct(), met.select("bucket", F.col("least.key").alias("low"), F.col("least.n").alias("low_n"))), "buckets")

    asked = members.select("key").unionByName(balls.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = asked.join(first, "key").select("key", "low")
    ids = stored(wanted, "wanted")
    again = texts.join(ids.select(F.col("low").alias("wid")).distinct(), F.col("doc_id").eqNullSafe(F.col("wid")), "left_semi")
    sets = stored(_sets(again, words).join(ids.select("key"), "key", "left_semi").dropDuplicates(["key"]), "shingles")

    alike = lambda n, m: F.least(n, m) / F.greatest(n, m) >= similarity
    stars = members.where(F.col("key") != F.col("low")).where(alike(F.col("n"), F.col("low_n"))).select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    stars = stored(stars.unionByName(balls).distinct(), "stars")
    links = stored(_proven(stars, sets, similarity), "links")
    parts = stored(connected_components(links, "a", "b").withColumnRenamed("node", "key"), "linked")

    # buckets that still hold two components: their members meet one picked by hash, then across components, by rare shingles
    left = stored(members.select("bucket", "key", "n").join(parts, "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component"), "left")
    left = stored(_with_bucket(left, _split(left)), "split")
    odd = stored(marked.join(left.select("key"), "key", "left_semi").select("key", "n", *_PARITIES).dropDuplicates(["key"]), "odd")
    tried = stars
    for turn in range(_ROUNDS):
        met = stored(_near_parities(_picked(left, turn).join(tried, ["a", "b"], "left_anti"), odd, similarity), "picked")
        wider = _joined(met, sets, similarity)
        parts, tried = stored(_widened(parts, wider), "parts"), tried.unionByName(met.select("a", "b"))
        left = left.join(wider, F.col("part") == F.col("component"), "left").select("bucket", "key", "n", F.coalesce("wider", "part").alias("part"))
        left = stored(_with_bucket(left, _split(left)), "left")
    open_ = stored(left.select("key", "n", "part").distinct(), "open")
    cross = stored(across(open_, sets, similarity).join(tried, ["a", "b"], "left_anti"), "across")
    cross = stored(_near_parities(cross, odd, similarity), "alike")
    parts = _widened(parts, _joined(cross, sets, similarity))
    named = stored(first.drop("fp", "n").join(parts, "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component"), "parts")
    least = named.groupBy("part").agg(F.min("low").alias("component_id"))
    labels = stored(named.select("key", "part").join(least, "part").select("key", "component_id", "part"), "labels")
    return marked.join(labels, "key").select("doc_id", "component_id", "h", "part")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: the one with the smallest doc_id (see common.one_of_each_part)."""
    found = near_groups(docs, words, similarity, id_col=id_col, text_col=text_col)
    return one_of_each_part(docs, stored(found.select("doc_id", "h", "part"), "placed"), id_col, text_col)
