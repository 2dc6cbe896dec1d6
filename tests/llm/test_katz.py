"""The Katz model against a dictionary-based one, and its sums."""

import collections
import math
import re
import zlib

import pytest

from fieldmerge.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    words = {d: WORD.findall((x or "").translate(LOWER)) + [None] for d, x in texts.items()}
    train = [w for d, w in words.items() if not held[d]]
    c = collections.Counter(t for w in train for t in w)
    big = collections.Counter(p for w in train for p in zip(["^", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    d1 = katz.discounts([sum(x == r for x in c.values()) for r in range(1, 7)])
    d2 = katz.discounts([sum(x == r for x in big.values()) for r in range(1, 7)])
    cut = lambda d, r: d[r - 1] * r if r <= 5 else r
    freed = n - sum(cut(d1, x) for x in c.values())
    p1 = lambda w: cut(d1, c[w]) / n if c[w] else freed / n
    context = collections.Counter()
    seen_mass, seen_p1 = collections.Counter(), collections.Counter()
    for (a, b), r in big.items():
        context[a] += r
        seen_mass[a] += cut(d2, r)
        seen_p1[a] += p1(b)

    def p2(a, b):
        if big[a, b]:
            return cut(d2, big[a, b]) / (context[a] + 1)
        return (1 - seen_mass[a] / (context[a] + 1)) / (1 - seen_p1[a]) * p1(b) if a in context else p1(b)

    for a in list(context)[:30]:  # every context sums to 1 over known words and the unknown one
        assert abs(sum(p2(a, b) for b in c) + p2(a, "?unknown?") - 1) < 1e-9
    out = {}
    for d, w in words.items():
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)
        out[d] = (held[d], len(w), sum(c[t] > 0 for t in w), n, base, sum(math.log10(p2(a, b)) for a, b in zip(["^", *w], w, strict=False)))
    return out


def compare(spark, texts, **how):
    docs = spark.createDataFrame([(d, x, 1.0) for d, x in texts.items()], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r for r in katz.score_documents(docs, **how).collect()}
    want = brute(texts)
    assert set(got) == set(want)
    for d, (held, n, known, total, base, score) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def texts():
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    out = {d: " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for d in range(200)}
    out |= {200: None, 201: "", 202: "of The of the\tOF the\n of the", 203: "été ÉTÉ naïve \x0b x", 204: "never seen before " * 50}
    return out


def test_one_shard(spark, texts):
    compare(spark, texts)


def test_many_shards_with_common_words_and_pairs(spark, texts):
    compare(spark, texts | {d: "of the " * 40 for d in range(300, 330)}, per_shard=400)




def test_held_out_text_is_likelier_than_by_single_words(spark):
    texts = {d: "the quick brown fox jumps over the lazy dog again" for d in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert all(r["score"] > r["base_score"] for r in katz.score_documents(docs).where("held_out").collect())


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(empty).count() == 0
    rows = katz.score_documents(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and sum(r["doc_id"] is None for r in rows) == 2


def test_model_tables(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, backoff = katz.model_tables(docs)
    mass = pairs.selectExpr("v", "pow(10D, log10_p) p").groupBy("v").sum("p").collect()
    assert mass and all(0 < r[1] < 1 for r in mass)
    assert backoff.count() == len(mass)
