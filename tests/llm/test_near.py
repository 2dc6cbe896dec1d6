"""Near-duplicates of the pipeline against brute force over all pairs of whole shingle sets."""

import random

import corpus_pipeline
from fieldmerge.llm import near


def _brute(texts):
    """The smallest id of each group linked by pairs at 0.8 or more, shingles as word tuples."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in texts}
    for a in texts:
        for b in texts:
            one, two = sets[a], sets[b]
            if a < b and (len(one & two) >= 0.8 * len(one | two)):
                x, y = part[a], part[b]
                part = {i: min(x, y) if p in (x, y) else p for i, p in part.items()}
    return part


def _texts():
    """Groups of one text with 1 to 12 words of 120 changed, so that many pairs lie about 0.8, some linked only by a third."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = ["", "  ", "one two", "One two", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for k in rng.sample(range(120), rng.randint(1, 12)):
                copy[k] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_equal_brute_force(spark):
    texts = _texts()
    want = _brute(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near.near_groups(rows).collect()} == want
    assert len(set(want.values())) > 20
    kept = corpus_pipeline.keep_one_near_copy(spark, rows, "")
    assert kept.columns == rows.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in want.items() if i == p}


def test_null_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (4, None), (5, ""), (6, "z")], "doc_id long, text string")
    found = sorted(map(tuple, near.near_groups(rows).select("doc_id", "component_id").collect()), key=repr)
    assert found == sorted([(None, 3), (3, 3), (3, 3), (4, 4), (5, 4), (6, 6)], key=repr)
    assert near.near_groups(rows.where("false")).count() == 0
    # one row of each group, though a doc_id repeats or is missing
    assert sorted(r["doc_id"] for r in near.drop_near_duplicates(rows).collect()) == [3, 4, 6]


def test_repeated_doc_ids_lose_no_unrelated_row(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    rows = [(3, a, "x"), (5, a.upper(), "x"), (5, b, "y"), (5, b, "z"), (None, b, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(2)
    assert sorted(map(tuple, near.drop_near_duplicates(df).collect())) == [(3, a, "x"), (5, b, "y")]


def test_texts_of_one_form_do_not_all_meet(spark):
    """600 fillings of a form, all alike by some 0.57 to 0.77: no pair is proposed but those that are near 0.8, and none of these is missing."""
    rng = random.Random(9)
    sets, want = {}, set()
    form = rng.sample(range(10**9), 160)
    for i in range(600):
        own = rng.sample(range(10**9, 2 * 10**9), rng.choice([24, 40, 60]))
        # every tenth is a copy of the one before with up to 14 shingles changed
        sets[i] = sets[i - 1][: -rng.randint(1, 14)] + own[:5] if i % 10 == 9 else form + own
    for a in sets:
        for b in range(a):
            one, two = set(sets[a]), set(sets[b])
            if len(one & two) >= 0.8 * len(one | two):
                want.add((b, a))
    assert len(want) >= 60
    rows = spark.createDataFrame([(i, sorted(set(s))) for i, s in sets.items()], "key long, shingles array<long>").repartition(3)
    open_ = rows.selectExpr("key", "size(shingles) n", "key part")
    got = [(r["a"], r["b"]) for r in near.across(open_, rows, 0.8).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(got) < 2 * len(want)
