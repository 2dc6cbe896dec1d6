"""Secrets that stand twice, in key blocks, before their name, or in assignments without a digit."""

import random
import re
import string
import time

from fieldmerge.llm import secrets

CHARS = string.ascii_letters + string.digits + "+/"


def _key(n, seed, chars=CHARS):
    return "".join(random.Random(seed).choices(chars, k=n))


def _covered(text, value):
    """How many places of value lie within spans."""
    spans, at, n = secrets.secret_spans(text), text.find(value), 0
    while at >= 0:
        n += any(a <= at and at + len(value) <= b for a, _, b in spans)
        at = text.find(value, at + 1)
    return n


def test_both_copies_of_a_key():
    key = _key(31, 1) + "7"
    text = f"use the bearer {key} here. " + "some words go by. " * 8 + f"again the bearer {key} is sent. " + "and on it goes, far from any of it, " * 4 + f"logged {key}."
    assert _covered(text, key) == 3
    assert key not in secrets.redacted(text, secrets.secret_spans(text), "[SECRET]")


def test_whole_key_block():
    lines = [_key(64, k) for k in range(5, 12)] + [_key(20, 13)]
    for tail in ("\n-----END RSA PRIVATE KEY-----\nbye", "\n\nplain text goes on here."):
        text = "see\n-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + tail
        clean = secrets.redacted(text, secrets.secret_spans(text), "[SECRET]")
        assert not any(x in clean for x in lines) and clean.endswith(tail.split("\n")[-1])
    assert secrets.secret_spans("-----BEGIN PRIVATE KEY-----\nyour key here\n-----END PRIVATE KEY-----") == []


def test_name_after_value_and_no_digit():
    key = _key(23, 3) + "5"
    assert _covered(f"{key} is the access_key of this host", key) == 1
    word = _key(10, 4, string.ascii_letters)
    assert _covered(f"passphrase = '{word}'", word) == 1
    assert secrets.secret_spans("the author: wrote about authentication and a garden of secrets unseen") == []


def test_planted_keys_in_the_corpus(spark):
    """Keys of several kinds, planted in texts of the corpus: at least nine of ten are found, and hardly any name that the corpus uses."""
    rng = random.Random(31)
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in corpus.where("length(text) between 300 and 3000").orderBy("doc_id").limit(240).collect()]
    alphabets = (CHARS, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.hexdigits[:16].upper() + "-")
    ways = ("the bearer {} was sent", "{} is the access_key here", "passphrase = '{}'", "private_key: {}", "client credential {} for the host")
    harmless = ("connection_string_name_2", "application/json-v1-utf8-2", "token_refresh_interval_30s", "release-2024-01-15-stable", "user_name_and_password_12", "https/localhost/8080/index2")
    rows, keys = [(1000 + i, f"{texts[i]} see {harmless[i % len(harmless)]} there") for i in range(60)], {}
    for i, text in enumerate(texts):
        key = _key(rng.randint(16, 48), i, alphabets[i % 4]) + str(i % 10)
        value = key if i % 2 == 0 else harmless[i // 2 % len(harmless)]
        at = text.find(" ", len(text) // 2)
        rows.append((i, text[:at] + " " + (ways[i // 2 % 5] if i % 2 == 0 else ways[(0, 1, 4)[i // 2 % 3]]).format(value) + " " + text[at:]))
        keys[i] = value
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = secrets.learnt_identifiers(docs)
    assert all(x.encode() in known for x in harmless) and len(known) <= 8_192
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, known=known).collect()}
    covered = {i: any(s["start"] <= dict(rows)[i].find(v) and s["end"] >= dict(rows)[i].find(v) + len(v) for s in found[i]) for i, v in keys.items()}
    hit, false = [covered[i] for i in keys if i % 2 == 0], [covered[i] for i in keys if i % 2]
    assert sum(hit) >= 0.9 * len(hit) and sum(false) <= 0.05 * len(false), (sum(hit), sum(false), len(hit))


def test_a_secret_in_many_documents_is_not_learnt(spark):
    key, other = _key(24, 9, string.ascii_letters), _key(28, 10) + "5"
    rows = [(i, f"some common_words stand here and passphrase = '{key}' in copy, bearer {other} too") for i in range(50)] + [(None, None), (99, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = secrets.learnt_identifiers(docs)
    assert b"common_words" in known and key.encode() not in known and other.encode() not in known
    found = secrets.find_secrets(docs, known=known).where("doc_id < 50").collect()
    assert all(len(r["spans"]) == 2 for r in found)
    assert secrets.learnt_identifiers(docs.where("false")) == b""


def test_long_texts_take_linear_time():
    texts = [
        "token=abcdefgh12345x\n" * 50_000,
        "secret_" * 150_000,
        "".join(f"key is token {i * 7919:09d}aBc{i * 31:x}Zq\n" for i in range(8_000)),
        "my_secret_key=" * 70_000,
        "passwd" * 170_000,
    ]
    for text in texts:
        began = time.time()
        spans = secrets.secret_spans(text)
        assert time.time() - began < 10
        assert all(a < b <= len(text) for a, _, b in spans)
    assert len(secrets.secret_spans(texts[0])) == 50_000
    assert {(a, b) for a, k, b in secrets.secret_spans(texts[2]) if k == 3} == {m.span() for m in re.finditer(r"[0-9]{9}aBc[0-9a-f]+Zq", texts[2])}
