"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pitspark.llm import periodic


def brute(words):
    """Every (start, length, period): for each period all stretches that no neighbour extends."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(12, 2 * q):
                found.setdefault((at, length), q)  # periods come in ascending order
            at = end
    return sorted((s, m, q) for (s, m), q in found.items())


def collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def hard_texts():
    rng = random.Random(7)
    texts = [[], ["a"], list("a" * 40), list("ab" * 30), list(fibonacci(300)), list("abaababaababaab" * 4)]
    for letters in (2, 3, 4):
        texts += [[chr(97 + rng.randrange(letters)) for _ in range(rng.randrange(200))] for _ in range(150)]
    for _ in range(200):  # runs within runs, and broken ones
        words = []
        while len(words) < 150:
            piece = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
            piece = piece * rng.randrange(1, 7)
            words += piece[: rng.randrange(1, len(piece) + 1)]
        texts.append(words)
        twice = list(words[: rng.randrange(1, 80)])
        texts.append(twice * 3)
    return texts


def test_runs_equal_brute_force():
    texts = hard_texts()
    for some in (texts, *[[t] for t in texts[:100]]):
        _, runs, collapsed = periodic._work([" ".join(t).encode() for t in some])
        for words, got, text in zip(some, runs, collapsed):
            want = brute(words)
            assert [tuple(r) for r in got.tolist()] == want
            assert text.decode() == collapse(words, want)


def test_long_runs_stay_cheap():
    words = np.zeros(400_000, dtype=np.int64)
    assert [x.tolist() for x in periodic.find_runs(words, np.array([400_000]))] == [[0], [400_000], [1]]
    words = np.tile(np.arange(1000), 400)
    assert [x.tolist() for x in periodic.find_runs(words, np.array([400_000]))] == [[0], [400_000], [1000]]


def words_of(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def expected(doc_id, text):
    words = [w.decode() for w in words_of(text)]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(words, runs)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for i in range(300)]
    rows += [(i, "  ".join(f"w{rng.randrange(5000)}" for _ in range(400)) + "\n") for i in range(300, 360)]
    rows += [(None, "x y " * 9), (None, None), (7, "x y " * 9), (7, "x y " * 9), (400, None), (401, ""), (402, " \t\x0b\x0c\r\n"), (403, "é ü é b " * 7)]
    path = tmp_path_factory.mktemp("periodic")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'r' AS runs", "2 AS __text").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_query_equals_brute_force(spark, folder):
    path, rows = folder
    got = periodic.query(spark, path)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(expected(*r) for r in rows)


def test_odd_rows(spark, tricky, empty):
    got = {(r.doc_id, r.n_words): r for r in periodic.periodic_runs(tricky).collect()}
    assert got[(32, 2)].collapsed == "x" * 700_000 + " end"
    assert got[(26, 70)].runs[0][:3] == (0, 40, 1) and got[(20, 0)].collapsed == "" and got[(None, 0)].runs == []
    assert sum(1 for r in periodic.periodic_runs(tricky).collect()) == tricky.count()
    assert periodic.periodic_runs(empty).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "p q " * 6)], "key string, body string")
    assert [tuple(r) for r in periodic.periodic_runs(docs, "key", "body").collect()] == [("a", 12, [(0, 12, 2)], "p q")]
