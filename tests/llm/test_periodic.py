"""Periodic runs against a walk over all periods, and the query against its own contract written plainly."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corpusforge.llm import periodic

DOCS = "doc_id long, text string, runs string, Start int, n_words int"


def period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w, least=24, times=3):
    out = set()
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, times * p) and period(w[i : j + p]) == p:
                out.add((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(r):
    """A random text of blocks that repeat, overlap and are broken here and there."""
    w, letters = [], r.choice((1, 2, 3, 50))
    for _ in range(r.randrange(1, 7)):
        block = [r.randrange(letters) for _ in range(r.randrange(1, 30))]
        w += (block * r.randrange(1, 12))[: r.randrange(1, 150)]
        if r.random() < 0.3:
            w[r.randrange(len(w))] = 99
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 37)
    r = random.Random(seed)
    for _ in range(80):
        w = sequence(r)
        assert list(map(tuple, periodic.runs_of(np.array(w)).tolist())) == brute(w), w


def test_other_thresholds():
    r = random.Random(7)
    for least, times in ((2, 2), (5, 2), (1, 4), (40, 3)):
        for _ in range(25):
            w = sequence(r)
            assert list(map(tuple, periodic.runs_of(np.array(w), least, times).tolist())) == brute(w, least, times), (w, least, times)
    with pytest.raises(ValueError):
        periodic.runs_of(np.array([1]), 24, 1)


def test_agreement():
    r = random.Random(3)
    w = [r.randrange(2) for _ in range(200)]
    names, top = periodic.Names(np.array(w)), periodic.Names(np.array(w)).top()
    i, j = np.array([(a, b) for a in range(0, 200, 7) for b in range(a + 1, 200, 5)]).T
    ahead = lambda a, b: next(k for k in range(201) if b + k >= 200 or w[a + k] != w[b + k])
    behind = lambda a, b: next(k for k in range(201) if a - k - 1 < 0 or w[a - k - 1] != w[b - k - 1])
    assert names.forward(i, j, top).tolist() == [ahead(a, b) for a, b in zip(i, j, strict=True)]
    assert names.backward(i, j, top).tolist() == [behind(a, b) for a, b in zip(i, j, strict=True)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if best[1] else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_digests(spark):
    r = random.Random(11)
    texts = [None, "", " \t\n", "one", "a " * 24, "a " * 23, "la la 😀\x00 " * 30, " ".join(str(i) for i in range(300))] + [" ".join(map(str, sequence(r))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a " * 24), (None, "b c " * 40), (5, None)]
    got = periodic.digests(spark.createDataFrame([(*x, "x", 1, 2) for x in rows], DOCS))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*x) for x in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    assert periodic.digests(spark.createDataFrame([], DOCS)).count() == 0


def test_detect(spark):
    text = "x " + "to be or not " * 10 + "end"
    long = "alpha beta gamma delta epsilon " * 40_000
    rows = {r["doc_id"]: r for r in periodic.detect(spark.createDataFrame([(1, text, "x", 1, 2), (2, long, "x", 1, 2), (3, None, "x", 1, 2)], DOCS)).collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(1, 40, 4)] and rows[1]["collapsed"] == "x to be or not end" and rows[1]["n_words"] == 42
    assert [tuple(x) for x in rows[2]["runs"]] == [(0, 200_000, 5)] and rows[2]["collapsed"] == "alpha beta gamma delta epsilon"
    assert rows[3]["runs"] == [] and rows[3]["collapsed"] == ""
