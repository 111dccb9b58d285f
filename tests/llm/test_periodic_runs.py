"""Operator 13 against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from netvigil.llm import periodic_runs
from netvigil.llm.common import table
from tests.llm.test_operators import SF, empty_docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(s):
    """Every period up to a quarter of the sequence, every maximal stretch of it."""
    names = {w: i for i, w in enumerate(dict.fromkeys(s))}
    s, out = np.array([names[w] for w in s], np.int64), []
    for q in range(1, len(s) // 4 + 1):
        same = np.concatenate([[False], s[q:] == s[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = j - i + q
            if length >= max(6, 4 * q) and not any(a <= i and a + m >= i + length and p < q for a, m, p in out):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def digest(doc_id, text):
    words = sequence(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 20])
        s = [rng.randint(0, kinds) for _ in range(n)]
        if rng.random() < 0.6 and n > 6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 4))
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
            if rng.random() < 0.4:
                s[rng.randrange(n)] = 99
        got = [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(np.array(s, np.int64)))]
        assert got == brute_runs(s)


def test_long_periods_and_fibonacci():
    for period in (1, 2, 3, 64, 65, 127, 128, 1000, 2499, 2500):
        s = np.concatenate([[-1, -2], np.arange(10_000) % period, [-3]])
        assert list(zip(*periodic_runs.find_runs(s))) == [(2, 10_000, period)]
    s = np.concatenate([np.arange(9_999) % 2500])  # one word short of four periods
    assert len(periodic_runs.find_runs(s)[0]) == 0
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert [*zip(*periodic_runs.find_runs(np.frombuffer(b.encode(), np.uint8).astype(np.int64)))] == brute_runs(b)


def test_successor_matches_sorting():
    rng = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 400):
        values = rng.integers(0, 200, n)
        tree = periodic_runs.WaveletTree(values, 8)
        lo = rng.integers(0, n, 300)
        hi = np.minimum(n, lo + rng.integers(0, 40, 300))
        x = rng.integers(0, 220, 300)
        want = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(lo, hi, x)]
        assert tree.successor(lo, hi, x).tolist() == want


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = periodic_runs.op13_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == digest(r.doc_id, texts[r.doc_id])
    assert sum(r.n_runs for r in rows) > 10


def test_runs_of_odd_tables(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame(
        [(20, "b b b b b b", None, None, None, "x", 1, 0), (21, "é a é a é a é a z", None, None, None, "x", 1, 0),
         (22, "q " + "a b c " * 30_000 + "a", None, None, None, "x", 1, 0)], odd_docs(spark).schema))
    out = periodic_runs.periodic_runs(docs)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed, r.n_words))
    assert sum(map(len, got.values())) == 18
    assert got[20] == [([(0, 6, 1)], "b", 6)]
    assert got[21] == [([(0, 8, 2)], "é a z", 9)]
    assert got[22] == [([(1, 90_001, 3)], "q a b c", 90_002)]
    assert got[6] == got[7] == got[8] == [([], "", 0)]
    assert got[12] == [([(0, 200, 1)], "x", 200)]
    assert len(got[2]) == 2 and got[2][0] == got[2][1] == got[1][0] and len(got[None]) == 2
    assert periodic_runs.periodic_runs(empty_docs(spark)).count() == 0
    assert periodic_runs.with_planted_runs(empty_docs(spark)).count() == 0
    for r in periodic_runs.with_planted_runs(odd_docs(spark)).collect():
        if r.doc_id is not None and r.doc_id != 2:
            text = {x.doc_id: x.text for x in odd_docs(spark).collect()}[r.doc_id]
            assert WORD.findall(r.text or "") == sequence(r.doc_id, text)
