"""Periodic runs against brute force, the contract's digests, and awkward rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF

from passages import llm
from passages.llm import periodic_runs
from passages.llm.registry import with_periodic_tail

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if n >= max(24, 3 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def planted(r):
    k = r.choice([1, 2, 3, 30])
    words = [str(r.randrange(k)) for _ in range(r.randint(0, 160))]
    for _ in range(r.randint(0, 3)):
        at, pattern = r.randint(0, len(words)), [str(r.randrange(r.choice([2, 50]))) for _ in range(r.randint(1, 40))]
        words[at:at] = [pattern[i % len(pattern)] for i in range(int(len(pattern) * r.uniform(2, 6)))]
    return words


@pytest.mark.parametrize("items", [64, 1 << 20])
def test_runs_against_brute_force(monkeypatch, items):
    monkeypatch.setattr(periodic_runs, "TRANSFORM_ITEMS", items)
    r, seen = random.Random(3), 0
    for _ in range(250):
        words = planted(r)
        want = plain_runs(words)
        assert periodic_runs.find_runs_of(words) == want
        seen += len(want)
    assert seen > 100


def test_borders():
    exact = [str(i) for i in range(8)] * 3
    assert periodic_runs.find_runs_of(exact) == [(0, 24, 8)]
    assert periodic_runs.find_runs_of(exact[:-1]) == []
    long = [str(i) for i in range(500)] * 3
    assert periodic_runs.find_runs_of(long) == [(0, 1500, 500)] and periodic_runs.find_runs_of(["x", *long[1:]]) == []
    assert periodic_runs.find_runs_of(["a"] * 24 + ["b"] + ["a"] * 23) == [(0, 24, 1)]
    assert periodic_runs.find_runs_of(["a", "b"] * 12 + ["a", "a"] * 12) == plain_runs(["a", "b"] * 12 + ["a", "a"] * 12)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for prime, generator in periodic_runs.PRIMES:
        rows = rng.integers(0, prime, (3, 16))
        assert (periodic_runs.inverse(periodic_runs.transform(rows, prime, generator), prime, generator) == rows).all()
        one, two = rng.integers(0, 1000, (1, 8)), rng.integers(0, 1000, (1, 8))
        product = periodic_runs.inverse(*[periodic_runs.transform(np.pad(one, ((0, 0), (0, 8))), prime, generator) * periodic_runs.transform(np.pad(two, ((0, 0), (0, 8))), prime, generator) % prime], prime, generator)
        assert (product[0, :15] == np.convolve(one[0], two[0]) % prime).all()


def test_several_primes():
    """Codes so large that one prime can't tell a sum of squares from zero: 31 * 469762049 is a multiple of two of them apart."""
    codes = np.array([0] * 8 + [2013265921] * 8 + [0] * 8, np.int64)
    starts, distances = periodic_runs.zero_mismatches(codes, np.array([0]), 8)
    assert list(zip(starts.tolist(), distances.tolist(), strict=True)) == []
    codes = np.array([5, 2013265921 * 3] * 12, np.int64)
    _, distances = periodic_runs.zero_mismatches(codes, np.array([0]), 8)
    assert distances.tolist() == [2, 4, 6, 8, 10, 12, 14]


def test_query(spark):
    found = {r.doc_id: r for r in llm.queries()["op12_periodic_runs"](spark, SF).collect()}
    docs, runs = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    assert len(found) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        words, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = plain_runs(words) if n < 3000 else periodic_runs.find_runs_of(words)
        r = found[d.doc_id]
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None)) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert r.n_runs == len(want) and r.runs_sha256 == sha("".join(f"{s},{x},{q}\n" for s, x, q in want))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        runs += len(want)
    assert runs > 10


def test_awkward(spark):
    rows = [(1, None, "x"), (None, "a " * 30, None), (2, "", "y"), (2, "", "y"), (3, " \n\t ", None), (4, "ü 日本 " * 40, "z"), (5, "word " * 200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = {(r.doc_id, r.n_words): [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(docs).collect()}
    assert found == {(1, 0): [], (None, 30): [(0, 30, 1)], (2, 0): [], (3, 0): [], (4, 80): [(0, 80, 2)], (5, 200_000): [(0, 200_000, 1)]}
    assert periodic_runs.find_runs(docs).count() == 7 and periodic_runs.find_runs(docs.limit(0)).count() == 0
    assert {r.collapsed for r in periodic_runs.find_runs(docs).collect()} == {"", "a", "ü 日本", "word"}
    assert with_periodic_tail(docs).count() == 7
