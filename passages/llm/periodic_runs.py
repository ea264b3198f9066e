"""Periodic run detection: stretches of a text that repeat a few words, or a few hundred, at least three times in a row.

A text's words become small integers. At each dyadic scale the text is cut into blocks; a block is compared with the words that
follow it by the sum of squared differences at every distance, and that sum, a convolution, is worked out exactly with
number-theoretic transforms. Where it is zero the block recurs, and its distance seeds the extension to a maximal run.

Why no run is lost: a run of period q and length 3q or more holds an aligned block of length l <= q < 2l that recurs inside it at
distance q; shorter periods than the least block of 8 words hold such a block because a run has 24 words or more.

Every row is worked on by itself, in one narrow pass: texts are dealt out as the input is, no group or shuffle is involved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import WORD, ship

#: Words of a run at least, and of the least block. A run of 24 words with a period below 8 holds an aligned block of 8 and its copy.
MIN_LENGTH, MIN_BLOCK = 24, 8

#: Primes below 2^31 whose multiplicative groups hold roots of unity of order 2^25 at least, and a primitive root of each.
PRIMES = ((2013265921, 31), (469762049, 3), (2113929217, 5), (167772161, 3))

#: Numbers that one transform works on at most, but for a single block longer than that: bounds the memory beside the text.
TRANSFORM_ITEMS = 1 << 20

#: A run: number of its first word, words, period.
Run = tuple[int, int, int]


@lru_cache(maxsize=64)
def _roots(prime: int, generator: int, n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n/2 - 1 of a root of unity of order n, or of its inverse."""
    root = pow(generator, (prime - 1) // n, prime)
    root = pow(root, prime - 2, prime) if inverse else root
    out = np.ones(1, np.int64)
    while len(out) < n // 2:  # doubles the powers known so far
        out = np.concatenate([out, out * pow(root, len(out), prime) % prime])
    return out


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The number-theoretic transform of each row, in bit-reversed order; row length a power of two."""
    out, n = rows % prime, rows.shape[1]
    while n > 1:
        pair = out.reshape(len(rows), -1, 2, n // 2)
        total, rest = pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]
        pair[:, :, 0] = total % prime
        pair[:, :, 1] = rest * _roots(prime, generator, n, False) % prime
        n //= 2
    return out


def inverse(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The rows whose transforms these are."""
    out, n = rows.copy(), 2
    while n <= rows.shape[1]:
        pair = out.reshape(len(rows), -1, 2, n // 2)
        second = pair[:, :, 1] * _roots(prime, generator, n, True) % prime
        pair[:, :, 1] = (pair[:, :, 0] - second) % prime
        pair[:, :, 0] = (pair[:, :, 0] + second) % prime
        n *= 2
    return out * pow(rows.shape[1], prime - 2, prime) % prime


def zero_mismatches(codes: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (start, distance), distance from 1 to 2 * block - 1, where the block at start equals the words that far behind it.

    Sums of squared differences are compared with zero modulo as many primes as their product needs to exceed the largest
    sum there can be: the comparison is exact.
    """
    n, width, size = len(codes), 3 * block, 4 * block
    windows = np.concatenate([codes, np.zeros(width, np.int64)])[starts[:, None] + np.arange(width)]
    same, product = np.ones((len(starts), 2 * block), bool), 1
    for prime, generator in PRIMES:
        if product > block * int(codes.max()) ** 2:
            break
        product *= prime
        left, right = np.zeros((len(starts), size), np.int64), np.zeros((len(starts), size), np.int64)
        right[:, :width] = windows % prime
        left[:, :block] = right[:, block - 1 :: -1]
        squares = np.zeros((len(starts), width + 1), np.int64)
        np.cumsum(right[:, :width] ** 2 % prime, axis=1, out=squares[:, 1:])
        products = inverse(transform(left, prime, generator) * transform(right, prime, generator) % prime, prime, generator)
        sums = squares[:, block : block + 1] + squares[:, block : 3 * block] - squares[:, : 2 * block] - 2 * products[:, block - 1 : 3 * block - 1]
        same &= sums % prime == 0
    same[:, 0] = False
    same &= starts[:, None] + block + np.arange(2 * block) <= n  # beyond the text there are only zeros
    row, distance = np.nonzero(same)
    return starts[row], distance


class Factors:
    """Numbers for the stretches of 1, 2, 4 ... words, equal for equal stretches; how far two places agree takes one look a level."""

    def __init__(self, codes: np.ndarray):
        self.levels = [codes]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pair = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(pair, return_inverse=True)[1])
        return self.levels[k]

    def agree(self, at: np.ndarray, distance: np.ndarray, forward: bool) -> np.ndarray:
        """Words from `at` on (or before it) that equal those a distance behind them: up the levels while they agree, then down again."""
        n, done, climbing, k = len(self.levels[0]), np.zeros(len(at), np.int64), np.ones(len(at), bool), 0

        def step(k: int, which: np.ndarray) -> np.ndarray:
            start = at + done if forward else at - done - (1 << k)
            fits = which & (start >= 0) & (start + distance + (1 << k) <= n)
            out = np.zeros(len(at), bool)
            if fits.any():
                ids = self.level(k)
                out[fits] = ids[start[fits]] == ids[start[fits] + distance[fits]]
            done[out] += 1 << k
            return out

        while climbing.any():
            climbing = step(k, climbing)
            k += 1
        for j in range(k - 1, -1, -1):
            step(j, np.ones(len(at), bool))
        return done


def find_runs_of(words: list[str]) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    n = len(words)
    if n < MIN_LENGTH:
        return []
    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) > n - 2 * MIN_LENGTH // 3:  # two thirds of a run are words that were there before
        return []
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n, np.int64)  # words to the next occurrence of a word
    again = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    found: dict[tuple[int, int], int] = {}  # period by start and end
    factors, block, farthest = Factors(codes), MIN_BLOCK, _largest(gap, MIN_BLOCK)
    while block == MIN_BLOCK or 3 * block <= n:
        alive = farthest < 2 * block  # a block recurs within the window only if each of its words does
        for (start, end), period in found.items():
            if period <= block:  # a block whose window such a run fills can only meet multiples of its period there
                alive[-(-start // block) : (end if end == n else max(-1, end - 3 * block)) // block + 1] = False
        starts = np.flatnonzero(alive) * block
        some = max(1, TRANSFORM_ITEMS // (4 * block))
        for i in range(0, len(starts), some):
            _extend(factors, *zero_mismatches(codes, starts[i : i + some], block), block, found)
        block *= 2
        farthest = _largest(farthest, 2)
    return sorted((start, end - start, period) for (start, end), period in found.items())


def _largest(values: np.ndarray, n: int) -> np.ndarray:
    """The largest of every n values; a shorter rest is left out."""
    return values[: len(values) // n * n].reshape(-1, n).max(axis=1)


def _extend(factors: Factors, starts: np.ndarray, distances: np.ndarray, block: int, found: dict[tuple[int, int], int]) -> None:
    """Extends seeds to maximal runs and adds the new ones to `found`."""
    order = np.lexsort((starts, distances))
    starts, distances = starts[order], distances[order]
    keep = np.ones(len(starts), bool)  # a block right behind another at the same distance is in the same stretch
    keep[1:] = (starts[1:] != starts[:-1] + block) | (distances[1:] != distances[:-1])
    if block > MIN_BLOCK:
        keep &= distances >= block
    starts, distances = starts[keep], distances[keep]
    before, after = factors.agree(starts, distances, False), factors.agree(starts + block, distances, True)
    length = before + block + after + distances
    for i in np.flatnonzero(length >= np.maximum(MIN_LENGTH, 3 * distances)):
        start, period = int(starts[i] - before[i]), int(distances[i])
        end = start + int(length[i])
        if not any(s <= start and end <= e and period % p == 0 for (s, e), p in found.items()):
            found[start, end] = period


def collapse(words: list[str], runs: list[Run]) -> str:
    """The words joined by one blank, of each run only its first period."""
    if not runs:
        return " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0))


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, runs array<struct<start,length,period>>, collapsed string), one per input row.

    A run is a stretch of consecutive words with smallest period q, words q apart being equal, of max(24, 3q) words or more, that no
    neighbouring word extends with that period; runs are sorted by start, then period. `collapsed` is the text's words joined by
    one blank, without those that a run holds after its first q words. Null and blank texts have no words and no runs; repeated and
    null ids are rows like any other; texts of any length are worked on as a whole. Other columns are ignored.
    """
    ship(docs.sparkSession)
    find_words = re.compile(WORD).findall
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = find_words(text or "")
                got = find_runs_of(words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                texts.append(collapse(words, got))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)

