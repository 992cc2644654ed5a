"""Periodic runs of words, found online by dyadic square catching."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barledger.llm.common import WORD_BYTES, row_mapper, text_bytes

#: Least words of a run, and least repeats of its period.
LEAST_WORDS, LEAST_REPEATS = 24, 3
#: Words appended at once; the arrays of one step grow with this, not with the text.
STEP = 1 << 15
#: Hashes are sums of word numbers times powers of ``_BASE``; they only propose, words decide.
_PRIME, _BASE = (1 << 31) - 1, 1_000_003
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class _Powers:
    """Powers of the base and of its inverse, grown on demand and shared by all texts of a worker."""

    up = down = np.ones(1, dtype=np.int64)

    @classmethod
    def reach(cls, n: int) -> None:
        inverse = pow(_BASE, -1, _PRIME)
        while len(cls.up) < n:
            m = len(cls.up)
            cls.up = np.concatenate((cls.up, cls.up * pow(_BASE, m, _PRIME) % _PRIME))
            cls.down = np.concatenate((cls.down, cls.down * pow(inverse, m, _PRIME) % _PRIME))


class SquareCatcher:
    """Squares of a growing sequence of word numbers, merged into maximal stretches of one period.

    Level ``B = 1, 2, 4, ...`` has a catcher for every completed block of ``B`` words at a multiple of
    ``B``, for the periods ``2B-1 .. 4B-2``: the first half of such a square holds a whole block, and
    the block returns one period later. Each appended word ends a suffix of ``B`` words at every
    level, and just two catchers of the level have it in reach. A suffix equal to a block opens a
    stretch of that period; it is extended to the left at once and to the right as words come, and
    it is reported as soon as it is a square. Periods are covered once, and a suffix inside a known
    stretch of a period up to ``B`` adds nothing new, so ``n`` words cost ``n log n`` comparisons and a
    binary descent per hit. ``append`` takes any number of words; results do not depend on the cuts.
    """

    def __init__(self) -> None:
        self.n = 0
        self._words = np.zeros(64, dtype=np.int64)
        self._sums = np.zeros(65, dtype=np.int64)
        self.squares: dict[tuple[int, int], int] = {}  # (period, start) -> end, two periods at least
        self._open: dict[tuple[int, int], int] = {}  # stretches that reach the last word, squares or not yet

    def append(self, words: np.ndarray) -> None:
        before = self.n
        self._store(words)
        self._advance(before)
        block = 1
        while 3 * block - 1 <= self.n:
            self._catch(block, before)
            block *= 2

    def runs(self, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period, of the words so far; the period is the smallest of the stretch."""
        smallest: dict[tuple[int, int], int] = {}
        for (period, start), end in self.squares.items():
            key = (start, end)
            smallest[key] = min(period, smallest.get(key, period))
        found = ((s, e - s, p) for (s, e), p in smallest.items() if e - s >= max(least_words, least_repeats * p))
        return sorted(found, key=lambda run: (run[0], run[2]))

    def _store(self, words: np.ndarray) -> None:
        end = self.n + len(words)
        if end > len(self._words):
            room = max(end, 2 * len(self._words))
            self._words = np.concatenate((self._words[:self.n], np.zeros(room - self.n, dtype=np.int64)))
            self._sums = np.concatenate((self._sums[:self.n + 1], np.zeros(room - self.n, dtype=np.int64)))
        _Powers.reach(end + 1)
        self._words[self.n:end] = words
        added = np.cumsum((words + 1) * _Powers.up[self.n:end] % _PRIME)
        self._sums[self.n + 1:end + 1] = (self._sums[self.n] + added) % _PRIME
        self.n = end

    def _hash(self, start: np.ndarray, size) -> np.ndarray:
        return (self._sums[start + size] - self._sums[start]) % _PRIME * _Powers.down[start] % _PRIME

    def _hashes(self, first: int, last: int, size: int, step: int = 1) -> np.ndarray:
        """Hashes of the words from ``first``, ``first + step``, ... up to ``last`` on; of single words, the words."""
        if size == 1:
            return self._words[first:last + 1:step]
        sums = self._sums[first + size:last + size + 1:step] - self._sums[first:last + 1:step]
        return sums % _PRIME * _Powers.down[first:last + 1:step] % _PRIME

    def _reach(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, left: bool = False) -> np.ndarray:
        """Number of equal words from ``x`` and ``y`` on (before them for ``left``), ``limit`` at most: doubling, then halving."""
        got = np.zeros(len(x), dtype=np.int64)

        def step(rows: np.ndarray, size: int) -> np.ndarray:
            rows = rows[got[rows] + size <= limit[rows]]
            shift = -got[rows] - size if left else got[rows]
            rows = rows[self._hash(x[rows] + shift, size) == self._hash(y[rows] + shift, size)]
            got[rows] += size
            return rows

        size, alive = 1, np.arange(len(x))
        while len(alive):
            alive = step(alive, size)
            size *= 2
        size //= 2
        every = np.arange(len(x))
        while size:
            step(every, size)
            size //= 2
        return got

    def _advance(self, before: int) -> None:
        """Carry the open stretches over the words after ``before``."""
        if not self._open or before == self.n:
            return
        keys = list(self._open)
        period = np.array([k[0] for k in keys], dtype=np.int64)
        y = np.full(len(keys), before, dtype=np.int64)
        ends = before + self._reach(y - period, y, self.n - y)
        self._open = {}
        for (p, start), end in zip(keys, ends.tolist()):
            self._keep(p, start, end)

    def _keep(self, period: int, start: int, end: int) -> None:
        if end == self.n:
            self._open[period, start] = end
        if end - start < 2 * period:
            return
        same = self._words[start:end - period] == self._words[start + period:end]
        if same.all():
            self.squares[period, start] = end
            return
        # a hash met by chance: keep what the words confirm
        borders = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))).reshape(-1, 2)
        for lo, hi in borders.tolist():
            if hi - lo >= period:
                self.squares[period, start + lo] = start + hi + period

    def _catch(self, block: int, before: int) -> None:
        """Compare the suffixes of ``block`` words that end after ``before`` with their two catchers."""
        first, last = max(2 * block - 1, before - block + 1), self.n - block
        if first > last:
            return
        own = self._hashes(first, last, block)
        near = (np.arange(first, last + 1) - (2 * block - 1)) // block  # number of the nearer catcher
        lowest = max(0, int(near[0]) - 1)
        keys = self._hashes(lowest * block, int(near[-1]) * block, block, block)
        for at in (near, near - 1):
            skip = int(at[0] < 0) and int(np.searchsorted(at, 0))
            hit = np.flatnonzero(keys[at[skip:] - lowest] == own[skip:]) + skip
            if len(hit):
                self._extend(at[hit] * block, hit + first, block)

    def _extend(self, at: np.ndarray, suffix: np.ndarray, block: int) -> None:
        w, last = self._words, self.n
        after = suffix + block
        longer = (after == last) | (w[at + block] == w[np.minimum(after, last - 1)])
        longer |= (at > 0) & (w[np.maximum(at - 1, 0)] == w[suffix - 1])
        fresh = ((suffix - at <= block) | longer) & ~self._covered(at, after, block)
        at, suffix, after = at[fresh], suffix[fresh], after[fresh]
        if not len(at):
            return
        period = suffix - at
        start = at - self._reach(at, suffix, at, left=True)
        end = after + self._reach(at + block, after, last - after)
        useful = (end - start >= 2 * period) | (end == last)
        for p, s, e in np.unique(np.stack((period, start, end), 1)[useful], axis=0).tolist():
            if self.squares.get((p, s), -1) < e and self._open.get((p, s), -1) < e:
                self._keep(p, s, e)

    def _covered(self, start: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
        """Whether a known stretch with a period up to ``block`` holds the words from ``start`` to ``end``."""
        known = sorted((s, e) for (p, s), e in self.squares.items() if p <= block)
        if not known:
            return np.zeros(len(start), dtype=bool)
        starts, ends = np.array(known, dtype=np.int64).T
        reach = np.maximum.accumulate(ends)
        i = np.searchsorted(starts, start, "right") - 1
        return (i >= 0) & (reach[np.maximum(i, 0)] >= end)


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs of a list of words, appended ``STEP`` at a time."""
    if len(words) < LEAST_WORDS:
        return []
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    numbers = np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words))
    catcher = SquareCatcher()
    for i in range(0, len(numbers), STEP):
        catcher.append(numbers[i:i + STEP])
    return catcher.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that some run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: all runs by start and period, and the text without their repeats.

    A run is a longest stretch of words with smallest period ``q`` and at least ``max(24, 3 q)`` words;
    runs of several periods may overlap. Words are runs of characters other than ASCII white space;
    ``collapsed`` joins what stays by one space. ``rewrite`` gets the id and the words of a row and may
    change them first. Row by row without a shuffle: null and empty texts have no words, no runs and
    an empty ``collapsed``; a null id is kept; repeated rows give repeated rows; other columns are not
    read; an empty table gives no rows.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        counts, found, kept = [], [], []
        for doc_id, text in zip(ids, text_bytes(batch.column(1))):
            words = WORD_BYTES.findall(text)
            if rewrite is not None:
                words = rewrite(doc_id, words)
            runs = word_runs(words)
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            kept.append(b" ".join(collapsed(words, runs)))
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(run)), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    return rows.mapInArrow(row_mapper(one), FOUND)
