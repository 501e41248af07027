"""Maximal repetitions (runs) in word sequences, by online dyadic square catching.

Every completed block of 2, 4, 8, ... words sets up a catcher. A word that is appended completes
one substring of each such length, and that substring meets the catchers whose distance is a period
of their level: a block of s words watches periods from 2 s to under 4 s, so a position has two
catchers a level. The first period of any square of such a period holds a whole aligned
block, so no square escapes. A match opens a stretch of equal words one period apart, which is
extended word by word in both directions; a stretch as long as its period is a square, and squares
of one period merge into a run. Periods under 8 are watched by comparing words directly.

``append`` takes any number of words, one or a whole document, and works through them with arrays;
blocks are named by 64-bit hashes, but what is reported was compared word by word. Tasks feed many
documents to one catcher, a word of its own between any two, so short documents share the work.

Defined results: NULL text is the empty text; a NULL key counts as the empty string where
a hash of it is asked for; rows that agree in all are judged each; a document without words or runs
has no longest run (NULLs) and keeps its words; other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.text import WORD, text_of

LEAST = 12  # words of the shortest run
DIRECT = 8  # smaller periods are compared directly
GROUP_WORDS = 1 << 16

_WORDS = re.compile(WORD)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


class Catchers:
    """Runs of a growing sequence of whole numbers (equal numbers for equal words)."""

    def __init__(self, least: int = LEAST):
        self.least = least
        self.size = 0
        self.words = np.zeros(1024, np.int64)
        # Hashes of the completed aligned blocks of each length.
        self.blocks: dict[int, np.ndarray] = {}
        # Stretches of words equal to those a period before, that reach the end: period to first word.
        self.open: dict[int, int] = {}
        self.last: dict[int, int] = {}  # period to the end of its last stretch that was looked at
        self.found: list[tuple[int, int, int]] = []
        self.spans: set[tuple[int, int]] = set()

    def append(self, words: np.ndarray, longest: int | None = None) -> list[tuple[int, int]]:
        """Take more words; the (first word, period) of every square first seen with them.

        ``longest`` is a length that no run passes, if the caller knows one.
        """
        old, new = self.size, self.size + len(words)
        if new > len(self.words):
            self.words = np.concatenate([self.words[:old], np.zeros(max(new, 2 * old) - old, np.int64)])
        self.words[old:new] = words
        self.size = new
        squares: list[tuple[int, int]] = []
        for period, first in list(self.open.items()):
            self._extend(period, first, old - period, squares, known=True)
        limit = min(longest or new, new) // 2
        for period in range(1, min(DIRECT, limit + 1)):
            for at in self._direct(period, old):
                self._catch(period, at, at + 1, squares)
        size = 4
        while 2 * size <= limit:
            self._level(size, old, squares)
            size *= 2
        return squares

    def runs(self) -> np.ndarray:
        """(start, length, period) of every run up to here, by period."""
        ended = [(first, self.size - first, period) for period, first in sorted(self.open.items())]
        kept = list(self.found)
        spans = set(self.spans)
        for start, length, period in ended:
            if length >= max(self.least, 2 * period) and (start, start + length) not in spans:
                spans.add((start, start + length))
                kept.append((start, length, period))
        # The smallest period of a span comes first.
        least: dict[tuple[int, int], int] = {}
        for start, length, period in kept:
            least[start, length] = min(period, least.get((start, length), period))
        rows = [(start, length, period) for (start, length), period in least.items()]
        return np.array(sorted(rows), np.int64).reshape(-1, 3)

    # ---- one period

    def _needed(self, period: int) -> int:
        """Words equal to those a period before that make a square of sufficient length."""
        return max(period, self.least - period)

    def _direct(self, period: int, old: int) -> np.ndarray:
        need = self._needed(period)
        base = max(0, old - period - need)
        words = self.words[base : self.size]
        if len(words) < period + need:
            return np.zeros(0, np.int64)
        ends = np.flatnonzero(words[period:] != words[:-period])
        starts = np.concatenate([[0], ends + 1])
        lengths = np.concatenate([ends, [len(words) - period]]) - starts
        return base + starts[lengths >= need]

    def _catch(self, period: int, at: int, end: int, squares: list[tuple[int, int]]) -> None:
        """Words ``at`` to ``end`` equal those a period later: find the whole stretch."""
        if period in self.open and at >= self.open[period] or at < self.last.get(period, 0):
            return
        first = at - self._equal(at, at + period, -1)
        self._extend(period, first, end, squares)

    def _extend(self, period: int, first: int, end: int, squares: list[tuple[int, int]], known: bool = False) -> None:
        need, before = self._needed(period), end - first
        end += self._equal(end, end + period, 1)
        self.last[period] = end
        if end - first >= need and not (known and before >= need):
            squares.append((first, period))
        if end + period == self.size:
            self.open[period] = first
            return
        self.open.pop(period, None)
        span = first, end + period
        # A span of a smaller period, which divides this one, has been found under that one.
        if end - first >= need and span not in self.spans:
            self.spans.add(span)
            self.found.append((first, span[1] - first, period))

    def _equal(self, a: int, b: int, way: int) -> int:
        """Number of equal words from ``a`` and ``b`` (``a`` < ``b``) on, or before them for -1."""
        words, count, step = self.words, 0, 16
        limit = self.size - b if way > 0 else a
        while count < limit:
            step = min(2 * step, limit - count)
            if way > 0:
                differ = words[a + count : a + count + step] != words[b + count : b + count + step]
            else:
                low = count + step
                differ = (words[a - low : a - count] != words[b - low : b - count])[::-1]
            place = int(differ.argmax()) if len(differ) else 0
            if len(differ) and differ[place]:
                return count + place
            count += step
        return count

    # ---- one level of catchers

    def _hashes(self, size: int, start: int) -> np.ndarray:
        """Hashes of the substrings of ``size`` words from ``start`` on."""
        h = self.words[start : self.size].view(np.uint64) * _MIX
        step = 1
        while step < size:
            h = _mixed(h[:-step] * _MIX + h[step:]) if len(h) > step else h[:0]
            step *= 2
        return h

    def _level(self, size: int, old: int, squares: list[tuple[int, int]]) -> None:
        done = len(self.blocks.get(size, ())) * size
        low = min(done, max(0, old - size + 1))
        h = self._hashes(size, low)
        if not len(h):
            return
        ready = h[done - low :: size]
        self.blocks[size] = np.concatenate([self.blocks[size], ready]) if done else ready.copy()
        blocks = self.blocks[size]
        begin = max(2 * size, old - size + 1)
        places = np.arange(begin, low + len(h))
        if not len(places):
            return
        newest = (places - 2 * size) // size
        hits = []
        for back in (0, 1):
            block = newest - back
            fit = (block >= 0) & (blocks[block] == h[begin - low :])
            if fit.any():
                hits.append(np.stack([block[fit] * size, places[fit]]))
        if not hits:
            return
        at, copy = np.concatenate(hits, axis=1)
        for judge in (self._news, self._worth_while):
            keep = judge(size, at, copy)
            at, copy = at[keep], copy[keep]
        for i in np.lexsort((at, copy - at)).tolist():
            self._catch(int(copy[i] - at[i]), int(at[i]), int(at[i]) + size, squares)

    def _worth_while(self, size: int, at: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """A square needs as much again beside the block, so half a block on one side; or it may still come.

        Up to 16 words of that half are looked at.
        """
        half = min(size // 2, 16)
        steps = np.arange(half)
        words = self.words
        open_end = copy + size + half > self.size
        after = np.minimum(copy + size, self.size - half)
        right = (words[(at + size)[:, None] + steps] == words[after[:, None] + steps]).all(1) | open_end
        room = at >= half
        before = np.maximum(at - half, 0)
        left = room & (words[before[:, None] + steps] == words[(before + copy - at)[:, None] + steps]).all(1)
        return right | left

    def _news(self, size: int, at: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """All matches but those that a run of a period dividing theirs explains: they add nothing to it."""
        news = np.ones(len(at), bool)
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        opened = [(first, self.size - first, p) for p, first in self.open.items() if self.size - first >= 2 * p]
        for start, length, period in [*self.found, *opened]:
            a, b = np.searchsorted(ordered, [start, start + length])
            some = order[a:b]
            if len(some):
                inside = (copy[some] + size <= start + length) & ((copy[some] - at[some]) % period == 0)
                news[some[inside]] = False
        return news


def runs_of(sequences: Sequence[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) rows of each sequence; numbers must be zero or more."""
    parts = [part for i, s in enumerate(sequences) for part in (s, np.array([-1 - i]))]
    starts = np.cumsum([0] + [len(s) + 1 for s in sequences])
    catchers = Catchers(least)
    if parts:
        catchers.append(np.concatenate(parts), max(map(len, sequences)))
    rows = catchers.runs()
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(sequences) + 1))
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


def collapsed(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those in no run, and each run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change)[:n] == 0


Rewrite = Callable[[object, list[str]], list[str]]


def with_loops(key: object, words: list[str]) -> list[str]:
    """The contract's made-up loops: a tenth of the documents repeat a stretch to their end."""
    h = zlib.crc32(("" if key is None else str(key)).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _judge(keys: list, texts: list[list[str]], least: int) -> Iterator[tuple]:
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in texts]
    for key, words, rows in zip(keys, texts, runs_of(coded, least)):
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist())
        best = (None,) * 4
        kept: Sequence[str] = words
        if len(rows):
            start, length, period = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]].tolist()
            best = start, length, period, 1000 * length // period
            kept = [words[i] for i in np.flatnonzero(collapsed(len(words), rows)).tolist()]
        text = " ".join(kept)
        yield key, len(rows), *best, hashlib.sha256(lines.encode()).hexdigest(), text


_COLUMNS = (
    "{key} {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, text string"
)


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, rewrite: Rewrite | None = None
) -> DataFrame:
    """Runs of every document and its text without their repetitions.

    Columns: the key in its own type, n_runs, start, length, period, exponent_milli of the longest
    run, runs_sha256, text (the words that stay, joined by one space).
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(f"`{key}`").alias("key"), text_of(F.col(f"`{text}`")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            group: list[list[str]] = []
            begin = total = 0
            for i, value in enumerate(batch.column("text")):
                words = _WORDS.findall(value.as_py())
                group.append(rewrite(keys[i], words) if rewrite else words)
                total += len(words)
                if total >= GROUP_WORDS or i + 1 == len(keys):
                    columns = list(zip(*_judge(keys[begin : i + 1], group, least)))
                    types = [batch.schema.field("key").type, *[pa.int64()] * 5, pa.string(), pa.string()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                    names = ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "text"]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    group, begin, total = [], i + 1, 0

    return narrow.mapInArrow(run, _COLUMNS.format(key="key", kind=kind)).withColumnRenamed("key", key)
