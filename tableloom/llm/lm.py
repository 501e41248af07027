"""Language-model scoring with an Elias-Fano bigram trie, counted and queried by Spark.

The model. Words get ids by falling count, so a short table of (first id, count) steps gives any
word's count; it has at most sqrt(2 N) entries for N training tokens, which bounds what is sent to
every task. A text is its words and one end token, which also stands before the first word.
The probability of a word after another is (c(u, w) + M p(w)) / (c(u) + M) with
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

The trie. The pairs seen in training are dealt into shards by their first word; a frequent first
word is dealt on by the second one, so it fills no shard alone. A shard holds two levels:
first words with pointers, and successors with quantised log-probabilities. Pointers and first words
are monotone; successors become so when each first word's are raised by its place times the
vocabulary's size. All three are Elias-Fano coded, and a successor is searched in its first word's
range alone.

The job. Texts are read in blocks of about 8 MB. A block numbers its words itself and asks the
vocabulary for their ids, then sends its distinct pairs, with their training counts, to the
shards as compressed arrays. A shard builds its trie from all counts, answers every block with one
byte per pair, and hands on the trie itself, so a model can be kept and asked again. Each step's
result is written to the shared folder.

Defined results: NULL text is the empty text, one end token; a NULL key counts as the empty text
in the held-out rule; without training documents every word is unknown. Up to 2**32 distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.compact import squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from tableloom.llm.text import WORD, lower_ascii, text_of
from tableloom.operators.ranking import with_position
from tableloom.staging import stage

END = " "  # no word has a space
BLOCK_CHARS = 8 << 20
SHARD_TOKENS = 1_500_000
BACKOFF = 20.0  # M above
CODES = 255
FIND = 1 << 16


def _give_back() -> None:
    """Hand freed memory back to the system, as workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# For a byte and a rank, the place of its set bit of that rank.
_BIT_OF = np.array([[*[i for i in range(8) if byte >> i & 1], *[0] * 8][:8] for byte in range(256)], np.int64)


class EliasFano:
    """Whole numbers that never fall, in about 2 + log2(largest / n) bits each.

    ``lower`` holds the low bits of each number, rounded up to whole bytes so that they are cut
    and joined without shifting; ``upper`` has one set bit per number at (number >> low bits) +
    its place. ``marks`` are the set bits before every 512 bits.
    """

    BLOCK = 512

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, marks: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.marks = n, low, lower, upper, marks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        largest = int(values[-1]) if n else 0
        low = -(-max(0, (largest // max(n, 1)).bit_length() - 1) // 8) * 8
        shift = np.uint64(low)
        lower = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : low // 8].ravel()
        places = (values >> shift).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) + 1) if n else 0
        upper = np.zeros(-(-size // cls.BLOCK) * cls.BLOCK, np.uint8)
        upper[places] = 1
        ones = upper.reshape(-1, cls.BLOCK).sum(axis=1, dtype=np.int64)
        marks = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        return cls(n, low, lower, np.packbits(upper, bitorder="little"), marks)

    def _low_bits(self, first: int, count: int) -> np.ndarray:
        width = self.low // 8
        wide = np.zeros((count, 8), np.uint8)
        wide[:, :width] = self.lower[first * width : (first + count) * width].reshape(count, width)
        return wide.view("<u8").ravel()

    def get(self, place: int) -> int:
        """One number, by select on the upper bits."""
        block = int(np.searchsorted(self.marks, place, side="right")) - 1
        size = self.BLOCK // 8
        bits = np.unpackbits(self.upper[block * size : (block + 1) * size], bitorder="little")
        high = block * self.BLOCK + int(np.flatnonzero(bits)[place - int(self.marks[block])]) - place
        return high << self.low | int(self._low_bits(place, 1)[0])

    def successor(self, value: int, start: int, end: int) -> int:
        """The first place in [start, end) whose number is at least ``value``; ``end`` if none is."""
        while start < end:
            middle = (start + end) // 2
            if self.get(middle) < value:
                start = middle + 1
            else:
                end = middle
        return start

    def _select(self, ranks: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Places in the upper bits of the ones, or zeros, of these ranks: by blocks, words, bytes."""
        marks = np.arange(len(self.marks)) * self.BLOCK - self.marks if zeros else self.marks
        block = np.searchsorted(marks, ranks, side="right") - 1
        words = self.upper.view("<u8").reshape(-1, self.BLOCK // 64)[block]
        if zeros:
            words = ~words
        rest, rows = ranks - marks[block], np.arange(len(ranks))
        before = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int16)
        word = (before <= rest[:, None]).sum(axis=1)
        rest -= np.where(word, before[rows, word - 1], 0)
        octets = words[rows, word].view(np.uint8).reshape(-1, 8)
        before = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int16)
        octet = (before <= rest[:, None]).sum(axis=1)
        rest -= np.where(octet, before[rows, octet - 1], 0)
        return block * self.BLOCK + word * 64 + octet * 8 + _BIT_OF[octets[rows, octet], rest]

    def get_many(self, places: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        high = (self._select(places) - places).astype(np.uint64) << np.uint64(self.low)
        return high | self._low_at(places)

    def _low_at(self, places: np.ndarray) -> np.ndarray:
        width = self.low // 8
        wide = np.zeros((len(places), 8), np.uint8)
        if width:
            wide[:, :width] = self.lower.reshape(-1, width)[places]
        return wide.view("<u8").ravel()

    def successors(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each value the first place in its range [start, end) whose number is at least the value, or ``end``.

        The zeros of the upper bits bound the numbers that share the value's high bits; among those
        the low bits are searched by halving. No number outside is looked at.
        """
        high = (values >> np.uint64(self.low)).astype(np.int64)
        top = int(self.get_many(np.array([self.n - 1]))[0] >> np.uint64(self.low)) if self.n else -1
        low, most = np.where(high > top, self.n, 0), np.full(len(values), self.n)
        # There are as many zeros as the greatest high part; the one before a part and the one behind it.
        before, behind = np.flatnonzero((high > 0) & (high <= top)), np.flatnonzero(high < top)
        low[before] = self._select(high[before] - 1, True) - (high[before] - 1)
        most[behind] = self._select(high[behind], True) - high[behind]
        low, most = np.clip(low, start, end), np.clip(most, start, end)
        wanted = values & np.uint64((1 << self.low) - 1)
        open_ = np.flatnonzero(low < most)
        while len(open_):
            middle = (low[open_] + most[open_]) >> 1
            less = self._low_at(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            most[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < most[open_]]
        return low

    def decode(self) -> np.ndarray:
        """All numbers, in one pass over both parts."""
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        out = np.empty(self.n, np.uint64)
        step = 1 << 18
        for first in range(0, self.n, step):
            count = min(step, self.n - first)
            out[first : first + count] = high[first : first + count] | self._low_bits(first, count)
        return out


class Shard(NamedTuple):
    """Two trie levels: first words with pointers; raised successors with codes."""

    words: EliasFano
    pointers: EliasFano
    successors: EliasFano
    codes: np.ndarray
    book: np.ndarray
    span: int  # what each place raises successors by

    @classmethod
    def build(cls, pairs: np.ndarray, logs: np.ndarray, span: int) -> Shard:
        """From sorted (u << 32 | w) and the log-probability of each."""
        first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        words, starts = np.unique(first, return_index=True)
        place = np.repeat(np.arange(len(words), dtype=np.uint64), np.diff([*starts, len(pairs)]))
        # Even steps between the least and the greatest, each read back as the mean of its values.
        least, most = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        codes = np.minimum((logs - least) * (CODES / max(most - least, 1e-9)), CODES - 1).astype(np.uint8)
        book = np.bincount(codes, logs, minlength=CODES) / np.maximum(np.bincount(codes, minlength=CODES), 1)
        book = book.astype(np.float32)
        return cls(
            EliasFano.build(words),
            EliasFano.build(np.append(starts, len(pairs))),
            EliasFano.build(place * np.uint64(span) + second),
            codes,
            book,
            span,
        )

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """For a batch of pairs: the code plus one, 0 where a pair was not seen.

        Each different first word is searched once; its pointers bound the successor search of its pairs.
        Everything is read from the coded levels, ``FIND`` pairs at a time.
        """
        out = np.zeros(len(pairs), np.uint8)
        if not self.words.n or not len(pairs):
            return out
        words, which = np.unique(pairs >> np.uint64(32), return_inverse=True)
        none = np.zeros(len(words), np.int64)
        place = self.words.successors(words, none, none + self.words.n)
        there = place < self.words.n
        there[there] = self.words.get_many(place[there]) == words[there]
        start, end = none.copy(), none.copy()
        start[there] = self.pointers.get_many(place[there]).astype(np.int64)
        end[there] = self.pointers.get_many(place[there] + 1).astype(np.int64)
        for first in range(0, len(pairs), FIND):
            mine = which[first : first + FIND]
            known = np.flatnonzero(there[mine])
            mine = mine[known]
            second = pairs[first : first + FIND][known] & np.uint64(0xFFFFFFFF)
            raised = place[mine].astype(np.uint64) * np.uint64(self.span) + second
            at = self.successors.successors(raised, start[mine], end[mine])
            hit = at < end[mine]
            hit[hit] = self.successors.get_many(at[hit]) == raised[hit]
            out[first + known[hit]] = self.codes[at[hit]] + np.uint8(1)
        return out

    def find_one(self, first: int, second: int) -> int:
        """The same for one pair, by successor search on the coded levels."""
        place = self.words.successor(first, 0, self.words.n)
        if place == self.words.n or self.words.get(place) != first:
            return 0
        start, end = self.pointers.get(place), self.pointers.get(place + 1)
        raised = place * self.span + second
        at = self.successors.successor(raised, start, end)
        return int(self.codes[at]) + 1 if at < end and self.successors.get(at) == raised else 0

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"codes": self.codes, "book": self.book}
        for name in ("words", "pointers", "successors"):
            level = getattr(self, name)
            out |= {
                f"{name}_head": np.array([level.n, level.low], np.int64),
                f"{name}_lower": level.lower,
                f"{name}_upper": level.upper,
                f"{name}_marks": level.marks,
            }
        return out

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], span: int) -> Shard:
        """From arrays in memory, or mapped from files."""
        levels = [
            EliasFano(*map(int, arrays[f"{n}_head"]), *[arrays[f"{n}_{part}"] for part in ("lower", "upper", "marks")])
            for n in ("words", "pointers", "successors")
        ]
        return cls(*levels, arrays["codes"], arrays["book"], span)


class Counts(NamedTuple):
    """Counts by id as steps, and the totals."""

    first: np.ndarray  # first id of each step
    count: np.ndarray
    tokens: int  # N
    distinct: int  # V

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.first, ids.astype(np.int64), side="right") - 1]

    def log_word(self, ids: np.ndarray) -> np.ndarray:
        return np.log10((self.of(ids) + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _mixed(values: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of SplitMix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(pairs: np.ndarray, counts: Counts, shards: int) -> np.ndarray:
    """By first word; one with more than a quarter of a shard's tokens also by second word."""
    first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    ways = np.minimum(1 + counts.of(first) * 4 * shards // max(counts.tokens, 1), 4 * shards).astype(np.uint64)
    sub = _mixed(second + np.uint64(1)) % ways
    return (_mixed(first * np.uint64(0x9E3779B97F4A7C15) + sub) % np.uint64(shards)).astype(np.int64)


# Blocks of texts


class _Index(dict):
    """Numbers what it is asked for first."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


_BLOCK = "block long, keys array<long>, held array<boolean>, sizes array<long>, tokens binary, words array<string>, counts array<long>"


def text_blocks(docs: DataFrame, key: str, text: str, held_out: Column, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: its documents, its tokens by numbers of its own, its words and training counts."""
    narrow = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), text_of(F.col(f"`{text}`")).alias("text"), held_out.alias("held")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from pyspark import TaskContext

        find = re.compile(WORD).findall
        number, size = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        held: list[bool] = []
        parts: list[np.ndarray] = []
        index = _Index({END: 0})

        def block() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts])
            tokens = np.concatenate(parts)
            train = tokens[np.repeat(~np.array(held), sizes)]
            counts = np.bincount(train, minlength=len(index))
            columns = [[number], [keys], [held], [sizes], [squeeze(tokens)], [list(index)], [counts]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            names = [part.split()[0] for part in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for k, t, h in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("held").to_pylist()):
                words = find(lower_ascii(t.as_py()))
                words.append(END)
                parts.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                keys.append(k)
                held.append(h)
                size += len(words)
                if size * 6 >= chars:
                    yield block()
                    number, size = number + 1, 0
                    keys, held, parts, index = [], [], [], _Index({END: 0})
                    _give_back()
        if keys:
            yield block()
            keys, held, parts, index = [], [], [], _Index({END: 0})
            _give_back()

    return narrow.mapInArrow(run, _BLOCK)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """(u << 32 | w) at every place; before a text's first word stands the end token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes)[:-1]] = end
    before[:1] = end
    return before.astype(np.uint64) << np.uint64(32) | tokens


def _by_shard(unique: np.ndarray, counts: Counts, shards: int) -> list[tuple[int, np.ndarray]]:
    """Places of the block's distinct pairs, for every shard it asks."""
    shard = shard_of(unique, counts, shards)
    order = np.argsort(shard, kind="stable")
    asked, starts = np.unique(shard[order], return_index=True)
    return list(zip(asked.tolist(), np.split(order, starts[1:])))


def _counted(asked: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of all blocks, where each asked one is among them, and their training counts."""
    distinct, which = np.unique(asked, return_inverse=True)
    return distinct, which, np.bincount(which, seen, len(distinct)).astype(np.int64)


_CODED = "block long, keys array<long>, held array<boolean>, sizes array<long>, tokens binary, end long"


def _with_ids(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks with the vocabulary's ids in place of their own numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = unsqueeze(row.column("tokens")[0].as_py(), np.uint32)
                pairs = row.column("ids")[0].values
                table = np.empty(len(pairs), np.uint32)
                table[pairs.field("place").to_numpy()] = pairs.field("id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[row.column(n) for n in ("block", "keys", "held", "sizes")],
                        pa.array([squeeze(table[own])], pa.binary()),
                        pa.array([int(table[0])], pa.int64()),
                    ],
                    ["block", "keys", "held", "sizes", "tokens", "end"],
                )

    return blocks.join(ids, "block").select("block", "keys", "held", "sizes", "tokens", "ids").mapInArrow(run, _CODED)


class Model(NamedTuple):
    """``table``: (kind, block, shard, data, book): 'trie' rows are the model, 'answer' rows its replies."""

    counts: Counts
    shards: int
    span: int
    table: DataFrame


def count_words(blocks: DataFrame) -> tuple[DataFrame, Counts, int]:
    """The vocabulary (word, id), the counts, and the number of ids."""
    words = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    totals = words.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c"))
    vocabulary = with_position(totals, [F.col("c").desc(), F.col("word")], "id", unique=True)
    vocabulary = stage(vocabulary.withColumn("id", F.col("id") - 1), "vocabulary")
    # Distinct counts: at most sqrt(2 N) of them, as they add up to no more than N.
    steps = vocabulary.groupBy("c").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    counts = np.array([r["c"] for r in steps] or [0], np.int64)
    sizes = np.array([r["n"] for r in steps] or [0], np.int64)
    first = np.array([r["first"] for r in steps] or [0], np.int64)
    return vocabulary, Counts(first, counts, int((counts * sizes).sum()), int(sizes[counts > 0].sum())), int(sizes.sum())


def train_and_answer(coded: DataFrame, counts: Counts, span: int, backoff: float = BACKOFF) -> Model:
    """Build every shard's trie from the blocks' training pairs and answer all their pairs."""
    shards = max(8, -(-counts.tokens // SHARD_TOKENS))
    if span > 1 << 32:
        raise ValueError("more than 2**32 distinct words")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tokens = unsqueeze(row.column("tokens")[0].as_py(), np.uint32)
                sizes = row.column("sizes")[0].values.to_numpy()
                held = row.column("held")[0].values.to_numpy(zero_copy_only=False)
                pairs = _pairs(tokens, sizes, row.column("end")[0].as_py())
                train = np.repeat(~held, sizes)
                unique, inverse = np.unique(pairs, return_inverse=True)
                seen = np.bincount(inverse[train], minlength=len(unique)).astype(np.uint32)
                del tokens, pairs, train, inverse
                parts = _by_shard(unique, counts, shards)
                block = row.column("block")[0].as_py()
                for few in range(0, len(parts), 64):
                    some = parts[few : few + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s for s, _ in some], pa.int64()),
                            pa.array([block] * len(some), pa.int64()),
                            pa.array([squeeze_sorted(unique[at]) for _, at in some], pa.binary()),
                            pa.array([squeeze(seen[at]) for _, at in some], pa.binary()),
                        ],
                        ["shard", "block", "pairs", "seen"],
                    )
                del unique, seen, parts
                _give_back()

    def serve(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [unsqueeze_sorted(d.as_py()) for d in table.column("pairs")]
        seen = [unsqueeze(d.as_py(), np.uint32) for d in table.column("seen")]
        sizes = [len(a) for a in asked]
        distinct, which, sums = _counted(np.concatenate(asked), np.concatenate(seen))
        del asked, seen
        pairs, sums = distinct[sums > 0], sums[sums > 0]
        first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        logs = np.log10((sums + backoff * 10 ** counts.log_word(second)) / (counts.of(first) + backoff))
        trie = Shard.build(pairs, logs, span)
        arrays = trie.arrays()
        blocks = table.column("block").to_pylist()
        codes = np.split(trie.find(distinct)[which], np.cumsum(sizes)[:-1])
        rows = [("answer", b, shard, squeeze(c), trie.book.tolist()) for b, c in zip(blocks, codes)]
        rows += [(f"trie:{name}:{a.dtype}", -1, shard, a.tobytes(), []) for name, a in arrays.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float32())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "block", "shard", "data", "book"])

    asked = coded.mapInArrow(ask, "shard long, block long, pairs binary, seen binary")
    served = asked.groupBy("shard").applyInArrow(serve, "kind string, block long, shard long, data binary, book array<float>")
    return Model(counts, shards, span, stage(served, "trie"))


def open_shard(model: Model, shard: int, folder: str | None = None) -> Shard:
    """One shard's trie; with ``folder`` its arrays are written there and memory-mapped."""
    rows = model.table.where((F.col("shard") == shard) & F.col("kind").startswith("trie:")).collect()
    arrays = {}
    for row in rows:
        _, name, kind = row["kind"].split(":")
        arrays[name] = np.frombuffer(bytes(row["data"]), kind)
        if folder:
            np.save(f"{folder}/{name}.npy", arrays[name])
            arrays[name] = np.load(f"{folder}/{name}.npy", mmap_mode="r")
    return Shard.of(arrays, model.span)


_SCORES = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(coded: DataFrame, model: Model, backoff: float) -> DataFrame:
    counts, shards = model.counts, model.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tokens = unsqueeze(row.column("tokens")[0].as_py(), np.uint32)
                sizes = row.column("sizes")[0].values.to_numpy()
                unique, inverse = np.unique(_pairs(tokens, sizes, row.column("end")[0].as_py()), return_inverse=True)
                first, second = unique >> np.uint64(32), unique & np.uint64(0xFFFFFFFF)
                logs = counts.log_word(second) + np.log10(backoff / (counts.of(first) + backoff))
                answers = {a["shard"]: a for a in row.column("answers")[0].as_py()}
                for shard, at in _by_shard(unique, counts, shards):
                    codes = unsqueeze(answers[shard]["data"], np.uint8)
                    known = codes > 0
                    logs[at[known]] = np.array(answers[shard]["book"])[codes[known] - 1]
                starts = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023  no text has no token
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("keys")[0].values,
                        row.column("held")[0].values,
                        pa.array(sizes, pa.int64()),
                        pa.array(add((counts.of(tokens) > 0).astype(np.int64)), pa.int64()),
                        pa.array(add(counts.log_word(tokens)), pa.float64()),
                        pa.array(add(logs[inverse]), pa.float64()),
                    ],
                    ["key", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
                _give_back()

    answers = (
        model.table.where("kind = 'answer'")
        .groupBy("block")
        .agg(F.collect_list(F.struct("shard", "data", "book")).alias("answers"))
    )
    return coded.join(answers, "block").select("block", "keys", "held", "sizes", "tokens", "end", "answers").mapInArrow(run, _SCORES)


def _remove(*staged: DataFrame) -> None:
    """Delete tables of ``stage`` that nothing reads any more: what followed from them is written."""
    for df in staged:
        session = df.sparkSession
        folders = {name.rpartition("/")[0] for name in df.inputFiles()}
        for folder in folders:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, backoff: float = BACKOFF) -> tuple[DataFrame, Model]:
    """Scores of all texts by a model of those not held out, and the model."""
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % 10 == 0
    blocks = stage(text_blocks(docs, key, text, held_out), "blocks")
    vocabulary, counts, span = count_words(blocks)
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    ids = words.join(vocabulary, "word").groupBy("block").agg(F.collect_list(F.struct("place", F.col("id").alias("id"))).alias("ids"))
    coded = stage(_with_ids(blocks, ids), "coded")
    _remove(blocks, vocabulary)
    model = train_and_answer(coded, counts, max(span, 1), backoff)
    return _scored(coded, model, backoff).withColumn("train_tokens", F.lit(counts.tokens).cast("long")), model
