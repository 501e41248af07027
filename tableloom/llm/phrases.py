"""Phrase collocations: contiguous word sequences that occur more often than their parts suggest.

A phrase can only be frequent if its parts are, so candidates grow in three passes: words, pairs of
words, and phrases of three words or more. In each pass tasks count in bounded memory and send
partial counts on by hash; every hash partition keeps a Misra-Gries summary: when it holds more
counters than its share of the mass divided by the threshold, all are lowered by the same amount.
What was taken off in all stays below the threshold, so a phrase that reaches the threshold cannot
get lost; the survivors include it, with others that the last pass drops when it counts all
survivors exactly, by their words. Summaries can be merged: counters add up, and so do the amounts
taken off.

Survivors reach the next pass as a bitmap of fixed size. A full bitmap prunes less and loses nothing.
Nothing else is broadcast or collected, and hashes decide nothing but what is counted.

Defined results: NULL text is the empty text; NULL as language is ``und`` (and joins a language of
that name); repeated rows count each; ties in rank go by count, then by the phrase's bytes; other
columns of the input take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.llm.text import text_of
from tableloom.staging import stage

LEAST = 100
LONGEST = 5
TOP = 2000
BITS = 25  # the bitmaps have 2 ** BITS bits, 4 MB
SLICE_BITS = 18
PENDING = 1_000_000  # n-grams that a task counts at once
HELD = 1_000_000  # partial counts of hashes that a task holds
HELD_PHRASES = 500_000  # the same with the phrases themselves
HELD_WORDS = 600_000
TASK_CHARS = 1 << 30  # characters that a task reads: the more, the more counts meet before the shuffle
GROUP_BYTES = 4 << 20
FEW_LANGUAGES = 10_000
PART_MASS = 20_000_000  # n-grams a hash partition should stand for

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# A-Z in lower case, tabulators as spaces, and what ends a piece as a byte that no text has.
_END = b"\xff"
_BYTES = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256)
)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _MIX + b
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """Numbers of one language's words, from 1 on; piece ends are 0."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.list = [_END]
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.list)
        self.list.append(word)
        return number

    def number(self, texts: list[str]) -> np.ndarray:
        data = b" \xff ".join(t.encode().translate(_BYTES).replace(_END, b" \xff ") for t in texts)
        words = [*data.split(), _END]
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = self.list[len(self.hashes) :]
        if new:
            more = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, more])
        return ids


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Words, np.ndarray]]:
    """(language, words, numbers) of parts of bounded size, each of whole texts."""
    known: dict[str, _Words] = {}
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang").to_pylist()
        group: dict[str, list[str]] = {}
        size = 0
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            group.setdefault(lang, []).append(text)
            size += len(text)
            if size >= GROUP_BYTES or i + 1 == len(langs):
                for name, some in group.items():
                    if sum(map(len, known.values())) > HELD_WORDS or len(known) > 100:
                        known.clear()
                    words = known.setdefault(name, _Words(name))
                    yield name, words, words.number(some)
                group, size = {}, 0


def _kept(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = hashes >> np.uint64(64 - BITS)
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _grams(words: _Words, ids: np.ndarray, bitmaps: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the n-grams whose parts are in the bitmaps, for n up to ``longest``.

    Bitmap n - 1 judges n-grams, the last one all longer ones; without a bitmap of its own an n-gram
    needs the sub-phrases of its length less one.
    """
    first = words.hashes[ids]
    hashes, places = first, np.flatnonzero(ids)
    for n in range(1, longest + 1):
        if n > 1:
            fit = np.zeros(len(ids) + 1, bool)
            fit[places] = True
            places = places[fit[places + 1]]
            hashes = _joined(hashes[places_in(previous, places)], first[places + n - 1])
        else:
            hashes = first[places]
        if n <= len(bitmaps):
            keep = _kept(bitmaps[n - 1], hashes)
            places, hashes = places[keep], hashes[keep]
        yield n, places, hashes
        previous = places


def places_in(sorted_places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_places, wanted)


class _Partial:
    """Counts of keys of one task, handed on when there are too many."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.pending.append(keys)
        self.size += len(keys)
        if self.size >= PENDING:
            yield from self.settle(HELD)

    def settle(self, held: int) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate([*self.pending, self.keys[:0]]), return_counts=True)
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.pending, self.size = [], 0
        if len(self.keys) > held:
            yield _rows(self.keys, self.counts)
            self.keys, self.counts = self.keys[:0], self.counts[:0]


def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Summary:
    """A mergeable Misra-Gries summary of weighted keys.

    It holds about ``capacity`` counters. Any key's true count is at most its counter (or 0)
    plus ``taken``, which never reaches ``threshold``: should the mass be larger than the
    capacity was made for, the summary grows instead.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.taken += taken
        spare = self.threshold - 1 - self.taken
        if len(self.keys) > self.capacity and spare > 0:
            rank = len(self.counts) - self.capacity - 1
            less = min(int(np.partition(self.counts, rank)[rank]), spare)
            left = self.counts > less
            self.keys, self.counts = self.keys[left], self.counts[left] - less
            self.taken += less

    def merge(self, other: Summary) -> None:
        self.add(other.keys, other.counts, other.taken)

    def survivors(self) -> np.ndarray:
        """Every key whose true count can reach the threshold."""
        return self.keys[self.counts + self.taken >= self.threshold]


def _survivors(partial: DataFrame, mass: int, least: int) -> DataFrame:
    """Keys that the summaries of the hash partitions name."""
    parts = max(8, -(-mass // PART_MASS))
    capacity = max(1 << 16, 2 * mass // (parts * least) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity, least)
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= max(1 << 19, capacity):
                _take(summary, waiting)
                waiting, rows = [], 0
        _take(summary, waiting)
        keys = summary.survivors()
        for start in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[start : start + (1 << 16)].view(np.int64))], ["key"])

    return partial.repartition(parts, "key").mapInArrow(run, "key long")


def _take(summary: Summary, batches: list[pa.RecordBatch]) -> None:
    if batches:
        table = pa.Table.from_batches(batches)
        summary.add(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy())


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The keys' leading bits, by slices of 32 KB: at most 2 ** BITS bits in all reach the driver."""
    place = F.shiftrightunsigned("key", 64 - BITS)
    byte, bit = F.shiftrightunsigned(place, 3), F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))
    octets = keys.groupBy(byte.alias("byte")).agg(F.bit_or(bit).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        wide = 1 << SLICE_BITS - 3
        for batch in batches:
            bytes_, values = (batch.column(c).to_numpy() for c in ("byte", "bits"))
            for number in np.unique(bytes_ // wide).tolist():
                mine = bytes_ // wide == number
                part = bits.setdefault(number, np.zeros(wide, np.uint8))
                part[bytes_[mine] % wide] |= values[mine].astype(np.uint8)
        columns = [pa.array(list(bits), pa.int32()), pa.array([b.tobytes() for b in bits.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "bits"])

    slices = octets.repartition(8, F.shiftrightunsigned("byte", SLICE_BITS - 3)).mapInArrow(run, "slice int, bits binary")
    full = np.zeros(1 << BITS - 3, np.uint8)
    wide = 1 << SLICE_BITS - 3
    for row in slices.collect():
        full[row["slice"] * wide : (row["slice"] + 1) * wide] |= np.frombuffer(row["bits"], np.uint8)
    return full


def _partial(texts: DataFrame, bitmaps: list, lengths: range) -> DataFrame:
    """Partial counts of the n-grams of ``lengths`` whose parts survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [b.value for b in bitmaps]
        counts = _Partial()
        for _, words, ids in _numbered(batches):
            for n, _, hashes in _grams(words, ids, known, lengths[-1]):
                if n in lengths:
                    yield from counts.add(hashes)
        yield from counts.settle(0)

    return texts.mapInArrow(run, "key long, n long")


def _exact(texts: DataFrame, bitmaps: list, longest: int) -> DataFrame:
    """(lang, phrase, words, f) of all survivors, counted by their words; the empty phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [b.value for b in bitmaps]
        held: Counter[tuple[str, bytes, int]] = Counter()
        for lang, words, ids in _numbered(batches):
            held[lang, b"", 0] += int(np.count_nonzero(ids))
            names = ids  # numbers of the n-grams from here on: equal for equal words, by exact pairs
            for n, places, _ in _grams(words, ids, [*known, *known[-1:] * (longest - 3)], longest):
                pairs = ids[places] if n == 1 else names[places] << 32 | ids[places + n - 1]
                _, at, named, counts = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
                for place, count in zip(places[at].tolist(), counts.tolist()):
                    held[lang, b" ".join([words.list[i] for i in ids[place : place + n].tolist()]), n] += count
                names = np.zeros(len(ids), np.int64)
                names[places] = named
            if len(held) > HELD_PHRASES:
                yield counted(held)
                held = Counter()
        yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        langs, phrases, lengths = zip(*held) if held else ((), (), ())
        columns = [langs, [p.decode() for p in phrases], lengths, list(held.values())]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "phrase", "words", "f"])

    partial = texts.mapInArrow(run, "lang string, phrase string, words int, f long")
    return partial.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words with at least ``least`` occurrences.

    ``words`` 0 gives a language's number of words, whatever it is. The table is staged.
    """
    if longest < 3:
        raise ValueError("longest must be 3 or more")
    spark = docs.sparkSession
    texts = docs.select(text_of(F.col(f"`{text}`")).alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    chars = texts.agg(F.sum(F.length("text") + F.lit(1))).first()[0] or 0
    mass = chars // 2  # a word takes two characters with what parts it from the next
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)))
    bitmaps: list = []
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        share = mass * len(lengths)
        keys = _survivors(_partial(texts, bitmaps, lengths), share, least)
        bitmaps.append(spark.sparkContext.broadcast(_bitmap(keys)))
    exact = _exact(texts, bitmaps, longest)
    return stage(exact.where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def _wide(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score, cut."""
    phrases = frequent_phrases(docs, least, longest, text, lang)
    counts = phrases.where("words > 0").select("lang", "phrase", "f")
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns(
        {
            "head": F.array_join(F.slice(word, F.lit(1), F.col("cut")), " "),
            "tail": F.array_join(F.slice(word, F.col("cut") + 1, F.col("words") - F.col("cut")), " "),
        }
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    parts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # A row a language: sent to all while there are few, so that a large language is not read by one task.
    parts = parts.join(F.broadcast(totals) if totals.count() <= FEW_LANGUAGES else totals, "lang")
    # Exact: products have up to 38 digits, and the quotient is whole.
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * _wide("a") * _wide("n"), _wide("l") * _wide("r"))
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n"))
    scored = parts.groupBy("lang", "phrase", "words", "a").agg(lowest.alias("best")).select("lang", "phrase", "words", "a", "best.*")
    # Inner parts of candidates that occur as often as the candidate itself say nothing new.
    inner = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice(word, F.col("at"), F.col("size")), " ").alias("phrase"))
    inside = inner.agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def merged(summaries: list[Summary]) -> Summary:
    """One summary of all; with equal capacities the error stays what one summary of all would have."""
    return reduce(lambda a, b: (a.merge(b), a)[1], summaries[1:], summaries[0])

