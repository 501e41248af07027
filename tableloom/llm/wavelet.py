"""Token ids on disk as wavelet matrices, one compressed file per shard.

Documents are range-sorted by key into shards of about 16 MB of text. A task encodes its shard and
writes one row, so one Parquet file: the bit-planes of the ids (highest bit first, each plane
ordered by the bits above it), the number of ones before every block of 512 bits, and the
shard's keys and lengths. ``WaveletMatrix`` answers from that row alone: the id at a place
(``access``), how often an id stands before a place (``rank``), where its n-th occurrence is
(``select``) and how often it occurs (``count``). Spark writes and reads the files on any file
system, and a lost task writes its file again.

Defined results: NULL text is the empty text, which still has its end id; rows of equal
key stand next to each other, ordered by content; an empty table gives no files' worth of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.llm.text import text_of
from tableloom.llm.tokens import encoder, text_groups

END_ID = 2
SHARD_TEXT = 16 << 20
BLOCK = 512  # bits between entries of the rank directory
PART = 1 << 16  # ids moved at a time
_SCHEMA = (
    "shard long, n_tokens long, keys array<long>, lengths array<long>, zeros array<long>, "
    "planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """A sequence of whole numbers below 2**width, as bit-planes."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.width = len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        now, below = ids.copy(), np.empty_like(ids)
        for level in range(width):
            ones = (now & now.dtype.type(1 << (width - 1 - level))) != 0
            plane = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(plane)] = plane
            per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32).tobytes())
            zeros.append(len(now) - int(per_block.sum()))
            for part, left, right in _halves(ones, zeros[-1]):
                values = now[part]
                below[left[1]] = values.take(left[0])
                below[right[1]] = values.take(right[0])
            now, below = below, now
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level][place >> 3] >> (place & 7)) & 1

    def _ones_before(self, level: int, place: int) -> int:
        block = place // BLOCK
        first = block * (BLOCK // 8)
        tail = np.unpackbits(self.planes[level][first : (place + 7) >> 3], bitorder="little")[: place - block * BLOCK]
        return int(self.ranks[level][block]) + int(tail.sum())

    def _down(self, level: int, place: int, bit: int) -> int:
        ones = self._ones_before(level, place)
        return self.zeros[level] + ones if bit else place - ones

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.width):
            bit = self._bit(level, place)
            value = value << 1 | bit
            place = self._down(level, place, bit)
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where copies of ``value`` from before ``end`` stand in the order below the last plane."""
        start = 0
        for level in range(self.width):
            bit = value >> (self.width - 1 - level) & 1
            start, end = self._down(level, start, bit), self._down(level, end, bit)
        return start, end

    def rank(self, value: int, end: int) -> int:
        if value >> self.width:
            return 0
        start, stop = self._range(value, end)
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, number: int) -> int:
        """Place of the ``number``-th (from 0) such bit of a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, number, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[level][first : first + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[number - before[block]])

    def select(self, value: int, number: int) -> int:
        """Place of the ``number``-th occurrence, from 0; -1 if there are fewer."""
        if value >> self.width:
            return -1
        start, stop = self._range(value, self.n)
        if number >= stop - start:
            return -1
        place = start + number
        for level in reversed(range(self.width)):
            bit = value >> (self.width - 1 - level) & 1
            place = self._select_bit(level, bit, place - (self.zeros[level] if bit else 0))
        return place

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """The whole sequence: planes are undone from the last to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        now, above = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in reversed(range(self.width)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            bit = kind(1 << (self.width - 1 - level))
            for part, left, right in _halves(ones, self.zeros[level]):
                values = above[part]
                values[left[0]] = now[left[1]]
                values[right[0]] = now[right[1]] | bit
            now, above = above, now
        return now


def _halves(ones: np.ndarray, zeros: int) -> Iterator[tuple]:
    """For parts that fit a processor's cache: their place, and for zeros and for ones the places
    inside the part and in the sequence ordered by this bit."""
    low, high = 0, zeros
    for start in range(0, len(ones), PART):
        mask = ones[start : start + PART]
        inside = np.flatnonzero(~mask), np.flatnonzero(mask)
        yield (
            slice(start, start + len(mask)),
            (inside[0], slice(low, low + len(inside[0]))),
            (inside[1], slice(high, high + len(inside[1]))),
        )
        low, high = low + len(inside[0]), high + len(inside[1])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append the end id and write the shards in ascending key order."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_of(F.col(f"`{text}`")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_TEXT), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 20))
    # Copies of one row differ in the partition they come from.
    ties = narrow.withColumns({"tie": F.xxhash64("text"), "part": F.spark_partition_id()})
    ranged = ties.repartitionByRange(shards, "key", "tie", "part").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = encoder(vocabulary)
        end = np.array([END_ID], tool.kind)
        width = int(len(tool.n_bytes) - 1).bit_length()
        keys, lengths, parts = [], [], []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            texts = batch.column("text").to_pylist()
            for group in text_groups(texts):
                for ids in tool.encode(texts[group]):
                    lengths.append(len(ids) + 1)
                    parts += [ids, end]
        if not lengths:
            return
        whole = np.concatenate(parts)
        del parts
        matrix = WaveletMatrix.build(whole, width)
        row = {
            "shard": TaskContext.get().partitionId(),
            "n_tokens": matrix.n,
            "keys": keys,
            "lengths": lengths,
            "zeros": matrix.zeros,
            "planes": [p.tobytes() for p in matrix.planes],
            "ranks": [r.tobytes() for r in matrix.ranks],
        }
        yield pa.RecordBatch.from_pylist([row], _ARROW)

    ranged.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("n_tokens", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("zeros", pa.list_(pa.int64())),
        ("planes", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """(shard, before): ids of all earlier shards. Sums go by blocks of 1 024 shards first."""
    sizes = files.select("shard", "n_tokens", F.floor(F.col("shard") / 1024).alias("block"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("blocks_before")
    )
    inside = W.partitionBy("block").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(blocks, "block").select("shard", (F.col("inside") + F.col("blocks_before")).alias("before"))


def read_documents(files: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = _matrix(row).decode().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                sums = [zlib.crc32(ids[a:b].data) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), row["shard"]), pa.int64()),
                        pa.array(row["keys"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["shard", "key", "inside", "n_tokens", "ids_crc32"],
                )

    found = files.mapInArrow(run, "shard long, key long, inside long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(files), "shard").select(
        "key", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(shard, place) of every occurrence of an id, by rank and select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = _matrix(row).occurrences(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(places), pa.int64()), pa.array(places, pa.int64())], ["shard", "place"]
                )

    return files.mapInArrow(run, "shard long, place long")
