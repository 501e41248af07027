"""Best-fit packing of documents into sequences, with certified bounds.

Documents become token ids, an end id included; longer ones than a sequence are cut into full
pieces after a shorter first one. Pieces are dealt into partitions. Each partition is packed
by best-fit decreasing and gets a lower bound on its number of bins from dual-feasible functions;
where the two agree the packing is certified optimal. The same functions bound the bins of the
whole table, from its counts by length. While more are used, partitions with a gap give up the
pieces of bins that are not full, certified ones those of bins not half full; they exchange them
under a new hash among half as many partitions and run again. A round's packing is kept only if
it needs fewer bins. Only counts reach the driver, and a partition has about 20 000 pieces.

Defined results: NULL text is the empty text, a piece of the end id alone; rows that agree in
all are packed each; full pieces are sequences alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.text import text_of
from tableloom.llm.tokens import encoder, text_groups
from tableloom.staging import stage

CAPACITY = 2048
END_ID = 0
PART_PIECES = 20_000
ROUNDS = 4
FAMILY = 64  # dual-feasible functions of the second kind


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_of(F.col(f"`{text}`")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            rows: list[tuple] = []
            for group in text_groups(texts):
                for doc, ids in zip(keys[group], tool.encode(texts[group])):
                    ids = np.append(ids, tool.kind(END_ID)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].data)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    A dual-feasible function maps sizes so that what fits one bin still does; the sum of the
    mapped sizes over the capacity is then a bound.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length, 0 to ``capacity``."""
    if not counts.any():
        return 0
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    # Sizes over capacity - k count as a full bin, those under k as nothing.
    words = np.concatenate([[0], np.cumsum(counts * sizes)])
    items = np.concatenate([[0], np.cumsum(counts)])
    k = np.arange(1, capacity // 2 + 1)
    large = items[-1] - items[capacity - k + 1]
    middle = words[capacity - k + 1] - words[k]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max()))
    # Sizes are rounded to whole multiples of capacity / k, those on a border stay.
    for k in range(1, FAMILY):
        whole, rest = np.divmod((k + 1) * sizes, capacity)
        mapped = np.where(rest == 0, k * sizes, whole * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and the fill of each bin.

    A bit per free amount tells which amounts some bin has; the lowest one from the
    piece's length on is the best fit.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    amounts = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = amounts >> length
        if fitting:
            amount = length + (fitting & -fitting).bit_length() - 1
            chosen = by_free[amount].pop()
            if not by_free[amount]:
                amounts ^= 1 << amount
        else:
            amount, chosen = capacity, len(free)
            free.append(capacity)
        bins[item], offsets[item] = chosen, capacity - amount
        left = free[chosen] = amount - length
        if left:
            if not by_free[left]:
                amounts |= 1 << left
            by_free[left].append(chosen)
    return bins, offsets, capacity - np.array(free, np.int64)


_PACKED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
    "certified boolean, loose boolean"
)


def _pack(pieces: DataFrame, part: Column, number: int, capacity: int) -> DataFrame:
    """Pack each part; sequence ids carry the round, the part and the bin."""

    def run(table: pa.Table) -> pa.Table:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        # The order of rows in a part depends on the shuffle; the packing must not.
        table = table.sort_by([(n, "ascending") for n in ("doc_id", "piece", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        part = table.column("part")[0].as_py()
        certified = len(fill) == lower_bound(lengths, capacity)
        return pa.table(
            {
                **{n: table.column(n) for n in names},
                "sequence_id": (number + 1 << 56) + (part << 32) + bins,
                "offset": offsets,
                "certified": np.full(len(bins), certified),
                "loose": (fill[bins] < capacity) if not certified else (2 * fill[bins] < capacity),
            }
        )

    parted = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", part.cast("long").alias("part"))
    return parted.groupBy("part").applyInArrow(run, _PACKED)


def _bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` and whether the bin count is ``certified``.

    ``pieces`` must be staged.
    """
    alone = pieces.where(F.col("length") == capacity).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    short = pieces.where(F.col("length") < capacity)
    parts = -(-short.count() // part_pieces) or 1
    row = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    by_length = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    needed = bound_of_counts(np.array([by_length.get(i, 0) for i in range(capacity + 1)], np.int64), capacity)
    now = stage(_pack(short, F.pmod(row, F.lit(parts)), 0, capacity), "packed")
    done, used = [now], _bins(now)
    for number in range(1, rounds):
        if parts == 1 or used <= needed:
            break
        settled, pool = now.where("NOT loose"), now.where("loose")
        before = _bins(pool)
        parts = max(1, min(parts // 2, -(-pool.count() // part_pieces)))
        salt = F.xxhash64(F.lit(number), "doc_id", "piece", "ids_crc32", "sequence_id", "offset")
        again = stage(_pack(pool, F.pmod(salt, F.lit(parts)), number, capacity), "packed")
        after = _bins(again)
        if after >= before:
            break
        used -= before - after
        done[-1:] = [settled, again]
        now = again
    columns = alone.columns
    return reduce(DataFrame.unionAll, [alone, *[d.select(*columns) for d in done]])
