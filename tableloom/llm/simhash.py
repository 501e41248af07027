"""SimHash near-duplicates: fingerprints, and groups linked at two or fewer differing bits.

A text's fingerprint is the majority of the XXH64 bits of its three-word shingles. To find
close fingerprints, each is mapped to the bit counts of its 16 segments of four bits. The Manhattan
distance of two such points never exceeds the number of differing bits, so points more than
two apart need no look. Two points of the integer grid are at most two apart exactly when some
grid cell is at most one step from both: every fingerprint is entered in its own cell and those
one step away, and fingerprints that share a cell are candidates. They are then verified on all
64 bits.

Cells with up to 8 fingerprints compare them directly. In fuller cells pairs are not spelled
out: such fingerprints are linked through the 64-bit values at most one bit from them. A value
has at most 65 such fingerprints, all within two bits of each other, and any two fingerprints
within two bits share a value. Equal fingerprints are one entry throughout. Groups come from the
connected components of the links.

``alike_groups`` goes by the share of five-word shingles that two texts have in
common instead, from 0.8 on. Texts so alike differ in some ten bits of 64, where neither the grid
nor any other look at so few bits tells them from strangers. So fingerprints within two bits are
one source of candidates, and equal bands of least shingle hashes are another: of 20 bands of
six, two texts at 0.8 share one with probability 0.997. A band is compared with one text in it; who
is not like that one goes on without it, until none is left. Every candidate is confirmed
on the whole shingle sets. The rounds are as many as the unlike texts of one band, so a passage that
very many short documents share makes it slow: on 0.5 GB of documents the check tool stopped it.

Defined results: NULL text is the empty text, whose fingerprint is zero; rows with a NULL
key have a fingerprint and a group, but give a group no name unless nothing else can. Texts of fewer words
than a shingle are one shingle; all texts without a word are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.llm.graph import components
from tableloom.llm.text import WORD, free_names, lower_ascii, text_of
from tableloom.staging import stage, stage_unless_empty

WORDS = 3  # per shingle
SEED = 42
BITS = 2  # fingerprints that differ in at most so many bits are linked
SEGMENTS, SEGMENT_BITS = 16, 4
DIRECT = 8
ALIKE_WORDS = 5  # per shingle, for likeness
ALIKE = (4, 5)  # shared shingles to all shingles of two texts that are alike
BANDS, BAND_HASHES = 20, 6
_BLOCK = 1 << 15


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import re

    import xxhash

    words = re.findall(WORD, lower_ascii(text))
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str) -> int:
    """A bit is one when over half the hashes have it."""
    return majority(shingle_hashes(text))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, fingerprint) of every row."""
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), text_of(F.col(f"`{text}`")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text_hash"), values], ["key", "text_hash", "fingerprint"])

    schema = T.StructType(
        [narrow.schema["key"], T.StructField("text_hash", T.LongType()), T.StructField("fingerprint", T.LongType())]
    )
    return narrow.mapInArrow(run, schema)


def _cells(points: DataFrame) -> DataFrame:
    """(cell, fingerprint): the own cell of each point and those one step away."""
    mask = (1 << SEGMENT_BITS) - 1
    # Counts of 0 to 4 in three bits each.
    counts = [F.bit_count(F.shiftrightunsigned("fingerprint", i * SEGMENT_BITS).bitwiseAND(F.lit(mask))).cast("long") for i in range(SEGMENTS)]
    own = sum((c * (1 << (3 * i)) for i, c in enumerate(counts[1:], 1)), counts[0])
    steps = []
    for i, count in enumerate(counts):
        unit = F.lit(1 << (3 * i)).cast("long")
        steps += [F.when(count > 0, F.col("own") - unit), F.when(count < SEGMENT_BITS, F.col("own") + unit)]
    return (
        points.withColumn("own", own)
        .select("fingerprint", F.explode(F.array(F.col("own"), *steps)).alias("cell"))
        .where("cell IS NOT NULL")
    )


def close_links(points: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever distinct ``fingerprint`` values lie within two bits.

    Not every such pair is listed, but every one is connected by listed links.
    """
    cells = _cells(points)
    shared = stage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    few = cells.join(shared.where(F.col("n") <= DIRECT), "cell").groupBy("cell").agg(F.collect_list("fingerprint").alias("f"))
    pairs = F.flatten(
        F.transform(
            "f",
            lambda x: F.transform(
                F.filter("f", lambda y: (y < x) & (F.bit_count(x.bitwiseXOR(y)) <= BITS)),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    direct = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    crowded = cells.join(shared.where(F.col("n") > DIRECT), "cell", "left_semi").select("fingerprint").distinct()
    values = F.array(F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])
    around = crowded.select("fingerprint", F.explode(values).alias("value")).groupBy("value").agg(F.sort_array(F.collect_list("fingerprint")).alias("f"))
    stars = around.where(F.size("f") > 1).select(F.explode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("a"), F.get("f", F.lit(0)).alias("b"))
    return direct.unionAll(stars).distinct()


def _bit(place: int) -> int:
    return 1 << place if place < 63 else -(1 << 63)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, fingerprint, root, component): one row per row of ``docs``.

    ``root`` tells groups apart; ``component`` is the smallest key of the group.
    """
    marked = stage(fingerprints(docs, key, text), "fingerprints")
    points = stage(marked.groupBy("fingerprint").agg(F.min("key").alias("least")), "points")
    roots = components(close_links(points.select("fingerprint")))
    placed = points.join(roots.withColumnRenamed("vertex", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    placed = stage(placed, "roots")
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(placed.join(names, "root").select("fingerprint", "root", "component"), "fingerprint")


def _multipliers() -> np.ndarray:
    """Odd factors that put the hashes in another order each, fixed by their seed."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """One signed number per band: equal where two sets have the same least hashes in all its orders."""
    import xxhash

    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), _BLOCK // 4):
        np.minimum(least, (hashes[start : start + _BLOCK // 4] * factors[:, None]).min(axis=1), out=least)
    rows = least.astype("<u8").reshape(BANDS, BAND_HASHES)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)]


_MARKS = T.StructType(
    [
        T.StructField("text_hash", T.LongType()),
        T.StructField("class", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("fingerprint", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, class, n, fingerprint, bands) of every row; a class has one set of n shingles."""
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), text_of(F.col(f"`{text}`")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factors = _multipliers()
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                hashes = shingle_hashes(value.as_py(), ALIKE_WORDS)
                single = np.unique(hashes)
                name = xxhash.xxh3_128_digest(single.astype("<u8").tobytes())
                rows.append((name, len(single), majority(hashes), band_hashes(single, factors) if len(single) else []))
            classes, sizes, prints, bands = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("text_hash"),
                    pa.array(classes, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["key", *_MARKS.names],
            )

    return narrow.mapInArrow(run, T.StructType([narrow.schema["key"], *_MARKS.fields]))


def _shingle_sets(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(class, hashes) of the classes in ``rows`` (class, key, text_hash)."""
    texts = docs.select(
        F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"), text_of(F.col(f"`{text}`")).alias("text")
    )
    named = rows.join(texts, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    # Rows that agree in key and text are one.
    single = named.groupBy("class").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.unique(shingle_hashes(batch.column("text")[i].as_py(), ALIKE_WORDS)).view(np.int64)
                offsets = pa.array([0, len(hashes)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").slice(i, 1), pa.ListArray.from_arrays(offsets, pa.array(hashes))], ["class", "hashes"]
                )

    return single.mapInArrow(run, "class binary, hashes array<long>")


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct (a, b), a above b, of (x, n_x, y, n_y) whose sizes do not rule likeness out."""
    few, all_ = ALIKE
    sizes = all_ * F.least("n_x", "n_y") >= few * F.greatest("n_x", "n_y")
    return df.where((F.col("x") != F.col("y")) & sizes).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are alike."""
    few, all_ = ALIKE
    one = sets.select(F.col("class").alias("a"), F.col("hashes").alias("of_a"))
    two = sets.select(F.col("class").alias("b"), F.col("hashes").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    # |A and B| / |A or B| >= few / all, in whole numbers.
    return pairs.join(one, "a").join(two, "b").where((few + all_) * common >= few * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _crowded(members: DataFrame) -> DataFrame:
    """The members of buckets that have more than one."""
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return members.join(shared.select("bucket"), "bucket", "left_semi")


def alike_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, root, component) of every row: groups linked by alike texts, as ``near_groups``."""
    marked = stage(_marks(docs, key, text), "marks")
    classes = stage(
        marked.groupBy("class").agg(
            F.min(F.struct("key", "text_hash")).alias("row"),
            F.min("key").alias("least"),
            *[F.first(c).alias(c) for c in ("n", "fingerprint", "bands")],
        ),
        "classes",
    )
    # Fingerprints within two bits, each by one of its classes.
    points = stage(classes.groupBy("fingerprint").agg(F.min(F.struct("class", "n")).alias("of")), "points")
    own = classes.join(points, "fingerprint").select(
        F.col("class").alias("x"), F.col("n").alias("n_x"), F.col("of.class").alias("y"), F.col("of.n").alias("n_y")
    )
    ends = [points.select(F.col("fingerprint").alias(c), F.col("of.class").alias(v), F.col("of.n").alias(f"n_{v}")) for c, v in (("a", "x"), ("b", "y"))]
    close = close_links(points.select("fingerprint")).join(ends[0], "a").join(ends[1], "b").select("x", "n_x", "y", "n_y")
    first = stage(_pairs(own.unionAll(close)), "candidates")
    members = stage(_crowded(classes.select("class", "n", F.explode("bands").alias("bucket"))), "bands")
    wanted = members.select("class").unionAll(first.select("a")).unionAll(first.select("b")).distinct()
    rows = classes.join(wanted, "class", "left_semi").select("class", "row.key", "row.text_hash")
    sets = stage(_shingle_sets(docs, rows, key, text), "shingles")
    found = stage(_alike(first, sets), "alike")
    links = found
    while members is not None:
        order = F.struct(F.xxhash64("class", "bucket").alias("order"), "class", "n")
        centres = members.groupBy("bucket").agg(F.min(order).alias("c"))
        held = members.join(centres.select("bucket", F.col("c.class").alias("y"), F.col("c.n").alias("n_y")), "bucket")
        held = held.withColumnsRenamed({"class": "x", "n": "n_x"}).where("x <> y")
        # Links that are known need no second look.
        found = stage(_alike(_pairs(held).join(links, ["a", "b"], "left_anti"), sets), "alike")
        links = stage(links.unionAll(found), "links")
        left = held.select(F.col("x").alias("class"), F.col("n_x").alias("n"), "bucket", F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        left = left.join(links, ["a", "b"], "left_anti").select("class", "n", "bucket")
        members = stage_unless_empty(_crowded(stage(left, "left")), "bands")
    roots = components(links)
    placed = classes.select("class", "least").join(roots.withColumnRenamed("vertex", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )
    placed = stage(placed, "roots")
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    return marked.select("key", "text_hash", "class").join(placed.join(names, "root").select("class", "root", "component"), "class").drop("class")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", groups_of: Callable = near_groups) -> DataFrame:
    """The row of ``docs`` with the smallest key of every group, columns as they were.

    ``groups_of`` is ``near_groups`` or ``alike_groups``.
    """
    k, h, others = free_names(docs, "__key", "__hash", "__rest")
    groups = groups_of(docs, key, text).where(F.col("key").eqNullSafe(F.col("component")))
    chosen = groups.groupBy("root").agg(F.min(F.struct("key", "text_hash")).alias("row")).select(
        F.col("row.key").alias(k), F.col("row.text_hash").alias(h)
    )
    same = F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(h))
    joined = docs.join(chosen, same)
    # Rows that agree in key and text are one document.
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    one = F.min(F.struct(*rest, F.lit(True).alias(h))).alias(others)
    kept = joined.groupBy(F.col(f"`{key}`"), F.col(f"`{text}`")).agg(one)
    return kept.select(*[F.col(f"`{c}`") if c in (key, text) else F.col(others).getField(c).alias(c) for c in docs.columns])
