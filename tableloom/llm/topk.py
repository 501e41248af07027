"""Exact top-k search by term-at-a-time accumulation.

A vector is a sparse row: its components are terms, their integers weights. Candidates are dealt
into cells; a task builds one cell's postings (for every term the places and weights of
the candidates that have it). A query takes its terms one at a time and scatters weight times
postings into a dense array of scores. The best of each cell are selected by partition and
the cells' lists are merged per query.

Queries are cut into groups of 4 096 and a cell holds at most about 65 536 candidates and four
million components; every group meets every cell once, in one task of bounded size. Candidates are
dealt round robin, so repeated rows spread evenly.

Products of two vectors whose squares add up to less than 2**61 stay below 2**61 by size, so their
scores are added in 64 bits. Rows beyond that are scored in Python integers of any size, by the
same postings.

Defined results: vectors that are NULL or hold NULL or non-finite components take no part, nor do
rows without an id; missing components count as zero. A score beyond 64 bits is returned as the
largest or smallest long, but ranked by its exact value. Equal scores go to the smaller id. A row is
never its own query's candidate, nor are other rows of the same id. Query rows that agree in all are
asked once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 1024
SAFE_SQUARES = float(1 << 61)
LONGEST = (1 << 63) - 1
QUERY_GROUP = 4096
CELL_ROWS = 65_536
CELL_COMPONENTS = 1 << 22


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, as doubles. Tasks turn x into floor(1024 * x)."""
    values = F.col(f"`{vector}`").cast("array<double>")
    fit = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(values.isNotNull() & F.col(f"`{key}`").isNotNull() & F.coalesce(fit, F.lit(False))).select(
        F.col(f"`{key}`").cast("long").alias("id"), values.alias("v")
    )


def _whole(value: float) -> int:
    """floor(1024 * x), exactly: beyond 2**53 a double is a whole number itself."""
    return int(value) * SCALE if abs(value) >= 1 << 53 else math.floor(value * SCALE)


class Sparse:
    """ids, and (row, term, weight) of every non-zero component, of the rows of one width."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.rows, self.terms, self.weights = ids, rows, terms, weights
        self.starts = np.searchsorted(rows, np.arange(len(ids) + 1))

    def row(self, number: int) -> zip:
        mine = slice(self.starts[number], self.starts[number + 1])
        return zip(self.terms[mine], self.weights[mine])


class Postings:
    """For every term the places and weights of the candidates that have it."""

    def __init__(self, table: Sparse):
        order = np.argsort(table.terms, kind="stable")
        self.ids, self.rows, self.weights = table.ids, table.rows[order], table.weights[order]
        terms = table.terms[order]
        self.width = int(terms[-1]) + 1 if len(terms) else 0
        self.starts = np.searchsorted(terms, np.arange(self.width + 1))
        self._exact: np.ndarray | None = None

    def scores(self, query: zip, exact: bool) -> np.ndarray:
        """Every candidate's score; ``exact`` asks for integers of any size."""
        weights = self.weights
        if exact and weights.dtype != object:
            if self._exact is None:
                self._exact = weights.astype(object)
            weights = self._exact
        scores = np.zeros(len(self.ids), weights.dtype)
        for term, weight in query:
            if term < self.width:
                at = slice(self.starts[term], self.starts[term + 1])
                scores[self.rows[at]] += weight * weights[at]
        return scores


def split_by_size(table: pa.Table) -> tuple[Sparse, Sparse]:
    """The rows whose scores fit 64 bits, and the others."""
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()[starts[0] : starts[-1]]
    sizes = np.diff(starts)
    rows = np.repeat(np.arange(len(ids)), sizes)
    terms = np.arange(len(values)) - np.repeat(starts[:-1] - starts[0], sizes)
    with np.errstate(over="ignore"):
        whole = np.floor(values * SCALE)
        small = np.bincount(rows, weights=whole * whole, minlength=len(ids)) < SAFE_SQUARES
    parts = []
    for rows_in in (small, ~small):
        used = np.flatnonzero(rows_in[rows] & (whole != 0))
        if rows_in is small:
            weights = whole[used].astype(np.int64)
        else:
            weights = np.array([_whole(x) for x in values[used].tolist()], object)
        place = np.cumsum(rows_in) - 1
        parts.append(Sparse(ids[rows_in], place[rows[used]], terms[used], weights))
    return parts[0], parts[1]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= bar)
    else:
        places = np.arange(len(ids))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _beyond(score: int) -> bytes | None:
    """Bytes that sort like the scores which do not fit a long; None for all others."""
    if abs(score) < LONGEST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(size, "big")
    if score > 0:
        return (0x8000 + size).to_bytes(2, "big") + digits
    return (0x8000 - size).to_bytes(2, "big") + bytes(255 - d for d in digits)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])


def search_cell(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best candidates of one cell for one group of queries."""
    columns: list[list] = [[], [], [], []]
    if candidates.num_rows and queries.num_rows:
        cells = [Postings(part) for part in split_by_size(candidates) if len(part.ids)]
        for asked, large in zip(split_by_size(queries), (False, True)):
            for number, query in enumerate(asked.ids):
                ids, scores = [], []
                for cell in cells:
                    mine = cell.scores(asked.row(number), large)
                    others = np.flatnonzero(cell.ids != query)
                    best = others[_best(cell.ids[others], mine[others], k)]
                    ids.append(cell.ids[best])
                    scores += mine[best].tolist()
                columns[0] += [int(query)] * len(scores)
                columns[1] += np.concatenate(ids).tolist()
                columns[2] += [max(-LONGEST, min(LONGEST, s)) for s in scores]
                columns[3] += map(_beyond, scores)
    return pa.table(columns, schema=FOUND)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables of (id, v)."""
    spark = candidates.sparkSession
    measures = [F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))]
    rows, components = candidates.agg(*measures).first()
    asked_rows, asked_components = queries.agg(*measures).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(least, -(-rows // CELL_ROWS), -(-components // CELL_COMPONENTS))
    groups = max(1, -(-asked_rows // QUERY_GROUP), -(-asked_components // CELL_COMPONENTS))
    dealt = candidates.select(
        "id",
        "v",
        (F.monotonically_increasing_id() % cells).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    asked = queries.distinct().select(
        "id",
        "v",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"),
        F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group"),
    )
    found = (
        dealt.groupBy("cell", "group")
        .cogroup(asked.groupBy("cell", "group"))
        .applyInArrow(lambda left, right: search_cell(left, right, k), "query_id long, vec_id long, score long, beyond binary")
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
