"""Categories as numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.names import unique_names
from tableloom.operators.heavy import most_frequent
from tableloom.operators.joins import equi_join, is_small
from tableloom.operators.ranking import with_position
from tableloom.staging import stage

OTHER = "OTHER"
# Up to so many labels are looked up in an array, more by a join. The result is the same.
LISTED = 50


@dataclass(frozen=True)
class CategoryList:
    """The most frequent values of a column, and whether others exist.

    It holds at most ``cap`` labels, the only data the encoders bring to the driver.
    NULL is a category of its own. Names stay unique: a value ``OTHER`` and the rest, or NULL
    and a text ``None``, do not share a slot.
    """

    column: str
    type: T.DataType
    labels: tuple[Any, ...]
    has_other: bool

    @property
    def other(self) -> str:
        """The label of the rest: ``OTHER``, or with a number behind it if a value is so called."""
        texts = {str(label) for label in self.labels if label is not None}
        name, number = OTHER, 0
        while name in texts:
            number += 1
            name = f"{OTHER}_{number}"
        return name

    def slots(self) -> list[str]:
        """Names of the one-hot columns, in slot order."""
        names = [f"{self.column}_{label}" for label in self.labels]
        # The last of equal names keeps it: that of a text before that of NULL.
        order = sorted(range(len(names)), key=lambda i: self.labels[i] is not None)
        unique = unique_names([names[i] for i in order])
        placed = dict(zip(order, unique))
        names = [placed[i] for i in range(len(names))]
        return names + [f"{self.column}_{self.other}"] if self.has_other else names

    def index(self) -> Column:
        """The 0-based rank of a value; the number of labels for any other value."""
        value = F.col(f"`{self.column}`")
        rest = F.lit(len(self.labels))
        known = [label for label in self.labels if label is not None]
        place = rest
        if known:
            listed = F.array(*[F.lit(k).cast(self.type) for k in known])
            ranks = F.array(*[F.lit(self.labels.index(k)) for k in known])
            at = F.array_position(listed, value).cast("int")
            place = F.when(at > 0, F.element_at(ranks, F.when(at > 0, at))).otherwise(rest)
        missing = F.lit(self.labels.index(None)) if None in self.labels else rest
        return F.when(value.isNull(), missing).otherwise(place)

    def capped(self) -> Column:
        """The value as text, or the label of the rest."""
        value = F.col(f"`{self.column}`").cast("string")
        return F.when(self.index() < len(self.labels), value).otherwise(F.lit(self.other))

    def one_hot(self) -> list[Column]:
        """One 0/1 column per slot; all zero for an unknown value without a slot for the rest.

        Each repeats the look-up, so with more than a few slots use ``with_one_hot``.
        """
        return _slots(self.index(), self.slots())

    def with_index(self, df: DataFrame, name: str) -> DataFrame:
        """Add the index: by look-up for few labels, else by a join with the table of labels."""
        if len(self.labels) <= LISTED:
            return df.withColumn(name, self.index())
        kind = T.StructType([T.StructField("__label", self.type), T.StructField("__rank", T.IntegerType())])
        ranks = df.sparkSession.createDataFrame([(label, i) for i, label in enumerate(self.labels)], kind)
        same = F.col(f"`{self.column}`").eqNullSafe(F.col("__label"))
        # At most ``cap`` rows.
        joined = df.join(F.broadcast(ranks), same, "left")
        return joined.select(*[f"`{c}`" for c in df.columns], F.coalesce("__rank", F.lit(len(self.labels))).alias(name))

    def with_one_hot(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` and one 0/1 column per slot; each value is looked up once."""
        indexed = self.with_index(df, "__index").select(
            *[f"`{c}`" for c in keep], F.explode(F.array("__index")).alias("__slot")
        )
        return indexed.select(*[f"`{c}`" for c in keep], *_slots(F.col("__slot"), self.slots()))


def _slots(place: Column, names: Sequence[str]) -> list[Column]:
    return [F.when(place == i, 1).otherwise(0).alias(n) for i, n in enumerate(names)]


def fit_categories(df: DataFrame, column: str, cap: int) -> CategoryList:
    """The ``cap`` most frequent values, ties by value. They come to the driver."""
    if cap < 1:
        raise ValueError("cap must be at least 1")
    listed, rows = most_frequent(df, column, cap)
    labels = tuple(value for value, _ in listed)
    return CategoryList(column, df.schema[column].dataType, labels, sum(n for _, n in listed) < rows)


def one_hot_vector(
    df: DataFrame, index_columns: Sequence[str], vector_columns: Sequence[str]
) -> tuple[DataFrame, OneHotEncoderModel]:
    """Index columns to sparse vectors, every category with its own slot."""
    encoder = OneHotEncoder(
        inputCols=list(index_columns),
        outputCols=list(vector_columns),
        dropLast=False,
        handleInvalid="keep",
    )
    model = encoder.fit(df)
    return model.transform(df), model


def vector_columns(vector: str, names: Sequence[str]) -> list[Column]:
    """One column per slot of a vector, in slot order."""
    cells = vector_to_array(F.col(vector))
    return [F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(names)]


def category_codes(
    df: DataFrame, columns: Sequence[str], suffix: str = "_code", local_labels: int = 100_000
) -> DataFrame:
    """Add 0-based codes in sorted order of the values; NULL is -1.

    Each column's distinct values are written once. Up to ``local_labels`` of them are
    numbered in one task and broadcast. More are numbered by a distributed sort and joined by
    key, hot values salted. The codes are the same.
    """
    for column in columns:
        values = stage(df.select(F.col(f"`{column}`").alias("__v")).where("__v is not null").distinct(), "values")
        few = is_small(values, local_labels, 64 << 20)
        if few:
            place = F.row_number().over(W.orderBy("__v")).cast("long")
            codes = F.broadcast(values.withColumn("__p", place))
        else:
            codes = with_position(values, ["__v"], "__p", unique=True)
        code = F.coalesce(F.col("__p") - 1, F.lit(-1)).alias(column + suffix)
        # A broadcast needs no care for hot values; on the right each value occurs once, and
        # hot values on the left are split by adaptive execution.
        joined = equi_join(df, codes, column, "__v", "left", skew_safe=() if few else ("left",))
        df = joined.select(*[f"`{c}`" for c in df.columns], code)
    return df
