"""What the operators agree on about texts: words, ASCII lower case, safe columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but space and the five ASCII controls that separate words.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = {ord(letter): letter.lower() for letter in UPPER}
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def text_of(column: str | Column) -> Column:
    """The text, or the empty text where it is NULL."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    if text.isascii():
        return text.lower()
    # As bytes, since str.translate looks up every character; no byte of another character is ASCII.
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda function an expression is computed anew for every element; its
    parameter is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(steps: Column) -> Column:
    """For an array of numbers, the sum of all earlier elements at each place.

    Sums of blocks of about sqrt(n) elements are added first, so a long array costs
    n * sqrt(n) steps and no array is copied.
    """
    zero = F.lit(0).cast("long")

    def total(parts: Column) -> Column:
        return F.aggregate(parts, zero, lambda a, b: a + b)

    def sums(s: Column, block: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(s) / block).cast("int")),
            lambda b: total(F.slice(s, b * block + 1, block)),
        )
        return let(
            blocks,
            lambda parts: F.transform(
                s,
                lambda _, i: total(F.slice(parts, F.lit(1), F.floor(i / block).cast("int")))
                + total(F.slice(s, (F.floor(i / block) * block).cast("int") + 1, (i % block).cast("int"))),
            ),
        )

    side = lambda s: F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
    return let(steps, lambda s: let(side(s), lambda block: sums(s, block)))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
