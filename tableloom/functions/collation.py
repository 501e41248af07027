"""Sorting text by a custom character order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def collation_key(text: Column, order: str) -> Column:
    """A sort key: listed characters in ``order``, all others alike and after them.

    Each character turns into one weight, so a prefix sorts before the longer text.
    """
    letters = list(dict.fromkeys(order))
    if not letters:
        raise ValueError("the character order is empty")
    # Weights come from the private use area, which sorts by code point and means nothing
    # to a regular expression.
    weights = [chr(0xE000 + i) for i in range(len(letters) + 1)]
    listed = "".join(re.escape(c) for c in letters)
    others_last = F.regexp_replace(text, f"(?s)[^{listed}]", weights[-1])
    return F.translate(others_last, "".join(letters), "".join(weights[:-1]))
