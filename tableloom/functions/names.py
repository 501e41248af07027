"""Column-name rules. They look at names only, never at data."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable


def unique_names(names: Iterable[str], style: str = "suffix", prefix: str = "bbl_") -> list[str]:
    """Names that differ even when case is ignored.

    The last column of a repeated name keeps it and the earlier ones are renamed:
    ``suffix`` adds ``_1``, ``_2``, ..., ``prefix`` puts ``prefix`` in front and
    ``position`` adds the 0-based column number.
    """
    if style not in ("suffix", "prefix", "position"):
        raise ValueError(f"unknown repair style {style!r}")
    names = list(names)
    left_over = Counter(n.lower() for n in names)
    taken = set(left_over)
    result = []
    for position, name in enumerate(names):
        left_over[name.lower()] -= 1
        if left_over[name.lower()] == 0:
            result.append(name)
            continue
        for candidate in _candidates(name, style, prefix, position):
            if candidate.lower() not in taken:
                break
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def _candidates(name: str, style: str, prefix: str, position: int):
    if style == "prefix":
        while True:
            name = prefix + name
            yield name
    if style == "position":
        name = f"{name}_{position}"
        yield name
    number = 1
    while True:
        yield f"{name}_{number}"
        number += 1


def normal_names(names: Iterable[str], upper: bool = False) -> list[str]:
    """Spaces to underscores, optionally in upper case, then made unique."""
    plain = [n.replace(" ", "_") for n in names]
    return unique_names([n.upper() for n in plain] if upper else plain)
