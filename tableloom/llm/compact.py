"""Arrays of whole numbers as compressed bytes, for exchange between tasks."""

from __future__ import annotations

import numpy as np


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of the numbers, like places together, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def steps_up(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Numbers in rising order, as their steps."""
    return squeeze(steps_up(values))


def unsqueeze_sorted(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(unsqueeze(data, kind), dtype=kind)
