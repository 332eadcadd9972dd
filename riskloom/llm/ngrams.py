"""Hashed character n-grams of whole texts, as numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Characters looked at in one go; a longer text is counted slice by slice, none is cut short.
SLICE = 1 << 20
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, 0 in place of everything that isn't a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(0))


def slices(points: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    for at in range(0, max(len(points) - overlap, 1), SLICE):
        yield points[at : at + SLICE + overlap]


def hashes(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at every place, from 0 to 2^bits - 1."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n * 40503, np.uint32)
    for k in range(n):
        h = (h ^ points[k : k + size]) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)
