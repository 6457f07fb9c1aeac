"""Vectorised character shingles of whole batches of texts.

All texts of a batch are laid end to end as one code-point array, so that the
work is a fixed number of numpy passes over the batch, not a loop over texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Length of a run of characters.
RUN = 8

_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    return np.frombuffer(bytes(map(str.isalnum, map(chr, range(0x110000)))), dtype=np.bool_)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the lower-cased texts, end to end, and where each text begins (one more than texts)."""
    lowered = [t.lower() for t in texts]
    a = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = _kept()[a]
    sizes = np.array([len(t) for t in lowered], np.int64)
    kept = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if some.any():
        kept[some] = np.add.reduceat(keep.view(np.int8), (np.cumsum(sizes) - sizes)[some], dtype=np.int64)
    return a[keep], np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))


def run_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of each run of RUN code points, at its first position; len(a) - RUN + 1 values."""
    if len(a) < RUN:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, power = a.astype(np.uint64), 1, _BASE
        while width < RUN:
            h = h[:-width] * power + h[width:]
            power = power * power
            width *= 2
        return mix(h)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is several times faster here than numpy's own way by hashing."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    fresh = np.empty(len(x), bool)
    fresh[0] = True
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct run hashes of one text."""
    a, _ = code_points([text])
    return distinct(run_hashes(a))


def plain_set(title: str | None, body: str) -> set[str]:
    """The set of runs as strings; the plain definition, for tests."""
    s = re.sub(r"[\W_]+", "", f"{title or ''} {body}".lower())
    return {s[i : i + RUN] for i in range(len(s) - RUN + 1)}


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Shared values over all values of two sorted distinct arrays; 0 if both are empty."""
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)
