"""Counts out of md5 for many keys and replicates at once: its steps over arrays of keys, for one replicate after the other."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Keys that are hashed together: few enough for their words to stay in a core's cache.
BLOCK = 32768
_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The first register, which holds the first eight hexadecimal digits, is ready after 61 of the 64 steps.
_STEPS = 61
#: Longest text that fits one block.
_LONGEST = 55


def _steps(state: list[np.ndarray], first: int, last: int, vectors: list, scalars: list, f: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = state
    for i in range(first, last):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        if vectors[i] is not None:
            np.add(f, vectors[i], f)
        if scalars[i] is not None:
            np.add(f, scalars[i], f)
        np.left_shift(f, _LEFT[i], g)
        np.right_shift(f, _RIGHT[i], f)
        np.bitwise_or(f, g, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


_LEFT = [np.array(s, np.uint32) for s in _SHIFTS]
_RIGHT = [np.array(32 - s, np.uint32) for s in _SHIFTS]


def _numbers(keys: np.ndarray, suffixes: list[bytes], limit: int):
    """For each suffix the first 32 bits of md5(key + suffix) modulo ``limit``; keys: (n, length) bytes."""
    n, length = keys.shape
    text = np.zeros((n, 64), np.uint8)
    text[:, :length] = keys
    words = np.ascontiguousarray(text.view("<u4").T)
    keyed = words.any(axis=1)
    whole = length // 4  # words that no suffix touches
    vectors = [words[w] + _K[i] if keyed[w] else None for i, w in enumerate(_WORD)]
    f, g, scaled = (np.empty(n, np.uint32) for _ in range(3))
    plain = [None if v is not None else np.array(_K[i]) for i, v in enumerate(vectors)]
    before = _steps([np.full(n, x, np.uint32) for x in _START], 0, whole, vectors, plain, f, g)
    state = [np.empty(n, np.uint32) for _ in range(4)]
    modulus = np.array(limit, np.uint32)
    for suffix in suffixes:
        end = bytearray(64)
        end[length : length + len(suffix) + 1] = suffix + b"\x80"
        end[56:64] = (8 * (length + len(suffix))).to_bytes(8, "little")
        added = np.frombuffer(bytes(end), "<u4")
        scalars = [np.array(x, np.uint32) if (x := (int(added[w]) + (0 if vectors[i] is not None else int(_K[i]))) % 2**32) else None for i, w in enumerate(_WORD)]
        for s, x in zip(state, before):
            s[:] = x
        a, b, *_ = _steps(state, whole, _STEPS, vectors, scalars, f, g)
        np.add(b, np.uint32(_START[0]), f)
        f.byteswap(inplace=True)
        np.floor_divide(f, modulus, g)
        np.multiply(g, modulus, scaled)
        np.subtract(f, scaled, g)
        yield g


def counts(keys: pa.Array, replicates: int, thresholds: tuple[int, ...], limit: int = 10_000) -> np.ndarray:
    """(keys, replicates) in bytes: how many thresholds are at or under the first 32 bits of md5("key:replicate"), replicate from 1, modulo ``limit``."""
    data = keys.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    suffixes = [f":{r}".encode() for r in range(1, replicates + 1)]
    out = np.empty((len(data), replicates), np.uint8)
    at_least = [np.array(p, np.uint32) for p in thresholds]
    for length in np.unique(lengths).tolist():
        of_length = np.flatnonzero(lengths == length)
        if length + len(suffixes[-1]) > _LONGEST:
            for k in of_length.tolist():
                key = raw[offsets[k] : offsets[k + 1]].tobytes()
                u = np.array([int(hashlib.md5(key + s, usedforsecurity=False).hexdigest()[:8], 16) % limit for s in suffixes])
                out[k] = sum((u >= p).astype(np.uint8) for p in thresholds)
            continue
        for start in range(0, len(of_length), BLOCK):
            rows = of_length[start : start + BLOCK]
            made = np.empty((replicates, len(rows)), np.uint8)
            more = np.empty(len(rows), bool)
            for line, u in zip(made, _numbers(raw[offsets[rows][:, None] + np.arange(length)], suffixes, limit)):
                np.greater_equal(u, at_least[0], more)
                line[:] = more.view(np.uint8)
                for p in at_least[1:]:
                    np.greater_equal(u, p, more)
                    np.add(line, more.view(np.uint8), line)
            out[rows] = made.T
    return out
