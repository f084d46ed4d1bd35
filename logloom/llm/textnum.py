"""Vectorised text helpers over Arrow string columns.

Texts are handled in chunks of about ``CHUNK_CHARS`` characters (a longer text is a chunk of its own), so the
arrays a worker holds are bounded by the longest text and never by a partition or a record batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1 << 19
_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, _U64)
_inverses = np.ones(1, _U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept for later calls."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * CHUNK_CHARS)
        up, down = np.full(size, _BASE, _U64), np.full(size, pow(_BASE, -1, 1 << 64), _U64)
        up[0] = down[0] = 1
        _powers, _inverses = np.cumprod(up, dtype=_U64), np.cumprod(down, dtype=_U64)
    return _powers, _inverses


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; equal inputs and seeds give equal outputs everywhere."""
    z = x + _U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
    return z ^ (z >> _U64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, one longer than the input."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, _U64)
    np.cumsum((symbols.astype(_U64) + _U64(1)) * up[: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans; they depend on the symbols alone and not on where a span lies."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def texts(column: pa.Array) -> list[str]:
    """The column's texts; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def char_chunks(rows: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each."""
    first = size = 0
    for i, text in enumerate(rows):
        size += len(text)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(rows):
        yield first, len(rows)


def code_points(rows: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points, and where each row starts (one more than rows)."""
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    joined = "".join(rows)
    return joined, np.frombuffer(joined.encode("utf-32-le"), "<u4"), offsets


def utf8_bytes(rows: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes, also as an array, and where each row starts."""
    parts = [x.encode() for x in rows]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    joined = b"".join(parts)
    return joined, np.frombuffer(joined, np.uint8), offsets


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, which never cross a row's border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(mask))]
    first[cuts] |= mask[cuts]
    last[cuts - 1] |= mask[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key the index of one row that has it, and for each row its key's number."""
    values, inverse = np.unique(keys, return_inverse=True)
    index = np.empty(len(values), np.int64)
    index[inverse] = np.arange(len(keys))
    return index, inverse


class Memo:
    """Remembers results for keys in two generations, so that memory is bounded and frequent keys stay."""

    def __init__(self, make: Callable[[list], list], size: int = 300_000):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def many(self, keys: list) -> list:
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        missing = []
        for i, value in enumerate(out):
            if value is None:
                if (value := old.get(keys[i])) is None:
                    missing.append(i)
                else:
                    out[i] = young[keys[i]] = value
        if missing:
            for i, value in zip(missing, self.make([keys[i] for i in missing]), strict=True):
                out[i] = young[keys[i]] = value
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out
