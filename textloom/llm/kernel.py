"""Words of many texts at once, in numpy over the bytes of an Arrow column.

A word's hash is a polynomial over random values of its bytes, taken from prefix sums (all modulo 2**64) and mixed; a run of
words is hashed from its words' hashes. Equal words have equal hashes everywhere, in each process and run. Two different
ones collide with a chance of about 2**-64 a pair, which results leave out of account.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 64, 256, dtype=U)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_STEP = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_STEP), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 64, 64, dtype=U) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of texts handled at a time; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        _powers[name] = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1 << 16), base, U)]), dtype=U)
    return _powers[name][:n]


@dataclass
class Words:
    """start, end: bytes of each word; hash; of: the text each word is in; first: index of each text's first word, and after
    the last text's the number of all words; data, bounds: the bytes and where each text begins."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and the indices of words from which n are left in their text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.zeros(m, U)
        for k in range(n):
            h += self.hash[k : k + m] * _PLACE[k]
        at = np.flatnonzero(self.of[:m] == self.of[n - 1 : n - 1 + m])
        return mix(h[at]), at


def words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(0, U), none, np.zeros(len(bounds), np.int64))
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]))
    end = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1
    sums = np.concatenate([[U(0)], np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * _power("step", _STEP, n), dtype=U)])
    hashes = mix((sums[end] - sums[start]) * _power("back", _BACK, n)[start] + (end - start).astype(U))
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, end, hashes, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def text_batches(column: pa.Array, size: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) for stretches of a string column without nulls, each of about `size` bytes."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        to = min(to, len(column))
        yield row, to, raw[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, values being in the texts' order and first as in Words."""
    run = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return run[first[1:]] - run[first[:-1]]
