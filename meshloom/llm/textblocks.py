"""Vectorised text primitives inside tasks: words, lines and their 64-bit hashes over the UTF-8 bytes of an Arrow batch.

A batch is cut into slices of about a megabyte of whole documents; a document larger than that is a slice by
itself and its word hashes are still computed piece by piece, so memory stays a small multiple of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SEPARATORS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE_FOLDED = BYTE_CODE.copy()
BYTE_CODE_FOLDED[65:91] = BYTE_CODE[97:123]
IS_SEP = np.zeros(256, bool)
IS_SEP[SEPARATORS] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SHINGLE_CODE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _PINV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(data: np.ndarray, at: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets from 0) of runs of whole documents of about ``size`` bytes."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte segment; segments ascend and don't overlap. fold: A-Z as a-z."""
    out, code, i = np.empty(len(starts), np.uint64), BYTE_CODE_FOLDED if fold else BYTE_CODE, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES, "right")) - 1) if starts[-1] > starts[i] + SLICE_BYTES else len(starts)
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power_table(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(code[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * SHINGLE_CODE[63])
        i = j
    return out


def word_bounds(data: np.ndarray, at: np.ndarray, separator: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the number of words before it (one more entry than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~separator[data]
    edges = at[(at > 0) & (at < len(data))]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    before[edges] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * SHINGLE_CODE[0]
    for j in range(1, k):
        total += hashes[j : j + n] * SHINGLE_CODE[j]
    return mix64(total)


def counts_before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each position, and in all at the end."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out
