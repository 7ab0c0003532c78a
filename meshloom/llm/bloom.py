"""Bloom filters of what was seen once and what was seen twice or more, merged over all tasks of a table.

The counters of a counting Bloom filter that stop at two are two Bloom filters. A 64-bit hash has a place in each of two
halves: its upper and its lower 32 bits. A task emits the places that it met as sorted differences, in SEGMENTS pieces
(about two bytes a place, however few it met; a dense filter of its own would be far larger than what most tasks see).
Each segment is merged as a stream in one task: a place met by two tasks, or twice by one, is seen twice.

The merged filter has about BITS_PER_HASH bits for each hash, and never more than 2 ** MOST_BITS (64 MB), so every task can
have it. Beyond that size more hashes are suspected; a hash that occurs twice is always suspected, so results do not change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEGMENTS = 256
BITS_PER_HASH = 16
LEAST_BITS = 16
MOST_BITS = 29
#: Hashes that a task gathers before it emits their places.
FLUSH = 1 << 21
_PARTIAL = "segment int, n long, once binary, twice binary"


def _halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)


def _coded(places: np.ndarray) -> bytes:
    """The width of a difference in bytes, then the differences of ascending places."""
    if not len(places):
        return b""
    steps = np.diff(places, prepend=np.uint32(0))
    width = next(w for w in (1, 2, 4) if int(steps[1:].max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + places[:1].astype("<u4").tobytes() + steps[1:].astype(f"<u{width}").tobytes()


def _decoded(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint32)
    steps = np.frombuffer(data, f"<u{data[0]}", offset=5).astype(np.uint32)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u4", 1, 1), steps]), dtype=np.uint32)


def _partial_rows(hashes: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    for half, places in enumerate(_halves(hashes)):
        found, times = np.unique(places, return_counts=True)
        bounds = np.searchsorted(found, np.arange(SEGMENTS // 2 + 1, dtype=np.uint64) << np.uint64(25))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            low, high = bounds[s], bounds[s + 1]
            some, many = found[low:high], times[low:high] > 1
            yield half * SEGMENTS // 2 + s, 0 if half else int(times[low:high].sum()), _coded(some[~many]), _coded(some[many])


def partials(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """The places of all hashes (uint64) that ``hashes_of`` finds in ``rows``, by task and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(gathered: list[np.ndarray]) -> pa.RecordBatch:
            found = list(_partial_rows(np.concatenate(gathered)))
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["segment", "n", "once", "twice"])

        gathered, n = [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                gathered.append(hashes)
                n += len(hashes)
                if n >= FLUSH:
                    yield table(gathered)
                    gathered, n = [], 0
        if n:
            yield table(gathered)

    return rows.mapInArrow(run, _PARTIAL)


def _merged(parts: DataFrame, bits: int) -> DataFrame:
    """segment and the bits of what was seen twice there, in a filter of 2 ** bits."""
    shift, size = 33 - bits, (1 << bits) // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, once_, twice_ in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                once, twice = seen.setdefault(segment, (np.zeros(size, bool), np.zeros(size, bool)))
                one, two = (((_decoded(x) >> np.uint32(shift)) & np.uint32(size - 1)) for x in (once_, twice_))
                fresh = np.ones(len(one), bool)
                fresh[1:] = one[1:] != one[:-1]
                twice[one[~fresh]] = True
                one = one[fresh]
                twice[one[once[one]]] = True
                twice[two] = once[two] = once[one] = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(t).tobytes() for _, t in seen.values()], pa.binary())], names=["segment", "bits"])

    return parts.repartition("segment").mapInArrow(run, "segment int, bits binary")


class SeenTwice:
    """Tells in any task whether a hash may have been seen twice; what was, is never denied."""

    def __init__(self, rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], most_bits: int = MOST_BITS):
        parts = materialise(partials(rows, hashes_of), "partial-filters")
        self.hashes = parts.agg(F.sum("n")).first()[0] or 0
        self.bits = min(most_bits, max(LEAST_BITS, (BITS_PER_HASH * self.hashes - 1).bit_length()))
        whole = np.zeros((1 << self.bits) // 8, np.uint8)
        size = len(whole) // SEGMENTS
        for segment, bits in _merged(parts, self.bits).collect():  # at most 2 ** MOST_BITS bits in all
            whole[segment * size : (segment + 1) * size] = np.frombuffer(bits, np.uint8)
        self._twice = rows.sparkSession.sparkContext.broadcast(whole)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "_twice": self._twice}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        twice, found = self._twice.value, np.ones(len(hashes), bool)
        for half, places in enumerate(_halves(hashes)):
            at = (places >> np.uint32(33 - self.bits)).astype(np.int64) + (half << (self.bits - 1))
            found &= (twice[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return found
