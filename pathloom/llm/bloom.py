"""A Bloom filter of a column of 64-bit hashes, of bounded size.

It has 16 bits a hash, counted, up to a greatest size fixed by parameter, and
never loses a hash: past that size it only lets more others through, so whoever
has more hashes than ``fits`` joins them instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rolling import mix

MOST_BITS = 1 << 29
PER_HASH = 16


def fits(hashes: int, most_bits: int = MOST_BITS) -> bool:
    """Whether so many hashes have ``PER_HASH`` bits each."""
    return hashes * PER_HASH <= most_bits


def _places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Three places of each hash, each among all of the filter's."""
    h = np.ascontiguousarray(hashes).view(np.uint64)
    second = mix(h ^ np.uint64(0x2545_F491_4F6C_DD1D))
    return [(x % np.uint64(size)).astype(np.int64) for x in (h, second, mix(second))]


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    """Sets bits of a packed filter."""
    at = np.sort(at)
    byte = at >> 3
    first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(at) else at
    if len(at):
        packed[byte[first]] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)


def bloom_filter(df: DataFrame, column: str, most_bits: int = MOST_BITS) -> bytes:
    """The filter of a stored table's column; each of at most eight tasks holds and sends one of its size."""
    bits = min(most_bits, max(1 << 10, 1 << (PER_HASH * max(1, df.count()) - 1).bit_length()))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits // 8, np.uint8)
        for b in source:
            for at in _places(np.asarray(b.column(0)), bits):
                _set(flags, at)
        yield pa.RecordBatch.from_arrays([pa.array([flags.tobytes()], pa.binary())], names=["_f"])

    total = np.zeros(bits // 8, np.uint8)
    for r in df.select(column).coalesce(8).mapInArrow(run, "_f binary").toLocalIterator():
        total |= np.frombuffer(bytes(r[0]), np.uint8)
    return total.tobytes()


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    size = len(packed) * 8
    seen = np.ones(len(hashes), bool)
    for at in _places(hashes, size):
        seen &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return seen
