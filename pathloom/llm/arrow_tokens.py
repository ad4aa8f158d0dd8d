"""Token arrays as flat integer codes, and a compact form of them for shuffles.

A batch of token lists becomes one dictionary of the batch's distinct strings
and one code per token, so that everything after works on numpy arrays.  Two
tokens are equal when their strings are: across batches they are compared by a
64-bit hash of the string.

The packed form of one list is self-contained::

    uint16 or uint32 count of distinct tokens | their 64-bit hashes | one index per token

with indexes of one byte up to 256 distinct tokens, of two up to 65,536 and of
four beyond; the first byte says which.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

NULL_TOKEN = np.uint64(0x5A17_0F0E_11D0_0B5E)
_DENSE = 50_000_000
_KNOWN: dict[str | None, int] = {}


def hash_strings(strings: list[str | None]) -> np.ndarray:
    """64-bit hashes; a null has a hash of its own."""
    if len(_KNOWN) > 1_000_000:
        _KNOWN.clear()
    out = np.empty(len(strings), np.uint64)
    for i, s in enumerate(strings):
        h = _KNOWN.get(s)
        if h is None:
            h = _KNOWN[s] = int(NULL_TOKEN) if s is None else xxhash.xxh64_intdigest(s.encode())
        out[i] = h
    return out


@dataclass
class TokenBatch:
    """Lists of a batch, flat.  A null list counts as empty."""

    words: list[str | None]
    codes: np.ndarray
    starts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths)

    @property
    def hashes(self) -> np.ndarray:
        return hash_strings(self.words)


def token_batch(column: pa.Array) -> TokenBatch:
    """The flat form of a list<string> column."""
    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    coded = flat.dictionary_encode(null_encoding="encode")
    return TokenBatch(coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int32), np.concatenate(([0], np.cumsum(n))))


def row_counts(batch: TokenBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of every distinct token of every row, by row."""
    k, n = max(1, len(batch.words)), len(batch.starts) - 1
    pairs = batch.rows * k + batch.codes
    if n * k <= _DENSE:
        counts = np.bincount(pairs, minlength=n * k)
        at = np.flatnonzero(counts)
        return at // k, at % k, counts[at]
    at, counts = np.unique(pairs, return_counts=True)
    return at // k, at % k, counts


def pack(batch: TokenBatch) -> list[bytes]:
    """The packed form of every row."""
    row, code, _ = row_counts(batch)
    k, n = max(1, len(batch.words)), len(batch.starts) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    local = np.searchsorted(row * k + code, batch.rows * k + batch.codes) if n * k > _DENSE else None
    if local is None:
        place = np.zeros(n * k, np.int32)
        place[row * k + code] = np.arange(len(row))
        local = place[batch.rows * k + batch.codes]
    local = local - first[batch.rows]
    names = batch.hashes[code]
    out = []
    s, f = batch.starts.tolist(), first.tolist()
    one, two = local.astype(np.uint8), local.astype(np.uint16)
    for i in range(n):
        d = f[i + 1] - f[i]
        if d <= 256:
            kind, index = b"\x01", one[s[i] : s[i + 1]]
        elif d <= 65_536:
            kind, index = b"\x02", two[s[i] : s[i + 1]]
        else:
            kind, index = b"\x04", local[s[i] : s[i + 1]].astype(np.uint32)
        out.append(kind + d.to_bytes(4, "little") + names[f[i] : f[i + 1]].tobytes() + index.tobytes())
    return out


def unpack(data: bytes) -> np.ndarray:
    """The 64-bit hashes of a packed list, in order."""
    d = int.from_bytes(data[1:5], "little")
    names = np.frombuffer(data, np.uint64, d, 5)
    return names[np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]], -1, 5 + 8 * d)] if d else names


def batches(source: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has more than ``most`` list elements or one row."""
    for b in source:
        lists = [c for c in b.columns if pa.types.is_list(c.type)]
        n = sum(np.asarray(pc.fill_null(pc.list_value_length(c), 0)).astype(np.int64) for c in lists) if lists else np.zeros(b.num_rows, np.int64)
        group = np.cumsum(n) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y > x:
                yield b.slice(x, y - x)
