"""Hashes of all k-grams of a sequence and window minima over them (winnowing).

Winnowing (Schleimer, Wilkerson and Aiken, 2003): keep the rightmost least of
every ``w`` consecutive k-gram hashes.  Two sequences that share a span of at
least ``k + w - 1`` elements both keep the same k-gram at the same place of it.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E37_79B9_7F4A_7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51_AFD7_ED55_8CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CE_B9FE_1A85_EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k-gram at every position but the last k-1, of one or of many sequences end to end."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    up = _power(n, BASE, "up")
    down = _power(n, pow(BASE, -1, 2**64), "down")
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix(values.astype(np.uint64)) * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the place of its rightmost least one."""
    n = len(h) - w + 1
    if n < 1:
        return np.zeros(0, np.int64)
    v, at, size = h, np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        left, right = v[:-step], v[step:]
        take = right <= left
        v, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        size += step
    return at[:n]


def winnow(values: np.ndarray, starts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place in it, hash) of the kept k-grams of sequences that lie end to end in ``values``.

    A sequence with fewer than w k-grams keeps the least of those it has.
    """
    h = gram_hashes(values, k)
    lengths = np.diff(starts)
    kept = [np.zeros(0, np.int64)]
    if len(h):
        at = window_minima(h, w)
        # window j belongs to the sequence of its first element if it ends inside
        owner = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
        whole = np.arange(len(at)) + k + w - 1 <= starts[owner + 1]
        kept.append(np.unique(at[whole]))
    for i in np.flatnonzero((lengths >= k) & (lengths < k + w - 1)):
        part = h[starts[i] : starts[i] + lengths[i] - k + 1]
        kept.append(np.array([starts[i] + len(part) - 1 - np.argmin(part[::-1])]))
    at = np.unique(np.concatenate(kept))
    owner = np.searchsorted(starts, at, side="right") - 1
    return owner, at - starts[owner], h[at] if len(at) else np.zeros(0, np.uint64)
