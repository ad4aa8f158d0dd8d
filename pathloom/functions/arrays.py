"""Column functions on token and id arrays: padding, masks, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNK, MASK = 0, 1, 2


def pad_truncate(ids: Column, length: int, pad: int = PAD) -> Column:
    """Exactly ``length`` ids, cut or filled at the right."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def bos_eos(ids: Column, bos: int, eos: int, length: int) -> Column:
    """The first ``length - 2`` ids between two marks."""
    return F.concat(F.array(F.lit(bos)), F.slice(ids, 1, length - 2), F.array(F.lit(eos)))


def real_length(ids: Column) -> Column:
    return F.size(F.array_remove(ids, PAD))


def _span(ids: Column, first: Column, last: Column) -> Column:
    """True from ``first`` to before ``last``, else false; as long as ids."""
    n = F.size(ids)
    first = F.least(F.greatest(first.cast("int"), F.lit(0)), n)
    last = F.greatest(F.least(last.cast("int"), n), first)
    return F.concat(F.array_repeat(F.lit(False), first), F.array_repeat(F.lit(True), last - first), F.array_repeat(F.lit(False), n - last))


def thirds_mask(ids: Column) -> tuple[Column, Column]:
    n = real_length(ids)
    return _span(ids, F.floor(n / 3), n), _span(ids, F.floor(n * 2 / 3), n)


def last_token_mask(ids: Column) -> tuple[Column, Column]:
    n = real_length(ids)
    return _span(ids, F.floor(n * 2 / 3), n), _span(ids, n - 1, n)


def random_token_mask(ids: Column, key: Column, seed: int = 0) -> tuple[Column, Column]:
    """One real place, drawn by the hash of key and seed; none in an array of padding."""
    n = real_length(ids)
    at = F.when(n > 0, F.pmod(F.xxhash64(key, F.lit(seed)), n.cast("long")))
    one = F.when(n > 0, _span(ids, at, at + 1)).otherwise(F.array_repeat(F.lit(False), F.greatest(F.size(ids), F.lit(0))))
    return one, one


def random_block_mask(ids: Column, key: Column, block: int, seed: int = 0) -> tuple[Column, Column]:
    """``block`` places in a row, where they start drawn by the hash of key and seed."""
    room = F.greatest(F.size(ids) - F.lit(block) + 1, F.lit(1))
    at = F.pmod(F.xxhash64(key, F.lit(seed)), room.cast("long"))
    m = _span(ids, at, at + block)
    return m, m


#: Mask strategies by name: ids and a key to an input and a prediction mask.
MASKS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "thirds": lambda ids, _: thirds_mask(ids),
    "last_token": lambda ids, _: last_token_mask(ids),
    "random_token": random_token_mask,
    "random_block": lambda ids, key: random_block_mask(ids, key, 8),
}


def apply_mask(ids: Column, mask: Column, with_: int = MASK) -> Column:
    return F.zip_with(ids, mask, lambda x, m: F.when(m, with_).otherwise(x))


def unlikeness(a: Column, b: Column) -> Column:
    """Places that differ, of the length of the longer array."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.try_divide(differ.cast("double"), F.greatest(F.size(a), F.size(b)).cast("double"))


def overflow(tokens: Column, most: int) -> Column:
    """At most ``most`` tokens, the last of which counts those left out."""
    left = F.size(tokens) - F.lit(most - 1)
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, most - 1), F.array(F.concat(F.lit("…+"), left.cast("string")))))


def joined(values: Column) -> Column:
    """An array as text, for display and comparison."""
    return F.array_join(values.cast("array<string>"), " ")
