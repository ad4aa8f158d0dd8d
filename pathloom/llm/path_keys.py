"""Keys of path records in one spelling: shard, function address, split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = " \t\n\r\x0b\x0c"


def shard_name(file_name: Column) -> Column:
    """The trimmed part after the last ``/``."""
    return F.btrim(F.substring_index(file_name, "/", -1), F.lit(_BLANK))


def address(func_addr: Column) -> Column:
    """A hexadecimal number without prefix and leading zeros; null if it is none."""
    a = F.lower(F.btrim(func_addr, F.lit(_BLANK)))
    a = F.when(a.startswith("0x"), F.substring(a, F.lit(3), F.length(a))).otherwise(a)
    digits = F.ltrim(a, F.lit("0"))
    return F.when(a.rlike("^[0-9a-f]+$"), F.when(digits == "", "0").otherwise(digits))


def split_name(split: Column) -> Column:
    return F.lower(F.btrim(split, F.lit(_BLANK)))
