"""Items over a size limit, cut at natural boundaries into overlapping pieces.

Every position of an item is given its successor: the start of the next piece
if a piece starts there.  A piece ends with the last boundary within the limit,
or at the limit, and the next one starts ``overlap`` tokens earlier.  The
pieces of an item are what is reached from its first position.  Pointer
doubling finds them: the successor table is joined with itself, which doubles
its stride, and every squaring doubles the cuts known, for all items of a batch
at once.  An item lies whole in one row, so the tables are squared where the
row is and nothing is shuffled but the pieces.

Defined cases
    null or empty list, or one within the limit: no pieces, or with
    ``keep_small`` one piece (none for null and empty lists);
    null token: counts as a token that ends no block;
    repeated item id: its pieces come out once; null id: pieces of all such
    rows come out, equal ones once;
    no boundary in reach: a cut at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_tokens import batches, token_batch

BLOCK_ENDS = ("JK_", "<API_", "<SYSCALL_")


def greedy_pieces(ends: np.ndarray, starts: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, natural) of all pieces, as flat 0-based positions.

    ``ends`` flags the boundaries of sequences that lie end to end, delimited by ``starts``.
    """
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    place = np.arange(n)
    stop = np.repeat(starts[1:], np.diff(starts))  # of the sequence of each position
    boundary = np.maximum.accumulate(np.where(ends, place, -1))
    reach = np.minimum(place + limit - 1, n - 1)
    cut = boundary[reach]
    last_piece = stop - place <= limit
    natural = (cut >= place + overlap) & ~last_piece
    cut = np.where(last_piece, stop - 1, np.where(natural, cut, place + limit - 1))
    step = np.where(last_piece, place, cut - overlap + 1)
    reached = np.zeros(n, bool)
    reached[starts[:-1][np.diff(starts) > 0]] = True
    while True:
        grown = reached.copy()
        grown[step[reached]] = True
        if np.array_equal(grown, reached):
            break
        reached, step = grown, step[step]
    first = np.flatnonzero(reached)
    return first, cut[first], natural[first]


def split_oversized(df: DataFrame, item: str = "path_id", tokens: str = "tokens", limit: int = 512, overlap: int = 32, block_ends: tuple[str, ...] = BLOCK_ENDS, keep_small: bool = False) -> DataFrame:
    """Pieces: the item, ``start_pos``, ``end_pos`` (from 1), ``n_tokens``, ``at_block_end``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    least = 0 if keep_small else limit
    long = df.select(F.col(item).alias("_item"), F.col(tokens).alias("_tokens")).filter(F.size("_tokens") > least)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            flat = token_batch(b.column(1))
            is_end = np.array([w is not None and w.startswith(block_ends) for w in flat.words] or [False])
            first, last, natural = greedy_pieces(is_end[flat.codes], flat.starts, limit, overlap)
            row = np.searchsorted(flat.starts, first, side="right") - 1
            base = flat.starts[row] - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(first - base), pa.array(last - base), pa.array(last - first + 1), pa.array(natural)],
                names=["_item", "start_pos", "end_pos", "n_tokens", "at_block_end"],
            )

    kind = long.schema["_item"].dataType
    schema = T.StructType([T.StructField("_item", kind), *(T.StructField(c, T.LongType()) for c in ("start_pos", "end_pos", "n_tokens")), T.StructField("at_block_end", T.BooleanType())])
    return long.mapInArrow(cut, schema).distinct().withColumnRenamed("_item", item)
