"""Long exact token spans shared between records of different owners.

A de Bruijn graph whose edges are the token k-mers, k being the wanted length:
two records share a span of that length exactly if they share an edge.

1. Filter.  Every span of k tokens leaves a winnowed seed, a shorter k-mer, at
   the same place in all records that hold it.  Seeds of one owner only are
   left behind; those of several go into a Bloom filter of bounded size, or are
   joined with their places where they are too many for it.
2. Graph.  The second scan emits the k-mers around the seeds that pass.  Those
   of several owners are the edges that repeat; two of them that follow each
   other in every record that has either belong to one nonbranching path.
   Joins on the counts of edges and of successions flag where paths begin, and
   each record's edges are compacted into the paths it runs through.
3. Pairs.  Records meet on compacted paths, not on single k-mers, and only if a
   second, independent hash of the span at their source coordinates agrees.

A path is run through whole by each record that enters it, so records of one
path form a group of true matches: no candidate pair is made that is not a
result.  Where pairs are not wanted, ``shared_share`` and ``span_members`` give
one row per record or membership.  Edges, seeds and paths that many records have
are counted before they are shuffled; joins with them are inner, left or semi
ones on counted rows, which Spark splits where a key is hot.

Defined cases
    null or empty list, null owner key, null id: take no part;
    null token: equals other null tokens;
    repeated rows of one id: count once in the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.once import once
from ..sources.shared import written
from .arrow_tokens import TokenBatch, batches, token_batch
from .bloom import MOST_BITS, bloom_filter, fits, passes
from .rolling import gram_hashes, mix, winnow

_SECOND = np.uint64(0x2545_F491_4F6C_DD1D)


def _long(df: DataFrame, record: str, tokens: str, owner: Column, least: int) -> DataFrame:
    """_record, _owner (a hash), _tokens of the records that can share a span."""
    base = once(df.select(F.col(record).alias("_record"), owner.alias("_o"), F.col(tokens).alias("_tokens")), "_record", nulls=False)
    base = base.filter(F.col("_record").isNotNull() & F.col("_o").isNotNull() & (F.size("_tokens") >= least))
    return base.select("_record", F.xxhash64("_o").alias("_owner"), "_tokens")


def _seed_sizes(least: int) -> tuple[int, int]:
    k = (least + 2) // 2
    return k, least - k + 1


def repeated_edges(df: DataFrame, record: str, tokens: str, owner: Column, least: int = 50, filter_bits: int = MOST_BITS) -> DataFrame:
    """The occurrences of k-mers that records of several owners have: _record, _owner, _pos (from 1), _edge, _check, _n (occurrences)."""
    k, w = _seed_sizes(least)
    base = _long(df, record, tokens, owner, least)
    kind = base.schema["_record"].dataType.simpleString()

    def seeds(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            flat = token_batch(b.column(1))
            of, _, h = winnow(flat.hashes[flat.codes], flat.starts, k, w)
            owners = np.asarray(b.column(0))[of]
            # one row per owner and seed of the batch
            order = np.lexsort((owners, h))
            h, owners = h[order], owners[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owners[1:] != owners[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(owners[new])], names=["_seed", "_owner"])

    found = base.select("_owner", "_tokens").mapInArrow(seeds, "_seed long, _owner long")
    several = written(found.groupBy("_seed").agg(F.min("_owner").alias("_a"), F.max("_owner").alias("_b")).filter("_a <> _b").select("_seed"), "seeds")
    filtered = fits(several.count(), filter_bits)
    known = bloom_filter(several, "_seed", filter_bits) if filtered else b""

    def around_seeds(b: pa.RecordBatch, flat: TokenBatch, values: np.ndarray, of: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """The k-mers of the wanted length that hold one of the seeds at ``place`` of the sequences ``of``."""
        at = flat.starts[of] + place
        near = np.zeros(len(values) + 1, np.int64)
        np.add.at(near, np.maximum(at - (least - k), flat.starts[of]), 1)
        np.add.at(near, np.minimum(at, flat.starts[of + 1] - least) + 1, -1)
        start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        start = start[start + least <= len(values)]
        row = np.searchsorted(flat.starts, start, side="right") - 1
        keep = start + least <= flat.starts[row + 1]
        start, row = start[keep], row[keep]
        edge = gram_hashes(values, least)[start]
        check = gram_hashes(mix(values ^ _SECOND), least)[start]
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(rows), b.column(1).take(rows), pa.array((start - flat.starts[row] + 1).astype(np.int32)), pa.array(edge.view(np.int64)), pa.array(check.view(np.int64))],
            names=["_record", "_owner", "_pos", "_edge", "_check"],
        )

    def edges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(known, np.uint8)
        for b in batches(source):
            flat = token_batch(b.column(2))
            values = flat.hashes[flat.codes]
            of, place, h = winnow(values, flat.starts, k, w)
            hit = passes(packed, h)
            yield around_seeds(b, flat, values, of[hit], place[hit])

    def places(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            flat = token_batch(b.column(1))
            of, place, h = winnow(flat.hashes[flat.codes], flat.starts, k, w)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], names=["_record", "_place", "_seed"])

    def edges_at(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            flat = token_batch(b.column(2))
            n = b.column(3).value_lengths().to_numpy()
            yield around_seeds(b, flat, flat.hashes[flat.codes], np.repeat(np.arange(len(n)), n), b.column(3).flatten().to_numpy().astype(np.int64))

    if not filtered:
        # seeds beyond the filter: their places are joined, and go back to their records
        hits = base.select("_record", "_tokens").mapInArrow(places, f"_record {kind}, _place int, _seed long").join(several, "_seed", "left_semi")
        base = base.join(hits.groupBy("_record").agg(F.collect_list("_place").alias("_places")), "_record")
        edges = edges_at
    around = written(base.mapInArrow(edges, f"_record {kind}, _owner long, _pos int, _edge long, _check long"), "edges")
    counts = around.groupBy("_edge").agg(F.min("_owner").alias("_a"), F.max("_owner").alias("_b"), F.count("*").alias("_n")).filter("_a <> _b").select("_edge", "_n")
    return written(around.join(counts, "_edge"), "repeated-edges")


def span_members(edges: DataFrame, least: int = 50) -> DataFrame:
    """Compaction: _path (the first edge of a nonbranching path), _check, _record, _owner, _start, _end, one row per record and path."""
    along = Window.partitionBy("_record").orderBy("_pos")
    gap = F.col("_pos") - F.lag("_pos").over(along)
    steps = edges.withColumn("_before", F.when(gap == 1, F.lag("_edge").over(along))).withColumn("_n_before", F.when(gap == 1, F.lag("_n").over(along)))
    steps = written(steps, "steps")
    follows = steps.filter("_before IS NOT NULL").groupBy("_before", "_edge").agg(F.count("*").alias("_m"))
    flagged = steps.join(follows, ["_before", "_edge"], "left")
    begins = ~F.coalesce((F.col("_m") == F.col("_n")) & (F.col("_m") == F.col("_n_before")), F.lit(False))
    nth = F.sum(begins.cast("int")).over(along)
    runs = flagged.select("_record", "_owner", "_pos", "_edge", "_check", nth.alias("_nth")).groupBy("_record", "_owner", "_nth")
    first = F.min(F.struct("_pos", "_edge", "_check")).alias("_f")
    runs = runs.agg(first, (F.max("_pos") + least - 1).alias("_end"))
    return runs.select(F.col("_f._edge").alias("_path"), F.col("_f._check").alias("_check"), "_record", "_owner", F.col("_f._pos").alias("_start"), "_end")


def shared_pairs(df: DataFrame, record: str, tokens: str, owner: Column, least: int = 50, filter_bits: int = MOST_BITS) -> DataFrame:
    """``a`` < ``b``: records of different owners with a common span of ``least`` tokens."""
    members = span_members(repeated_edges(df, record, tokens, owner, least, filter_bits), least)
    members = written(members.select("_path", "_check", "_record", "_owner").distinct(), "span-members")
    x, y = members.alias("x"), members.alias("y")
    same = (F.col("x._path") == F.col("y._path")) & (F.col("x._check") == F.col("y._check")) & (F.col("x._owner") != F.col("y._owner")) & (F.col("x._record") < F.col("y._record"))
    return x.join(y, same).select(F.col("x._record").alias("a"), F.col("y._record").alias("b")).distinct()


def shared_share(df: DataFrame, record: str, tokens: str, owner: Column, least: int = 50, filter_bits: int = MOST_BITS) -> DataFrame:
    """``record``, ``n_tokens``, ``shared_tokens``, ``share`` of every record with an id."""
    members = written(span_members(repeated_edges(df, record, tokens, owner, least, filter_bits), least), "span-members")
    several = members.groupBy("_path", "_check").agg(F.min("_owner").alias("_a"), F.max("_owner").alias("_b")).filter("_a <> _b").select("_path", "_check")
    spans = members.join(several, ["_path", "_check"], "left_semi")
    # the tokens that a span adds to those before it
    before = F.max("_end").over(Window.partitionBy("_record").orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.col("_end") - F.greatest(F.col("_start") - 1, F.coalesce(before, F.lit(0))), F.lit(0))
    covered = spans.select("_record", more.alias("_c")).groupBy("_record").agg(F.sum("_c").alias("_c"))
    sizes = df.select(F.col(record).alias("_record"), F.greatest(F.size(tokens), F.lit(0)).alias("_n")).filter("_record IS NOT NULL").groupBy("_record").agg(F.max("_n").alias("_n"))
    shared = F.coalesce(F.col("_c"), F.lit(0)).cast("long")
    share = F.when(F.col("_n") > 0, F.round(shared / F.col("_n"), 6)).otherwise(0.0)
    return sizes.join(covered, "_record", "left").select(F.col("_record").alias(record), F.col("_n").cast("long").alias("n_tokens"), shared.alias("shared_tokens"), share.alias("share"))
