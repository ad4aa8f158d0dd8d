"""Items of varying size in containers of fixed capacity, by harmonic packing.

Sizes fall into reciprocal-capacity classes: class k holds those of which k fit
into a container and k + 1 don't, and its containers take k items each, in
order of size.  What such containers leave open is given, again in fixed
counts, to items of higher classes before those open containers of their own.

Scale.  Which container an item goes to depends on its size and its number
among the items of that size alone.  The plan is therefore made from the
histogram of sizes, whose length is at most the capacity however many items
there are, and every worker looks its items up in the plan by itself.  Numbers
within a size come from counts per (size, hash bucket), so that no task ever
holds all items of a size.

An item over the capacity is cut into pieces of exactly the capacity and a
rest; no other item is divided.

Defined cases
    null or empty text, size null or 0: takes no room and no container;
    equal ids or rows: an item each; null id: an item; empty table: no rows.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .spread import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUTS = (8, 24)
_encodings: dict[int, object] = {}


def token_sizes(df: DataFrame, item: str, text: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``_item``, ``_size`` (tokens of the text; null for a null text).  tokenizer: a file of byte-pair ranks, read on the driver."""
    with open(tokenizer, "rb") as f:
        lines = f.read()

    def sized(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        key = hash((lines, pattern))
        if key not in _encodings:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
            _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _encodings[key].encode_ordinary
        for b in source:
            sizes = [None if t is None else len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["_item", "_size"])

    base = df.select(F.col(item).alias("_item"), F.col(text).alias("_text"))
    return spread(base).mapInArrow(sized, f"_item {base.schema['_item'].dataType.simpleString()}, _size long")


def harmonic_plan(counts: dict[int, int], capacity: int, cuts: tuple[int, ...] = CUTS) -> list[tuple[int, int, int, int, int]]:
    """(size, first, n, container, per): item number ``first + i`` of ``size``, i < n, goes to ``container + i // per``."""
    left = {s: c for s, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def take(size: int, n: int, container: int, per: int) -> None:
        plan.append((size, used[size], n, container, per))
        used[size] += n
        left[size] -= n

    low = 1
    for high in (*cuts, capacity + 1):
        open_: list[tuple[int, int, int]] = []  # (-room, container, how many)
        part, room = -1, 0
        for s in sorted((s for s in left if left[s] and low <= capacity // s < high), reverse=True):
            k = capacity // s
            if full := left[s] // k:
                take(s, full * k, containers, k)
                open_.append((k * s - capacity, containers, full))
                containers += full
            # the few left over share containers with those of the next sizes
            while left[s]:
                if room < s:
                    if part >= 0:
                        open_.append((-room, part, 1))
                    part, room, containers = containers, capacity, containers + 1
                n = min(left[s], room // s)
                take(s, n, part, n)
                room -= n * s
        if part >= 0:
            open_.append((-room, part, 1))
        fillers: list[int] = []
        for s in left:
            if left[s] and capacity // s >= high:
                insort(fillers, s)
        heapq.heapify(open_)
        while open_ and fillers:
            room, at, n = heapq.heappop(open_)
            i = bisect_right(fillers, -room) - 1
            if i < 0:
                continue
            s = fillers[i]
            per = max(1, min(-room // s, left[s] // n))
            m = min(n, left[s])
            take(s, m * per, at, per)
            if not left[s]:
                fillers.pop(i)
            heapq.heappush(open_, (room + per * s, at, m))
            if n > m:
                heapq.heappush(open_, (room, at + m, n - m))
        low = high
    return plan


def pack(sizes: DataFrame, capacity: int = 2048, cuts: tuple[int, ...] = CUTS, bucket_rows: int = 100_000) -> DataFrame:
    """sizes: _item, _size.  ``_item``, ``piece`` (from 1), ``first_token``, ``n_tokens``, ``container``."""
    whole, rest = F.floor(F.col("_size") / capacity), F.col("_size") % capacity
    pieces = F.transform(F.sequence(F.lit(1), (whole + F.when(rest > 0, 1).otherwise(0)).cast("int")), lambda i: i)
    items = sizes.filter("_size > 0").select("_item", "_size", F.explode(pieces).alias("piece"))
    items = items.select("_item", "piece", ((F.col("piece") - 1) * F.lit(capacity).cast("long") + 1).alias("first_token"), F.when(F.col("piece") <= whole, F.lit(capacity)).otherwise(rest).cast("int").alias("n_tokens"))
    items = written(items, "items")
    buckets = 1 + items.count() // bucket_rows
    items = items.withColumn("_bucket", F.pmod(F.xxhash64("_item", "piece"), F.lit(buckets)))
    groups = items.groupBy("n_tokens", "_bucket").agg(F.count("*").alias("_n"))
    groups = written(groups, "size-counts")
    counts = {r[0]: r[1] for r in groups.groupBy("n_tokens").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    plan = np.array(sorted(harmonic_plan(counts, capacity, cuts)) or [(0, 0, 0, 0, 1)], np.int64)
    before = F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("n_tokens", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("n_tokens", "_bucket").orderBy("_item", "piece")) - 1
    numbered = items.withColumn("_nth", nth).join(offsets, ["n_tokens", "_bucket"])
    numbered = numbered.select("_item", "piece", "first_token", "n_tokens", (F.col("_nth") + F.col("_before")).cast("long").alias("_number"))

    def placed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] << 44 | plan[:, 1]
        for b in source:
            size, number = np.asarray(b.column(3)).astype(np.int64), np.asarray(b.column(4))
            at = np.searchsorted(key, size << 44 | number, side="right") - 1
            container = plan[at, 3] + (number - plan[at, 1]) // plan[at, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container)], names=["_item", "piece", "first_token", "n_tokens", "container"])

    kind = items.schema["_item"].dataType.simpleString()
    return numbered.mapInArrow(placed, f"_item {kind}, piece int, first_token long, n_tokens int, container long")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, items, tokens, the share of room used, and the least number of containers any packing needs."""
    room = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    total = F.coalesce(F.sum("t"), F.lit(0))
    return room.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), total.alias("tokens"), F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("fill"), F.ceil(total / capacity).alias("least_containers"), F.max("t").alias("fullest"))
