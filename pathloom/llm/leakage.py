"""Evaluation texts that leak into training texts, by winnowed fingerprints.

Both sides are reduced to letters and digits (NFKC, case folded) and winnowed:
of every ``w`` consecutive k-gram hashes the rightmost least is kept.  With
``k + w - 1`` equal to the span that counts as a leak, every such span shared
by two texts leaves the same fingerprint at the same place of it in both.  The
fingerprints are joined; every hit is extended in both texts to the longest
equal span around it, and a pair leaks if that reaches the wanted length.

Scale.  The fingerprints of the training side that no evaluation text has are
dropped where they are made, by a Bloom filter of the evaluation fingerprints;
its size is bounded by parameter however many there are, and it loses none.  The
evaluation fingerprints go to every task if they are counted to be few, so that a
passage that very many training texts hold is no hot key; more are joined.
Training texts travel with their hits only.

Defined cases
    null texts, null ids: no hits; texts shorter than the span: no hits;
    repeated rows: a pair comes out once; empty tables: no rows;
    null language of an evaluation text: that of the longer span.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .bloom import MOST_BITS, bloom_filter, passes
from .rolling import winnow
from .spread import spread

_DROP = regex.compile(r"[^\p{L}\p{N}]+")
SPANS = ((50, 26), (20, 10))


def letters_and_digits(text: str) -> str:
    """NFKC, case folded, NFKC again (folding may undo it), letters and numbers only."""
    return _DROP.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str], span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the winnowed k-grams; texts without one k-gram have none."""
    points = [_points(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in points]))).astype(np.int64)
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    return winnow(flat, starts, k, span - k + 1)


def _parts(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Stretches of the texts of bounded length; one text is never cut."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_text`` reduced to letters and digits; null and empty ones are dropped."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = [None if t is None else letters_and_digits(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_key", "_text"])

    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL AND _text IS NOT NULL")
    return base.mapInArrow(run, base.schema).filter(F.col("_text") != "")


def extend(a: np.ndarray, at_a: int, b: np.ndarray, at_b: int, k: int) -> int:
    """The length of the longest equal span of a and b that holds the k-gram at these places; 0 if it differs."""
    if not np.array_equal(a[at_a : at_a + k], b[at_b : at_b + k]):
        return 0
    n = min(at_a, at_b)
    back = np.flatnonzero(a[at_a - n : at_a][::-1] != b[at_b - n : at_b][::-1])
    m = min(len(a) - at_a, len(b) - at_b) - k
    on = np.flatnonzero(a[at_a + k : at_a + k + m] != b[at_b + k : at_b + k + m])
    return k + int(back[0] if len(back) else n) + int(on[0] if len(on) else m)


def leaks(docs: DataFrame, evals: DataFrame, short_span: Column, doc: str = "doc_id", doc_text: str = "text", item: str = "eval_id", item_text: str = "text", spans: tuple[tuple[int, int], ...] = SPANS, filter_bits: int = MOST_BITS, most_sent: int = 1_000_000) -> DataFrame:
    """``doc``, ``item``, ``longest`` shared span, of all pairs that share one of the wanted length.

    spans: (length, k) for items in general and for those where ``short_span`` (a
    condition on ``evals``) holds; most_sent: so many evaluation fingerprints go to all tasks.
    """
    kinds = evals.select(F.col(item).alias("_key"), F.coalesce(short_span, F.lit(False)).cast("int").alias("_kind")).groupBy("_key").agg(F.max("_kind").alias("_kind"))
    items = written(normalised(evals, item, item_text).join(kinds, "_key").select("_key", "_kind", "_text").distinct(), "items")

    def item_prints(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            key, kind, texts = b.column(0), np.asarray(b.column(1)), b.column(2).to_pylist()
            for x, (span, k) in enumerate(spans):
                rows = np.flatnonzero(kind == x)
                of, place, h = fingerprints([texts[i] for i in rows], span, k)
                long = np.array([len(texts[i]) for i in rows], np.int64)[of] >= span if len(of) else np.zeros(0, bool)
                of, place, h = of[long], place[long], h[long]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(rows[of])), pa.array(np.full(len(of), x), pa.int32()), pa.array(place, pa.int32()), pa.array(h.view(np.int64))], names=["_item", "_kind", "_item_at", "_hash"])

    kind_of_item = items.schema["_key"].dataType.simpleString()
    prints = written(items.mapInArrow(item_prints, f"_item {kind_of_item}, _kind int, _item_at int, _hash long"), "item-prints")
    known = bloom_filter(prints, "_hash", filter_bits)

    def doc_prints(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(known, np.uint8)
        for b in source:
            texts = ["" if t is None else letters_and_digits(t) for t in b.column(1).to_pylist()]
            row, kind, at, print_ = [], [], [], []
            for x, (span, k) in enumerate(spans):
                for first, part in _parts(texts):
                    of, place, h = fingerprints(part, span, k)
                    seen = passes(flags, h)
                    row.append(first + of[seen])
                    kind.append(np.full(int(seen.sum()), x))
                    at.append(place[seen])
                    print_.append(h[seen].view(np.int64))
            if not row:
                continue
            row, kind, at, print_ = (np.concatenate(c) for c in (row, kind, at, print_))
            order = np.argsort(row, kind="stable")
            rows, first = np.unique(row[order], return_index=True)
            hit = pa.StructArray.from_arrays([pa.array(kind[order], pa.int32()), pa.array(at[order], pa.int32()), pa.array(print_[order], pa.int64())], names=["x", "p", "v"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), hit)
            names = b.column(0).take(pa.array(rows, pa.int64()))
            keys = [xxhash.xxh3_128_digest(repr(n).encode() + b"/" + texts[i].encode("utf-8", "surrogatepass")) for n, i in zip(names.to_pylist(), rows.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([names, pa.array([texts[i] for i in rows.tolist()], pa.string()), lists, pa.array(keys, pa.binary())], names=["_doc", "_doc_text", "_hits", "_text_key"])

    base = docs.select(F.col(doc).alias("_doc"), F.col(doc_text).alias("_doc_text")).filter("_doc IS NOT NULL AND _doc_text IS NOT NULL")
    kind_of_doc = base.schema["_doc"].dataType.simpleString()
    found = written(spread(base).mapInArrow(doc_prints, f"_doc {kind_of_doc}, _doc_text string, _hits array<struct<x:int,p:int,v:long>>, _text_key binary"), "doc-hits")
    hits = found.select("_text_key", F.explode("_hits").alias("_h"))
    hits = hits.select("_text_key", F.col("_h.x").alias("_kind"), F.col("_h.p").alias("_doc_at"), F.col("_h.v").alias("_hash"))
    pairs = hits.join(F.broadcast(prints) if prints.count() <= most_sent else prints, ["_kind", "_hash"])
    # one hit per text, item and diagonal is enough: the extension finds the same span
    pairs = pairs.groupBy("_text_key", "_item", "_kind", (F.col("_doc_at") - F.col("_item_at")).alias("_diagonal")).agg(F.collect_set(F.struct("_doc_at", "_item_at")).alias("_places"))
    texts = found.select("_text_key", "_doc", "_doc_text").dropDuplicates(["_text_key"])
    both = pairs.join(texts, "_text_key").join(items.select(F.col("_key").alias("_item"), F.col("_text").alias("_item_text")), "_item")

    def extended(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            out = []
            points: dict[str, np.ndarray] = {}
            for d, i, kind, places, x, y in zip(rows["_doc"], rows["_item"], rows["_kind"], rows["_places"], rows["_doc_text"], rows["_item_text"], strict=True):
                a = points[x] if x in points else points.setdefault(x, _points(x))
                b = points[y] if y in points else points.setdefault(y, _points(y))
                span, k = spans[kind]
                longest, done = 0, -1
                for p in sorted(places, key=lambda p: p["_doc_at"]):
                    if p["_doc_at"] + k <= done:
                        continue
                    n = extend(a, p["_doc_at"], b, p["_item_at"], k)
                    longest, done = max(longest, n), p["_doc_at"] + n
                if longest >= span:
                    out.append((d, i, longest))
            yield pd.DataFrame(out, columns=["_doc", "_item", "longest"]).astype({"longest": "int32"})

    shared = both.select("_doc", "_item", "_kind", "_places", "_doc_text", "_item_text").mapInPandas(extended, f"_doc {kind_of_doc}, _item {kind_of_item}, longest int")
    return shared.groupBy(F.col("_doc").alias(doc), F.col("_item").alias(item)).agg(F.max("longest").alias("longest"))
