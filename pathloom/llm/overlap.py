"""Records of evaluation splits that occur again, exactly or nearly, in training records.

An edit distance of d leaves at least one of any d + 1 pieces of a text
untouched.  Every evaluation text is therefore cut into one piece more than the
greatest distance allowed, and the pieces are the passages of Aho-Corasick
automata that scan all training texts.  The intervals matched on about the same
diagonal are merged into the coverage of an evaluation text by a training text;
pairs with fewer pieces than the distance must leave are dropped, then those
whose token counts alone differ too much, and the edit distance decides the
rest.  The pieces are all that a pair needs, so none is lost.

Scale.  Exact copies are one text from the start, on either side, and return
as members at the end.  Only texts of about equal length can be near copies:
training texts are spread by bands of length, and the automaton of a band holds
the evaluation texts within reach of its lengths, so that every training text
is scanned once by an automaton that is a fraction of the whole.  A band with
more than ``passages`` passages has several automata, one held at a time, and a
band with more training text than a task should have goes to several tasks, so
memory grows with neither side.  The evaluation side lies in the shared folder.

Defined cases
    null or unknown split: takes no part; null or short token lists: no pairs;
    null token: equals other null tokens; null id: takes no part;
    repeated rows of one id: count once; empty tables: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import write_shared, written
from .arrow_tokens import batches, pack, token_batch, unpack

PASSAGES = 600_000
BAND = 1.25
SLICE_TOKENS = 6_000_000
EXPANDED = 4_000_000
_BUCKETS = 64
_held: dict[str, "Shard"] = {}


def edit_distance(a: list[int], b: list[int]) -> int:
    """Levenshtein distance, bit-parallel (Myers 1999 in Hyyrö's form)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        match = places.get(x, 0) | down
        zero = (((match & up) + up) ^ up) | match
        right, left = down | (full & ~(zero | up)), zero & up
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full & ~(zero | right)), right & zero
    return score


def within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance if it is at most ``most``."""
    n = min(len(a), len(b))
    head = np.flatnonzero(a[:n] != b[:n])
    x = int(head[0]) if len(head) else n
    a, b, n = a[x:], b[x:], n - x
    tail = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    y = int(tail[0]) if len(tail) else n
    d = edit_distance(a[: len(a) - y].tolist(), b[: len(b) - y].tolist())
    return d if d <= most else None


def allowed(n: np.ndarray | int, share: float) -> np.ndarray:
    """The greatest whole distance for a longer text of n tokens."""
    return np.floor(np.asarray(n) * share + 1e-9).astype(np.int64)


def pieces_of(n: int, share: float) -> int:
    """One more than the greatest distance to any text that a text of n tokens can be near to."""
    return int(allowed(int(math.floor(n / (1 - share) + 1e-9)), share)) + 1


def as_text(values: np.ndarray) -> str:
    """One character per token, by its hash; equal tokens give equal characters."""
    return (0x10000 + (values & np.uint64(0xFFFFF)).astype(np.uint32)).astype("<u4").tobytes().decode("utf-32-le")


def token_counts(texts: list[np.ndarray]) -> np.ndarray:
    """Tokens of each text by bucket of their hash."""
    out = np.zeros((len(texts), _BUCKETS), np.int32)
    if texts:
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate(texts)
        np.add.at(out, (row, ((flat >> np.uint64(40)) % np.uint64(_BUCKETS)).astype(np.int64)), 1)
    return out


class Shard:
    """Evaluation texts of one shard and the automaton of their pieces."""

    def __init__(self, at: str, share: float) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(at)
        t = pq.read_table(path, filesystem=fs, columns=["_name", "_packed"], partitioning=None)
        self.names = t.column("_name").to_pylist()
        self.texts = [unpack(x) for x in t.column("_packed").to_pylist()]
        self.sizes = np.array([len(x) for x in self.texts], np.int64)
        self.counts = token_counts(self.texts)
        self.need = np.array([pieces_of(int(n), share) for n in self.sizes], np.int64)
        each = np.repeat(np.arange(len(self.texts)), self.need)
        j = np.arange(len(each)) - np.repeat(np.cumsum(self.need) - self.need, self.need)
        start, stop = j * self.sizes[each] // self.need[each], (j + 1) * self.sizes[each] // self.need[each]
        number: dict[str, int] = {}
        passage = np.empty(len(each), np.int64)
        at = 0
        for values, m in zip(self.texts, self.need.tolist(), strict=True):
            text = as_text(values)
            passage[at : at + m] = [number.setdefault(text[x:y], len(number)) for x, y in zip(start[at : at + m].tolist(), stop[at : at + m].tolist(), strict=True)]
            at += m
        # the places of a passage in order, so that those on about a diagonal are found by bisection
        order = np.lexsort((start, passage))
        self.owner, self.start = each[order], start[order]
        self.key = passage[order] << 32 | self.start
        self.length = np.zeros(len(number), np.int64)
        self.length[passage] = stop - start
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, k in number.items():
            self.automaton.add_word(p, k)
        if number:
            self.automaton.make_automaton()

    def matches(self, texts: list[np.ndarray], share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, its place, evaluation text, its place) of all pieces found near the diagonal, by stretches of whole texts."""
        if not len(self.length):
            return
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= 500_000):
                size += len(texts[last]) + 1
                last += 1
            part = texts[first:last]
            sizes = np.array([len(t) for t in part], np.int64)
            begin = np.concatenate(([0], np.cumsum(sizes + 1)))
            found = np.fromiter((x for hit in self.automaton.iter("\x01".join(map(as_text, part))) for x in hit), np.int64).reshape(-1, 2)
            end, passage = found[:, 0], found[:, 1]
            text = np.searchsorted(begin, end, side="right") - 1
            place = end - self.length[passage] + 1 - begin[text]
            far = allowed(np.floor(sizes / (1 - share) + 1e-9), share)[text]
            low = np.searchsorted(self.key, passage << 32 | np.maximum(place - far, 0))
            n = np.searchsorted(self.key, passage << 32 | (place + far), side="right") - low
            # a passage that many texts hold is expanded for a bounded stretch at a time
            stretch = np.cumsum(np.bincount(text, n, len(part))) // EXPANDED
            for x in np.unique(stretch):
                of = stretch[text] == x
                m, f = n[of], low[of]
                which = np.repeat(np.flatnonzero(of), m)
                k = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(f, m)
                yield text[which] + first, place[which], self.owner[k], self.start[k]
            first = last


def _shard(at: str, share: float) -> Shard | None:
    """The shard of a folder, null if no text fell into it; a worker keeps the last one."""
    if at not in _held:
        _held.clear()
        fs, path = pyarrow.fs.FileSystem.from_uri(at)
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return None
        _held[at] = Shard(at, share)
    return _held[at]


def covered_pairs(shard: Shard, texts: list[np.ndarray], counts: np.ndarray, share: float) -> Iterator[tuple[int, int, int, int]]:
    """(evaluation text, training text, distance, tokens covered by matched pieces)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for text, place, of, start in shard.matches(texts, share):
        longer = np.maximum(sizes[text], shard.sizes[of])
        most = allowed(longer, share)
        keep = (np.abs(sizes[text] - shard.sizes[of]) <= most) & (np.abs(place - start) <= most)
        text, of, start, most = text[keep], of[keep], start[keep], most[keep]
        if not len(text):
            continue
        order = np.lexsort((start, text, of))
        text, of, start, most = text[order], of[order], start[order], most[order]
        new = np.ones(len(text), bool)
        new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])
        text, of, start, most = text[new], of[new], start[new], most[new]
        pair = np.ones(len(text), bool)
        pair[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(pair)
        pieces = np.diff(np.append(head, len(text)))
        # the matched intervals are pieces side by side: merged, they cover the sum of their lengths
        n, m = shard.sizes[of], shard.need[of]
        j = -(-start * m // n)
        covered = np.add.reduceat((j + 1) * n // m - start, head)
        text, of, most = text[head], of[head], most[head]
        keep = pieces >= shard.need[of] - most
        text, of, most, covered = text[keep], of[keep], most[keep], covered[keep]
        for x in range(0, len(text), 50_000):
            cut = slice(x, x + 50_000)
            differ = shard.counts[of[cut]] - counts[text[cut]]
            near = np.maximum(np.maximum(differ, 0).sum(1), np.maximum(-differ, 0).sum(1)) <= most[cut]
            for e, t, d, c in zip(of[cut][near].tolist(), text[cut][near].tolist(), most[cut][near].tolist(), covered[cut][near].tolist(), strict=True):
                distance = within(shard.texts[e], texts[t], d)
                if distance is not None:
                    yield e, t, distance, c


def near_copies(df: DataFrame, side: Column, source: Column, record: str = "path_id", tokens: str = "tokens", train: tuple[str, ...] = ("train",), least: int = 60, share: float = 0.1, passages: int = PASSAGES) -> tuple[DataFrame, DataFrame]:
    """(classes, members).

    classes: _name (of the evaluation text), _near (of the training text), _distance, _covered;
    members: _record, _side, _source, _name of every record of at least ``least`` tokens and known side.
    """
    base = df.select(F.col(record).alias("_record"), side.alias("_side"), source.alias("_source"), F.col(tokens).alias("_tokens"))
    base = base.filter(F.col("_record").isNotNull() & F.col("_side").isNotNull() & (F.size("_tokens") >= least))
    kind = base.schema["_record"].dataType.simpleString()

    def named(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()  # of copies on one task only the first of a side goes on
        for b in batches(rows):
            flat = token_batch(b.column(3))
            values, at = flat.hashes[flat.codes], flat.starts.tolist()
            names = [xxhash.xxh3_128_digest(values[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            first = []
            for key in zip(b.column(1).to_pylist(), names, strict=True):
                first.append(key not in seen)
                seen.add(key)
            if len(seen) > 2_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.binary()), pa.array(pack(flat), pa.binary()), pa.array(flat.lengths, pa.int32()), pa.array(first)], names=["_record", "_side", "_source", "_name", "_packed", "_n", "_first"])

    texts = written(base.mapInArrow(named, f"_record {kind}, _side string, _source string, _name binary, _packed binary, _n int, _first boolean"), "texts")
    is_train = F.col("_side").isin(*train)

    def band(n: Column) -> Column:
        return F.floor(F.log(F.greatest(n, F.lit(least)) / F.lit(float(max(1, least)))) / F.lit(math.log(BAND))).cast("int")

    evals = texts.filter(~is_train & F.col("_first")).select("_name", "_packed", "_n").dropDuplicates(["_name"])
    reach = F.sequence(band(F.ceil(F.col("_n") * (1 - share))), band(F.floor(F.col("_n") / (1 - share)) + 1))
    evals = written(evals, "eval-texts").select("_name", "_packed", "_n", F.explode(reach).alias("band"))
    pieces = F.floor(F.floor(F.col("_n") / (1 - share) + 1e-9) * share + 1e-9) + 1
    # one row per band of length: a few dozen
    shards = {r["band"]: max(1, -(-int(r["n"]) // passages)) for r in evals.groupBy("band").agg(F.sum(pieces).alias("n")).collect()}
    trains = texts.filter(is_train & F.col("_first")).select("_name", "_packed", "_n", band(F.col("_n")).alias("_band"))
    slices = {r["_band"]: 1 + int(r["n"]) // SLICE_TOKENS for r in trains.groupBy("_band").agg(F.sum("_n").alias("n")).collect() if r["_band"] in shards}

    def of_band(column: str, counts: dict[int, int]) -> Column:
        number = F.pmod(F.xxhash64("_name"), F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col(column)))
        return number.cast("int")

    if not slices:
        empty = texts.limit(0).select("_name", F.col("_name").alias("_near"), F.lit(0).cast("long").alias("_distance"), F.lit(0).cast("long").alias("_covered"))
        return empty, texts.select("_record", "_side", "_source", "_name")
    folders = write_shared(evals.select("_name", "_packed", "band", of_band("band", shards).alias("shard")).repartition(len(shards), "band", "shard"), "eval-bands", ["band", "shard"])

    # every slice of a band is a task of its own
    first_slice = dict(zip(slices, np.cumsum([0, *slices.values()]).tolist(), strict=False))

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies meet in one slice: the first of them is scanned

        def through(band: int, names: list[bytes], held: list[bytes]) -> Iterator[pa.RecordBatch]:
            texts = [unpack(x) for x in held]
            counts = token_counts(texts)
            for i in range(shards[band]):
                shard = _shard(f"{folders}/band={band}/shard={i}", share)
                out = [(shard.names[e], names[t], d, c) for e, t, d, c in covered_pairs(shard, texts, counts, share)] if shard is not None else []
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["_name", "_near", "_distance", "_covered"])

        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        size: dict[int, int] = {}
        for b in rows:
            for band, name, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name in seen:
                    continue
                seen.add(name)
                names, texts = held.setdefault(band, ([], []))
                names.append(name)
                texts.append(packed)
                size[band] = size.get(band, 0) + len(packed)
                if size[band] > 16_000_000:
                    yield from through(band, *held.pop(band))
                    size[band] = 0
        for band in sorted(held):
            yield from through(band, *held[band])

    offset = F.element_at(F.create_map(*(F.lit(x) for kv in first_slice.items() for x in kv)), F.col("_band"))
    dealt = trains.filter(F.col("_band").isin(*slices)).withColumn("_to", (offset + of_band("_band", slices)).cast("int")).repartitionById(sum(slices.values()), "_to")
    classes = dealt.select("_band", "_name", "_packed").mapInArrow(scan, "_name binary, _near binary, _distance long, _covered long")
    return written(classes, "near-copies"), texts.select("_record", "_side", "_source", "_name")


def near_copy_pairs(df: DataFrame, side: Column, source: Column, **search) -> DataFrame:  # noqa: ANN003
    """``a`` < ``b``, ``distance``: an evaluation record and a training record each, members of copied texts included."""
    train = search.get("train", ("train",))
    classes, members = near_copies(df, side, source, **search)
    m = members.select("_record", "_name", F.col("_side").isin(*train).alias("_t")).distinct()
    e = classes.join(m.filter(~F.col("_t")).select(F.col("_record").alias("_e"), "_name"), "_name")
    both = e.join(m.filter("_t").select(F.col("_record").alias("_r"), F.col("_name").alias("_near")), "_near").filter(F.col("_e") != F.col("_r"))
    return both.select(F.least("_e", "_r").alias("a"), F.greatest("_e", "_r").alias("b"), F.col("_distance").alias("distance")).distinct()


def overlap_report(df: DataFrame, side: Column, source: Column, **search) -> DataFrame:  # noqa: ANN003
    """Per evaluation split and source: records of the compared length, and those found again in training, unchanged and altered."""
    train = search.get("train", ("train",))
    classes, members = near_copies(df, side, source, **search)
    best = classes.groupBy("_name").agg(F.min("_distance").alias("_distance"))
    records = members.filter(~F.col("_side").isin(*train)).distinct().join(best, "_name", "left")
    return records.groupBy(F.col("_side").alias("split"), F.col("_source").alias("source")).agg(
        F.count("*").alias("records"), F.count_if(F.col("_distance") == 0).alias("unchanged"), F.count_if(F.col("_distance") > 0).alias("altered")
    )
