"""Train, validation and test splits that keep records of one origin together.

Names are linked into groups (connected components), and whole groups are dealt
to the splits.  The search starts from the hashed assignment of every group and
moves or exchanges whole groups, accepting worse states less and less
(simulated annealing); several chains run in parallel from other seeds and the
best is kept.  The cost is the squared deviation of the sizes of the splits
plus that of every stratum (by default compiler and optimisation level).

Scale.  A chain never sees more than 4,096 groups.  Groups of at least 1/2000
of all rows, of which there are at most 2,000, are searched first and together;
the others are spread by hash over blocks, and each block aims at its share of
what the large groups left open.  Only sums per split and stratum come to the
driver.

Defined cases
    record without a name: ``group_key`` null, its split is the hash of its id;
    null stratum: a stratum of its own;
    repeated record id: its rows go to the split of their name;
    empty table or no links: every name is a group alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import connected_components

_BLANK = " \t\n\r\x0b\x0c"
SPLITS = ("train", "validation", "test")
HEAVY, BLOCK = 2_000, 4_096
#: Steps of a chain for each of its groups, at least.
STEPS = 12


def written_alike(name: Column) -> Column:
    """Trimmed, lower-cased, what follows the last ``/``, without a final ``.elf``; null if nothing is left."""
    n = F.lower(F.btrim(name, F.lit(_BLANK)))
    n = F.substring_index(n, "/", -1)
    n = F.when(n.endswith(".elf"), F.substring(n, F.lit(1), F.length(n) - 4)).otherwise(n)
    return F.when(n != "", n)


def source_name(util: Column, label: Column) -> Column:
    """The name of a record: its util, or what precedes the first ``_`` of its label."""
    blank = util.isNull() | (F.btrim(util, F.lit(_BLANK)) == "")
    return F.when(~blank, written_alike(util)).when(label.contains("_"), written_alike(F.substring_index(label, "_", 1)))


def build_stratum(compiler: Column, opt: Column) -> Column:
    """Compiler and level in one spelling."""
    c = F.coalesce(F.lower(F.btrim(compiler)), F.lit("?"))
    c = F.when(c.contains("clang"), "clang").when(c.contains("gcc"), "gcc").otherwise(c)
    return F.concat_ws("/", c, F.coalesce(F.translate(F.lower(F.btrim(opt)), "-", ""), F.lit("?")))


def anneal(counts: np.ndarray, target: np.ndarray, state: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """The best state met.  counts: group x (size, strata...); target: split x the same; state: split of each group."""
    rng = np.random.default_rng(seed)
    n, k = len(counts), len(target)
    weight = 1.0 / np.maximum(counts.sum(0), 1.0) ** 2
    weight[1:] *= 0.25 / max(1, counts.shape[1] - 1)
    state = state.copy()
    off = -target.copy()
    np.add.at(off, state, counts)
    cost = float((off * off * weight).sum())
    least = cost
    if n < 2:
        best = state.copy()
        for s in range(k):
            trial = -target.copy()
            np.add.at(trial, np.full(n, s), counts)
            if (c := float((trial * trial * weight).sum())) < least:
                best, least = np.full(n, s, state.dtype), c
        return best, least
    heat, cool = max(cost, 1e-6) * 0.2, (1e-5) ** (1.0 / max(1, steps))
    since: list[tuple[int, int]] = []  # groups and their splits before, of the steps since the best state
    pick, other, odds = rng.integers(0, n, (steps, 2)), rng.integers(1, k, steps), rng.random((steps, 2))
    for t in range(steps):
        i, j = pick[t]
        a = state[i]
        if odds[t, 0] < 0.5:
            b, shift, j = (a + other[t]) % k, counts[i], -1
        else:
            b, shift = state[j], counts[i] - counts[j]
            if a == b:
                continue
        was, now = off[a], off[b]
        change = float((weight * (shift * (2.0 * (now - was) + 2.0 * shift))).sum())
        if change <= 0 or odds[t, 1] < np.exp(-change / heat):
            off[a] = was - shift
            off[b] = now + shift
            state[i] = b
            since.append((i, a))
            if j >= 0:
                state[j] = a
                since.append((j, b))
            cost += change
            if cost < least - 1e-15:
                least = cost
                since.clear()
        heat *= cool
    for i, before in reversed(since):
        state[i] = before
    return state, least


def _chain(goal: list[list[float]], shares: list[float], chains: int, steps: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """goal: split x stratum, the share of a stratum's rows in these blocks that each split is to get."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, chain = int(rows["_block"].iloc[0]), int(rows["_chain"].iloc[0])
        rows = rows.sort_values("group_key")
        counts = np.zeros((len(rows), len(goal[0])))
        counts[:, 0] = rows["_size"]
        for i, strata in enumerate(rows["_strata"]):
            for s in strata:
                counts[i, 1 + s["_stratum"]] += s["_n"]
        target = np.array(goal) * counts.sum(0)
        drawn = pd.util.hash_array(np.array([f"{seed}/{chain}/{g}" for g in rows["group_key"]], dtype=object)) / 2.0**64
        state = np.minimum(np.searchsorted(np.cumsum(shares), drawn, side="right"), len(shares) - 1)
        best, cost = anneal(counts, target, state, seed + 7919 * block + chain, max(steps, STEPS * len(rows)))
        return pd.DataFrame({"_block": [block], "_cost": [cost], "_chain": [chain], "_keys": [rows["group_key"].tolist()], "_splits": [best.tolist()]})

    return run


def deal_groups(groups: DataFrame, strata: int, shares: tuple[float, ...] = (0.8, 0.1, 0.1), chains: int = 6, steps: int = 12_000, seed: int = 1) -> DataFrame:
    """``group_key``, ``_split`` (a number) of every group.  groups: group_key, _size, _strata (list of _stratum, a number under ``strata``, and _n)."""
    total = groups.agg(F.sum("_size")).scalar()
    groups = groups.withColumn("_heavy", F.col("_size") * HEAVY >= total)
    light = groups.filter(~F.col("_heavy")).agg(F.count("*").alias("n"), F.sum("_size").alias("s")).first()
    blocks = max(1, -(-light["n"] // BLOCK))

    def search(part: DataFrame, goal: np.ndarray) -> DataFrame:
        tried = part.withColumn("_chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).groupBy("_block", "_chain")
        found = tried.applyInPandas(_chain(goal.tolist(), list(shares), chains, steps, seed), "_block long, _cost double, _chain long, _keys array<string>, _splits array<int>")
        best = found.groupBy("_block").agg(F.min_by(F.struct("_keys", "_splits"), F.struct("_cost", "_chain")).alias("_b"))
        return best.select(F.explode(F.arrays_zip("_b._keys", "_b._splits")).alias("_z")).select(F.col("_z._keys").alias("group_key"), F.col("_z._splits").alias("_split"))

    even = np.tile(np.array(shares)[:, None], (1, strata + 1))
    heavy = written(search(groups.filter("_heavy").withColumn("_block", F.lit(0)), even), "split-heavy")
    if not light["n"]:
        return heavy
    # what the large groups left open, per split and stratum: a fixed number of sums
    goal = even.copy()
    sums = groups.join(heavy, "group_key", "left").select(F.coalesce("_split", F.lit(-1)).alias("_split"), F.explode(F.array_append("_strata", F.struct(F.lit(-1).alias("_stratum"), F.col("_size").alias("_n")))).alias("_t"))
    have = np.zeros((len(shares) + 1, strata + 1))
    for r in sums.groupBy("_split", "_t._stratum").agg(F.sum("_t._n").alias("n")).collect():
        have[r["_split"], r["_stratum"] + 1] = r["n"]
    rest = have[-1]
    wanted = np.maximum(even * have.sum(0) - have[:-1], 0)
    goal = np.where(rest > 0, wanted / np.maximum(wanted.sum(0), 1e-9), even)
    spread = groups.filter(~F.col("_heavy")).withColumn("_block", F.pmod(F.xxhash64("group_key"), F.lit(blocks)) + 1)
    return heavy.union(search(spread, goal))


def numbered_strata(base: DataFrame) -> tuple[list[str | None], DataFrame]:
    """The distinct ``_spelled`` in order, null first, and a frame of ``_of`` and its number ``_stratum``."""
    known = sorted((r[0] for r in base.select("_spelled").distinct().collect()), key=lambda x: (x is not None, x or ""))
    return known, base.sparkSession.createDataFrame([(x, i) for i, x in enumerate(known)], "_of string, _stratum int")


def grouped_split(df: DataFrame, links: DataFrame, record: str, name: Column, stratum: Column, link_a: Column, link_b: Column, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 1) -> DataFrame:
    """``record``, ``group_key``, ``split`` of every row.  link_a, link_b: the names of a link, in the spelling of ``name``."""
    base = df.select(F.col(record).alias("_record"), name.alias("_name"), stratum.cast("string").alias("_spelled"))
    known, numbers = numbered_strata(base)
    # a left join with a few rows; the null stratum has a number too
    base = base.join(F.broadcast(numbers), F.col("_spelled").eqNullSafe(F.col("_of")), "left").select("_record", "_name", "_stratum")
    origin = connected_components(links.select(link_a.alias("_a"), link_b.alias("_b")), "_a", "_b")
    # names first: one row per name and stratum, so that no hot name is joined row by row
    named = base.filter(F.col("_name").isNotNull()).groupBy("_name", "_stratum").agg(F.count("*").alias("_n"))
    named = named.join(origin, F.col("_name") == F.col("node"), "left").select("_name", "_stratum", "_n", F.coalesce("component", "_name").alias("group_key"))
    named = written(named, "names")
    strata = named.groupBy("group_key", "_stratum").agg(F.sum("_n").alias("_n"))
    groups = written(strata.groupBy("group_key").agg(F.sum("_n").alias("_size"), F.collect_list(F.struct("_stratum", "_n")).alias("_strata")), "groups")
    dealt = deal_groups(groups, len(known), shares, seed=seed)
    of_name = written(named.select("_name", "group_key").distinct().join(dealt, "group_key"), "split-names")
    drawn = F.pmod(F.xxhash64(F.col("_record").cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    hashed = F.when(F.lit(True), F.lit(len(shares) - 1))
    for i in range(len(shares) - 2, -1, -1):
        hashed = F.when(drawn < sum(shares[: i + 1]), i).otherwise(hashed)
    label = F.element_at(F.array(*(F.lit(s) for s in SPLITS)), F.coalesce("_split", hashed).cast("int") + 1)
    out = base.select("_record", "_name").join(of_name, "_name", "left")
    return out.select(F.col("_record").alias(record), "group_key", label.alias("split"))
