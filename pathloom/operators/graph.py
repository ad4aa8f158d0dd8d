"""Operators on many small directed graphs: edges func, src, dst.

A function's graph is small and independent of all others, so walks over it
run inside one task per group of functions; everything that is a join or an
aggregate stays one.  Successors are visited in ascending order, which makes
results the same on every run.
"""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame) -> DataFrame:
    """``func``, ``node`` of every end of an edge."""
    return edges.select("func", F.explode(F.array("src", "dst")).alias("node")).distinct()


def within(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """The edges whose target is a block of the same function.  blocks: func, node."""
    return edges.join(blocks.select("func", F.col("node").alias("dst")), ["func", "dst"], "left_semi").select("func", "src", "dst")


def entries(nodes: DataFrame, preferred: str) -> DataFrame:
    """``func``, ``entry``: the preferred node if there is one, else the first."""
    return nodes.groupBy("func").agg(F.coalesce(F.max(F.when(F.col("node") == preferred, F.col("node"))), F.min("node")).alias("entry"))


def first_successor(edges: DataFrame, wanted: list[str]) -> DataFrame:
    """``func``, ``src``, ``first``: the first successor among the wanted ones, null without any."""
    return edges.groupBy("func", "src").agg(F.min(F.when(F.col("dst").isin(wanted), F.col("dst"))).alias("first"))


def _graph(rows: pd.DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {n: [] for n in sorted({*rows["src"], *rows["dst"]})}
    for s, t in sorted(set(zip(rows["src"], rows["dst"], strict=True))):
        out[s].append(t)
    return out


def _start(graph: dict[str, list[str]], preferred: str) -> str:
    return preferred if preferred in graph else next(iter(graph))


def simple_paths(edges: DataFrame, entry: str, longest: int = 50, most: int = 500) -> DataFrame:
    """``func``, ``nth``, ``path``: paths without repeated nodes from the entry to where none goes on or to ``longest`` nodes; the first ``most``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph, out = _graph(rows), []
        stack = [[_start(graph, entry)]]
        while stack and len(out) < most:
            path = stack.pop()
            onward = [n for n in graph[path[-1]] if n not in path] if len(path) < longest else []
            if onward:
                stack.extend([*path, n] for n in reversed(onward))
            else:
                out.append(path)
        return pd.DataFrame({"func": rows["func"].iloc[0], "nth": range(1, len(out) + 1), "path": out})

    kind = edges.schema["func"].dataType.simpleString()
    return edges.groupBy("func").applyInPandas(run, f"func {kind}, nth int, path array<string>")


def layers(edges: DataFrame, root: str) -> DataFrame:
    """``func``, ``node``, ``layer``: steps from the root; unreachable ones one layer below the last; all 0 without the root."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = _graph(rows)
        if root not in graph:
            depth = dict.fromkeys(graph, 0)
        else:
            depth, queue = {root: 0}, deque([root])
            while queue:
                n = queue.popleft()
                for t in graph[n]:
                    if t not in depth:
                        depth[t] = depth[n] + 1
                        queue.append(t)
            last = max(depth.values())
            depth |= {n: last + 1 for n in graph if n not in depth}
        return pd.DataFrame({"func": rows["func"].iloc[0], "node": list(depth), "layer": list(depth.values())})

    kind = edges.schema["func"].dataType.simpleString()
    return edges.groupBy("func").applyInPandas(run, f"func {kind}, node string, layer int")


def topological(edges: DataFrame, entry: str) -> DataFrame:
    """``func``, ``node``, ``place`` (from 0), ``cyclic``: topological order; with a cycle breadth-first from the entry, then the rest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = _graph(rows)
        waits = dict.fromkeys(graph, 0)
        for targets in graph.values():
            for t in targets:
                waits[t] += 1
        ready, order = sorted(n for n, w in waits.items() if not w), []
        while ready:
            n = heapq.heappop(ready)
            order.append(n)
            for t in graph[n]:
                waits[t] -= 1
                if not waits[t]:
                    heapq.heappush(ready, t)
        cyclic = len(order) < len(graph)
        if cyclic:
            seen, queue = {}, deque([_start(graph, entry)])
            while queue:
                n = queue.popleft()
                if n not in seen:
                    seen[n] = None
                    queue.extend(graph[n])
            order = [*seen, *(n for n in graph if n not in seen)]
        return pd.DataFrame({"func": rows["func"].iloc[0], "node": order, "place": range(len(order)), "cyclic": cyclic})

    kind = edges.schema["func"].dataType.simpleString()
    return edges.groupBy("func").applyInPandas(run, f"func {kind}, node string, place int, cyclic boolean")
