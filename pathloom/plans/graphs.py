"""Queries on graphs: one small graph of event types per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.views import event_graph, records
from .registry import query
from .views_sql import CORPUS, GRAPH

ROOT = "signup"

_ROOTS = f"{GRAPH}, roots AS (SELECT func, coalesce(max(node) FILTER (WHERE node = '{ROOT}'), min(node)) AS entry FROM nodes GROUP BY func)"
_LAYERS = f"""WITH RECURSIVE {GRAPH}, w AS (
  SELECT func, node, 0 AS depth FROM nodes WHERE node = '{ROOT}' UNION SELECT w.func, e.dst, w.depth + 1 FROM w JOIN edges e ON e.func = w.func AND e.src = w.node WHERE w.depth < 6),
r AS (SELECT func, node, min(depth) AS layer FROM w GROUP BY func, node), m AS (SELECT func, max(layer) AS last FROM r GROUP BY func),
lay AS (SELECT n.func, n.node, CAST(CASE WHEN m.last IS NULL THEN 0 ELSE coalesce(r.layer, m.last + 1) END AS INTEGER) AS layer FROM nodes n LEFT JOIN r ON n.func = r.func AND n.node = r.node LEFT JOIN m ON n.func = m.func)"""


@query(f"WITH {GRAPH} SELECT func, src, dst FROM edges")
def func_graph(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d)


@query(f"WITH {GRAPH} SELECT func, src, dst FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.func = e.func AND n.node = e.dst AND n.node <> 'error')")
def edge_semi(spark: SparkSession, d: str) -> DataFrame:
    e = event_graph(spark, d)
    return G.within(e, G.nodes_of(e).filter("node <> 'error'"))


@query(f"WITH {_ROOTS} SELECT func, entry FROM roots")
def entry_node(spark: SparkSession, d: str) -> DataFrame:
    return G.entries(G.nodes_of(event_graph(spark, d)), ROOT)


@query(f"WITH {GRAPH} SELECT func, src, min(dst) FILTER (WHERE dst IN ('purchase', 'view')) AS first FROM edges GROUP BY func, src")
def first_api(spark: SparkSession, d: str) -> DataFrame:
    return G.first_successor(event_graph(spark, d), ["purchase", "view"])


@query(f"""WITH RECURSIVE {_ROOTS}, p AS (
  SELECT func, entry AS last, [entry] AS path FROM roots
  UNION ALL SELECT p.func, e.dst, list_append(p.path, e.dst) FROM p JOIN edges e ON e.func = p.func AND e.src = p.last WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 50),
leaf AS (SELECT p.func, array_to_string(p.path, '>') AS path, row_number() OVER (PARTITION BY p.func ORDER BY p.path) AS nth FROM p
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.func = p.func AND e.src = p.last AND NOT list_contains(p.path, e.dst)))
SELECT func, CAST(nth AS INTEGER) AS nth, path FROM leaf WHERE nth <= 500""")
def enum_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_paths(event_graph(spark, d), ROOT).select("func", "nth", F.array_join("path", ">").alias("path"))


@query(f"{_LAYERS} SELECT func, node, layer FROM lay")
def bfs_layers(spark: SparkSession, d: str) -> DataFrame:
    return G.layers(event_graph(spark, d), ROOT)


@query(f"""{_LAYERS}, x AS (SELECT func, node, layer, row_number() OVER (PARTITION BY func, layer ORDER BY node) - 1 - (count(*) OVER (PARTITION BY func, layer) - 1) / 2.0::DOUBLE AS x, -layer::DOUBLE AS y FROM lay),
b AS (SELECT func, min(x) AS x0, greatest(max(x) - min(x), 1e-6) AS xr, min(y) AS y0, greatest(max(y) - min(y), 1e-6) AS yr FROM x GROUP BY func)
SELECT x.func, x.node, round(0.1 + (x - x0) / xr * 0.8, 6) AS x, round(0.1 + (y - y0) / yr * 0.8, 6) AS y FROM x JOIN b ON x.func = b.func""")
def layer_layout(spark: SparkSession, d: str) -> DataFrame:
    """Places in the unit square: layers below each other, nodes of a layer side by side."""
    w = Window.partitionBy("func", "layer")
    l = G.layers(event_graph(spark, d), ROOT)
    l = l.select("func", "node", (F.row_number().over(w.orderBy("node")) - 1 - (F.count("*").over(w) - 1) / 2).alias("x"), (-F.col("layer")).cast("double").alias("y"))
    f = Window.partitionBy("func")

    def scaled(c: str):  # noqa: ANN202
        low, high = F.min(c).over(f), F.max(c).over(f)
        return F.round(0.1 + (F.col(c) - low) / F.greatest(high - low, F.lit(1e-6)) * 0.8, 6).alias(c)

    return l.select("func", "node", scaled("x"), scaled("y"))


@query()
def topo_order(spark: SparkSession, d: str) -> DataFrame:
    return G.topological(event_graph(spark, d), ROOT)


@query(f"WITH {CORPUS} SELECT path_id, CASE WHEN starts_with(tokens[-1], 'JK_') THEN tokens[-1] ELSE 'JK_BORING' END AS kind FROM corpus")
def edge_kind(spark: SparkSession, d: str) -> DataFrame:
    """The jump that ends a path, by its last token."""
    last = records(spark, d, "try_element_at(tokens, -1) AS last")
    return last.select("path_id", F.when(F.col("last").startswith("JK_"), F.col("last")).otherwise("JK_BORING").alias("kind"))


@query(f"{_LAYERS}, c AS (SELECT func, layer, count(*) AS n FROM lay GROUP BY func, layer) SELECT func, count(*) AS layers, max(n) AS densest FROM c GROUP BY func")
def layer_density(spark: SparkSession, d: str) -> DataFrame:
    c = G.layers(event_graph(spark, d), ROOT).groupBy("func", "layer").agg(F.count("*").alias("n"))
    return c.groupBy("func").agg(F.count("*").alias("layers"), F.max("n").alias("densest"))


@query(f"{_LAYERS} SELECT e.func, e.src, e.dst FROM edges e JOIN lay a ON e.func = a.func AND e.src = a.node JOIN lay b ON e.func = b.func AND e.dst = b.node WHERE b.layer <= a.layer")
def back_edges(spark: SparkSession, d: str) -> DataFrame:
    e = event_graph(spark, d)
    l = G.layers(e, ROOT)
    a, b = l.select("func", F.col("node").alias("src"), F.col("layer").alias("from")), l.select("func", F.col("node").alias("dst"), F.col("layer").alias("to"))
    return e.join(a, ["func", "src"]).join(b, ["func", "dst"]).filter("to <= from").select("func", "src", "dst")


@query(f"WITH {GRAPH} SELECT func, node, CAST((row_number() OVER (PARTITION BY func ORDER BY node) - 1) % 8 AS INTEGER) AS color FROM nodes")
def block_color(spark: SparkSession, d: str) -> DataFrame:
    """A palette index per block, in turn."""
    rn = F.row_number().over(Window.partitionBy("func").orderBy("node"))
    return G.nodes_of(event_graph(spark, d)).select("func", "node", ((rn - 1) % 8).alias("color"))
