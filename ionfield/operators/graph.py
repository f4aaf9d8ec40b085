"""Spatial graphs: lattice, radius and k-nearest edges by bucketed equi-joins; diagnostics; averages.

An undirected edge is one row (section keys, src < dst, distance, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ROOT_EPS
from .components import connected_components

#: Half of each neighbourhood, so that every pair is met once: fixed values.
OFFSETS = {"rook": ((1, 0), (0, 1)), "queen": ((1, 0), (0, 1), (1, 1), (1, -1))}


def _offsets(pairs):
    return F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in pairs))).alias("o")


def lattice_edges(nodes: DataFrame, method: str = "rook", keys=("section_id",), node: str = "pixel_id", step: tuple[float, float] = (1, 1), threshold: float | None = None) -> DataFrame:
    """Edges between lattice neighbours of a section; coordinates are divided by the lattice step first."""
    at = nodes.select(*keys, F.col(node).alias("id"), F.round(F.col("x") / step[0]).cast("long").alias("x"), F.round(F.col("y") / step[1]).cast("long").alias("y"))
    kept = [o for o in OFFSETS[method] if threshold is None or (o[0] ** 2 + o[1] ** 2) ** 0.5 <= threshold + ROOT_EPS]
    a = at.select(*keys, F.col("id").alias("a"), "x", "y", _offsets(kept)).select(*keys, "a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.sqrt((F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy")).cast("double")).alias("distance"))
    b = at.select(*keys, F.col("id").alias("b"), "x", "y")
    return a.join(b, [*keys, "x", "y"]).select(*keys, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "distance", F.lit(1.0).alias("weight"))


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, keys=("section_id",), slack: float = ROOT_EPS) -> DataFrame:
    """(keys, src, dst, d2) for rows of a (id, x, y) and b (id, x, y) within ``radius``: cells of that size,
    nine cells probed, residual distance test.  No pair of distant points is ever formed."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    nine = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    left = a.select(*keys, F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("_cx"), cell("y").alias("_cy"), _offsets(nine)).withColumns({"cx": F.col("_cx") + F.col("o.dx"), "cy": F.col("_cy") + F.col("o.dy")})
    right = b.select(*keys, F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left.join(right, [*keys, "cx", "cy"]).withColumn("d2", d2.cast("double")).where(F.col("d2") <= radius * radius + slack).select(*keys, "src", "dst", "d2")


def distance_edges(nodes: DataFrame, threshold: float, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """Edges between all pairs of a section within ``threshold``."""
    at = nodes.select(*keys, F.col(node).alias("id"), "x", "y")
    pairs = radius_pairs(at, at, threshold + ROOT_EPS, keys, 0.0).where("src < dst")
    return pairs.select(*keys, "src", "dst", F.sqrt("d2").alias("distance"), F.lit(1.0).alias("weight"))


def knn_pairs(a: DataFrame, b: DataFrame, k: int, start: float, keys=("section_id",), growth: float = 2.0) -> DataFrame:
    """(keys, src, dst, d2, rank): the k rows of b nearest to each row of a, ties by dst.

    The search radius grows for the rows that haven't met k others yet, so dense parts never pay for sparse
    ones; rows of sections with fewer than k others end when the radius covers the section."""
    from ..storage import materialize

    spans = b.groupBy(*keys).agg((F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * 1.5 + start).alias("span"), F.count("*").alias("size"))
    todo, done, radius = a.select(*keys, "id", "x", "y"), None, start
    rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("d2", "dst"))
    while True:  # ends when the radius covers the widest section
        pairs = materialize(radius_pairs(todo, b, radius, keys).withColumn("rank", rank).where(F.col("rank") <= k), "pairs")
        got = pairs.groupBy(*keys, F.col("src").alias("id")).agg(F.count("*").alias("n"))
        state = todo.join(got, [*keys, "id"], "left").join(spans, list(keys), "left")
        open_ = state.where((F.coalesce("n", F.lit(0)) < k) & (F.lit(radius) < F.col("span"))).select(*keys, "id", "x", "y")
        rest = materialize(open_, "open")
        closed = pairs.join(rest.select(*keys, F.col("id").alias("src")), [*keys, "src"], "left_anti")
        done = closed if done is None else done.unionByName(closed)
        todo, radius = rest, radius * growth
        if todo.isEmpty():
            break
    return done


def both_ways(edges: DataFrame, keys=("section_id",)) -> DataFrame:
    return edges.select(*keys, "src", "dst", "distance", "weight").unionAll(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "distance", "weight"))


def degrees(nodes: DataFrame, edges: DataFrame, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """(keys, node, degree) of every node, isolates included."""
    n = both_ways(edges, keys).groupBy(F.col("src").alias(node)).agg(F.count("*").alias("degree"))
    return nodes.select(*keys, node).join(n, node, "left").select(*keys, node, F.coalesce("degree", F.lit(0)).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """(keys, node, component): the component's smallest node; isolates are their own."""
    found = connected_components(edges).withColumnRenamed("node", node)
    return nodes.select(*keys, node).join(found, node, "left").select(*keys, node, F.coalesce("component", F.col(node)).alias("component"))


def summary(nodes: DataFrame, edges: DataFrame, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """A row per section: nodes, edges, isolates, mean degree."""
    d = degrees(nodes, edges, keys, node)
    return d.groupBy(*keys).agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.sum((F.col("degree") == 0).cast("long")).alias("n_isolated"), F.avg("degree").alias("mean_degree"))


def diagnostics(nodes: DataFrame, edges: DataFrame, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """Key/value rows: summary, degree distribution, component sizes."""
    total = summary(nodes, edges, keys, node).agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"), F.sum("n_isolated").alias("n_isolated"))
    first = total.select(F.lit("summary").alias("record"), F.explode(F.create_map(*(x for c in total.columns for x in (F.lit(c), F.col(c))))).alias("key", "value"))
    second = degrees(nodes, edges, keys, node).groupBy(F.col("degree").cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit("degree_distribution").alias("record"), "key", "value")
    sizes = components(nodes, edges, keys, node).groupBy("component").agg(F.count("*").alias("size")).groupBy(F.col("size").cast("string").alias("key")).agg(F.count("*").alias("value"))
    return first.unionByName(second).unionByName(sizes.select(F.lit("component_size").alias("record"), "key", "value"))


def neighborhood_average(long: DataFrame, edges: DataFrame, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """(node, feature, value, neighbor_mean): weighted neighbour means; isolates keep their own value."""
    around = both_ways(edges, keys).select(F.col("src").alias(node), F.col("dst").alias("_n"), "weight")
    values = long.select(F.col(node).alias("_n"), "feature", F.col("value").alias("_v"))
    mean = around.join(values, "_n").groupBy(node, "feature").agg((F.sum(F.col("weight") * F.col("_v")) / F.sum("weight")).alias("neighbor_mean"))
    return long.select(node, "feature", "value").join(mean, [node, "feature"], "left").withColumn("neighbor_mean", F.coalesce("neighbor_mean", "value"))


def largest_components(nodes: DataFrame, edges: DataFrame, method: str = "largest_component", fraction: float = 0.05, keys=("section_id",), node: str = "pixel_id") -> DataFrame:
    """Nodes of the section's largest component (ties: the smallest id), or of components of at least
    ``fraction`` of its size."""
    c = components(nodes, edges, keys, node)
    sizes = c.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    w = Window.partitionBy(*keys)
    if method == "largest_component":
        top = sizes.withColumn("_r", F.row_number().over(w.orderBy(F.desc("size"), "component"))).where("_r = 1")
    else:
        top = sizes.withColumn("_m", F.max("size").over(w)).where(F.col("size") >= fraction * F.col("_m"))
    return c.join(top.select(*keys, "component", "size"), [*keys, "component"]).select(*keys, node, "component", "size")
