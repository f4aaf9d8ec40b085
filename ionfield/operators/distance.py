"""Signed distances to a target domain, rings, and replicate-aware profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import quantile
from .graph import both_ways, components, degrees, knn_pairs, lattice_edges


def reference_distance(pixels: DataFrame, target: str, x_resolution: float, y_resolution: float, reference: str = "boundary", boundary: str = "interface", neighbor_method: str = "rook", component_action: str = "nearest", label: str = "domain", keys=("section_id",)) -> DataFrame:
    """(keys, pixel_id, inside, distance, reference_id, status): physical distance to the nearest boundary
    pixel of the target (negative inside), or to the nearest target component's centroid (unsigned).

    A boundary pixel has a neighbour outside the target (interface), fewer than 4 or 8 neighbours
    (perimeter), or either (both).  Sections without target or boundary get a status and NULL distances."""
    inside = pixels.withColumn("inside", F.coalesce(F.col(label) == target, F.lit(False)))
    edges = lattice_edges(pixels, neighbor_method, keys)
    flags = inside.select(F.col("pixel_id").alias("dst"), F.col("inside").alias("near"))
    touching = both_ways(edges, keys).join(flags, "dst").where("not near").select(F.col("src").alias("pixel_id")).distinct().withColumn("interface", F.lit(True))
    full = 4 if neighbor_method == "rook" else 8
    state = inside.join(degrees(pixels, edges, keys).select("pixel_id", "degree"), "pixel_id").join(touching, "pixel_id", "left")
    rule = {"interface": F.coalesce("interface", F.lit(False)), "perimeter": F.col("degree") < full}
    rule["both"] = rule["interface"] | rule["perimeter"]
    scaled = inside.select(*keys, F.col("pixel_id").alias("id"), (F.col("x") * x_resolution).alias("x"), (F.col("y") * y_resolution).alias("y"))
    marked = state.where("inside")
    if reference == "boundary":
        points = marked.where(rule[boundary]).select(F.col("pixel_id").alias("id")).join(scaled, "id")
    else:
        targets = inside.where("inside")
        parts = components(targets, lattice_edges(targets, neighbor_method, keys), keys)
        if component_action == "largest":
            size = F.count("*").over(Window.partitionBy(*keys, "component"))
            w = Window.partitionBy(*keys).orderBy(F.desc("s"), "component")
            parts = parts.withColumn("s", size).withColumn("r", F.dense_rank().over(w)).where("r = 1")
        points = parts.select("pixel_id", F.col("component").alias("c")).join(scaled.withColumnRenamed("id", "pixel_id"), "pixel_id").groupBy(*keys, F.col("c").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = knn_pairs(scaled, points, 1, 4 * max(x_resolution, y_resolution), keys)
    out = inside.select(*keys, "pixel_id", "inside").join(near.select(F.col("src").alias("pixel_id"), F.sqrt("d2").alias("d"), F.col("dst").alias("reference_id")), "pixel_id", "left")
    has = inside.groupBy(*keys).agg(F.max("inside").alias("any_target"))
    sign = F.when(F.col("inside"), -F.col("d")).otherwise(F.col("d")) if reference == "boundary" else F.col("d")
    status = F.when(~F.col("any_target"), "target_absent").when(F.col("d").isNull(), "boundary_absent").otherwise("computed")
    return out.join(has, list(keys)).select(*keys, "pixel_id", "inside", sign.alias("distance"), "reference_id", status.alias("status"))


def bin_rings(distances: DataFrame, method: str = "quantile", n_rings: int = 5, ring_width: float | None = None, breaks: list[float] | None = None, separate_sides: bool = True) -> DataFrame:
    """Adds ``ring``: boundary at 0, else inner/outer (or ring) with the number of the right-closed bin of the
    absolute distance; bins are quantiles, multiples of a width, or given breaks, per side."""
    side = F.when(F.col("distance") == 0, "boundary").when(F.lit(not separate_sides), "ring").when(F.col("distance") < 0, "inner").otherwise("outer")
    rows = distances.withColumn("side", F.when(F.col("distance").isNotNull(), side)).withColumn("a", F.abs("distance") if separate_sides else F.col("distance"))
    if method == "fixed_width":
        number = F.greatest(F.lit(1), F.ceil(F.col("a") / ring_width))
    else:
        if method == "quantile":
            points = F.array(*(quantile(F.col("a"), i / n_rings) for i in range(n_rings + 1)))
            cuts = rows.where("side <> 'boundary'").groupBy("side").agg(F.array_distinct(points).alias("cuts"))
        else:
            cuts = rows.select("side").where("side <> 'boundary'").distinct().withColumn("cuts", F.array(*(F.lit(float(b)) for b in breaks)))
        rows = rows.join(F.broadcast(cuts), "side", "left")  # a row per side
        number = F.greatest(F.lit(1), F.size(F.filter("cuts", lambda c: c < F.col("a"))))
        number = F.when(F.col("a") <= F.element_at("cuts", -1), F.when(F.col("a") >= F.element_at("cuts", 1), number))
    ring = F.when(F.col("side") == "boundary", "boundary").when(number.isNotNull(), F.concat(F.col("side"), F.lit("_"), F.lpad(number.cast("long").cast("string"), 2, "0")))
    return rows.withColumn("ring", ring).drop("a", "cuts")


def distance_profiles(long: DataFrame, rings: DataFrame, subject: str = "subject_id", section: str = "section_id", min_pixels: int = 10, min_subjects: int = 2, summary: str = "mean") -> DataFrame:
    """(subject, section, ring, feature, value, n_pixels, mean_distance, included): a ring is included where the
    subject has enough pixels in it (over all sections) and enough subjects do."""
    at = rings.where("ring is not null").select("pixel_id", "ring", "distance")
    agg = F.avg if summary == "mean" else F.median
    rows = long.join(at, "pixel_id")
    values = rows.groupBy(subject, section, "ring", "feature").agg(agg("value").alias("value"), F.count("*").alias("n_pixels"), F.avg("distance").alias("mean_distance"))
    per = rows.select(subject, "ring", "pixel_id").distinct().groupBy(subject, "ring").agg(F.count("*").alias("n")).where(F.col("n") >= min_pixels)
    passing = per.withColumn("s", F.count("*").over(Window.partitionBy("ring"))).where(F.col("s") >= min_subjects).select(subject, "ring", F.lit(True).alias("included"))
    return values.join(passing, [subject, "ring"], "left").withColumn("included", F.coalesce("included", F.lit(False)))
