"""Composite analyses: the code-first pipeline, feature screening, distance gradients, stage targets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import differential, distance, pixels, preprocess, regions, registration


@dataclass
class Bundle:
    """Result tables with the settings and the reading they support."""

    tables: dict[str, DataFrame]
    settings: dict = field(default_factory=dict)
    interpretation: str = ""


def run_pipeline(spark: SparkSession, path: str, min_nonzero: int = 1, tic: bool = True, log: bool = True, scale: bool = False) -> Bundle:
    """CSV -> at least five features -> finite coordinates -> pixels with enough positive values -> total
    normalisation -> log10 -> z-scores.  Values that aren't finite count as zero throughout."""
    from ..sources.tables import import_pixel_csv

    wide = import_pixel_csv(spark, path)
    if len(pixels.feature_columns(wide)) < 5:
        raise ValueError("fewer than five features")
    if not wide.where("x is null or y is null or isnan(x) or isnan(y)").isEmpty():
        raise ValueError("a pixel has no finite coordinates")
    long = pixels.to_long(wide).select("section_id", "pixel_id", "x", "y", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    kept = preprocess.nonzero_filter(long, min_nonzero)
    qc = long.agg(F.count_distinct("pixel_id").alias("n_pixels"), F.count_distinct("feature").alias("n_features")).crossJoin(kept.agg(F.count_distinct("pixel_id").alias("n_kept")))  # one row each
    out = preprocess.tic_normalize(kept, "total") if tic else kept
    out = preprocess.log10_transform(out) if log else out
    out = preprocess.scale_features(out) if scale else out
    mapping = spark.createDataFrame(pixels.infer_feature_mapping(wide), "feature_id long, mz double, column_name string")
    coordinates = kept.select("pixel_id", F.col("section_id"), "x", "y").distinct()
    return Bundle({"matrix": out, "coordinates": coordinates, "features": mapping, "qc": qc}, {"min_nonzero": min_nonzero, "tic": tic, "log": log, "scale": scale})


def preprocess_select_features(long: DataFrame, background: str = "none", section: str | None = None, **selection) -> Bundle:
    """Background and normalisation (per section where asked), then the feature rule, then the pruned table."""
    by = (section,) if section else ()
    ready = preprocess.preprocess(long, background, by=by)
    chosen = pixels.select_shared_features(ready, section, **selection) if section else pixels.select_features(ready, **selection)
    return Bundle({"matrix": ready.join(F.broadcast(chosen.select("feature")), "feature", "left_semi"), "features": chosen}, {"background": background, **selection})  # a row per feature


def analyze_distance_gradient(long: DataFrame, table: DataFrame, target: str, x_resolution: float, y_resolution: float, subject: str, domain_features: list[str] | None = None, test_features: list[str] | None = None, allow_circular: bool = False, ring_width: float = 60.0, min_pixels: int = 3, label: str = "domain") -> Bundle:
    """Distances, rings, replicate profiles, smooths and ring contrasts.  Features that defined the domain may
    not be tested against it unless that is asked for."""
    tested = set(test_features or [r[0] for r in long.select("feature").distinct().collect()])
    circular = tested & set(domain_features or [])
    if circular and not allow_circular:
        raise ValueError(f"features define the domain and are tested: {sorted(circular)}")
    distances = distance.reference_distance(table, target, x_resolution, y_resolution, label=label)
    rings = distance.bin_rings(distances, "fixed_width", ring_width=ring_width)
    rows = long.where(F.col("feature").isin(sorted(tested)))
    profiles = distance.distance_profiles(rows, rings, subject, min_pixels=min_pixels)
    smooths = differential.distance_gam(profiles.where("included").select("feature", subject, F.col("mean_distance").alias("distance"), "value"), subject)
    contrasts = differential.differential_t(profiles.where("included"), "ring", subject)
    reading = "circular: domain features are tested" if circular else "independent features"
    return Bundle({"distances": distances, "rings": rings, "profiles": profiles, "smooths": smooths, "contrasts": contrasts}, {"target": target, "x_resolution": x_resolution, "y_resolution": y_resolution}, reading)


def export_stage_targets(table: DataFrame, fit: DataFrame, keys=("section_id", "roi_id")) -> DataFrame:
    """Outlines of regions in stage coordinates, with the registration's errors beside each vertex."""
    outline = regions.region_polygons(table, keys)
    moved = registration.apply_affine(outline, fit, ("section_id",), ("x", "y"), ("stage_x", "stage_y"))
    return moved.join(fit.select("section_id", "rmse", "max_error"), "section_id")


def project_mask(table: DataFrame, inverse: list[list[float]], width: int, height: int) -> DataFrame:
    """(x, y, measured) of an image grid whose pixels fall on measured positions under the inverse transform."""
    grid = table.sparkSession.range(height).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    a, b, w = (r[0] * F.col("x") + r[1] * F.col("y") + r[2] for r in inverse)
    low = table.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    at = grid.crossJoin(F.broadcast(low)).select("x", "y", (F.round(a / w) + F.col("_x0")).cast("long").alias("px"), (F.round(b / w) + F.col("_y0")).cast("long").alias("py"))  # one row
    known = table.select(F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py")).distinct().withColumn("measured", F.lit(True))
    return at.join(known, ["px", "py"], "left").select("x", "y", F.coalesce("measured", F.lit(False)).alias("measured"))
