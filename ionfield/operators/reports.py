"""Result tables made from others: splits, enrichments, comparisons, plot and export tables."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import adjust_p, safe_divide
from .labels import rank_features

#: The smallest normal double: a fixed value that p-values of exports don't go below.
LEAST_P = 2.2250738585072014e-308


def orient_intensities(values: np.ndarray, n_features: int, n_spectra: int) -> tuple[np.ndarray, str]:
    """(spectra x features array, source orientation); square arrays are taken for features x spectra."""
    if values.ndim != 2 or values.shape not in ((n_features, n_spectra), (n_spectra, n_features)):
        raise ValueError(f"an array of {values.shape} is not of {n_features} features and {n_spectra} spectra")
    if values.shape == (n_features, n_spectra):
        return values.T.astype(float), "features_x_spectra"
    return values.astype(float), "spectra_x_features"


def split_by_annotation(features: DataFrame, annotations: DataFrame, key: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Features with an annotation, and those without."""
    known = annotations.select(key).where(F.col(key).isNotNull())
    return features.join(known, key, "left_semi"), features.join(known, key, "left_anti")


def enrich(table: DataFrame, annotations: DataFrame, mapping: DataFrame, key: str = "feature") -> DataFrame:
    """All rows of ``table`` with what annotations and mapping know of the key."""
    return table.join(annotations, key, "left").join(mapping, key, "left")


def average_listed_pixels(samples: DataFrame, long: DataFrame, separator: str = ",") -> DataFrame:
    """(sample_id, feature, value, n_pixels): means over the pixels that ``pixel_ids`` lists and the table has."""
    ids = F.explode(F.split("pixel_ids", re.escape(separator))).alias("pixel_id")
    listed = samples.select("sample_id", ids).withColumn("pixel_id", F.col("pixel_id").cast("long"))
    rows = listed.join(long.select("pixel_id", "feature", "value"), "pixel_id")
    return rows.groupBy("sample_id", "feature").agg(F.avg("value").alias("value"), F.count("*").alias("n_pixels"))


def triangular_adjust(pairs: DataFrame, a: str, b: str, p: str, by: tuple[str, ...] = (), method: str = "BH") -> DataFrame:
    """Adjusted p-values of a symmetric table: adjusted over a <= b only, and given to both directions."""
    upper = adjust_p(pairs.where(F.col(a) <= F.col(b)), p, by=by, method=method).select(*by, a, b, "adj_p_value")
    ends = upper.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"), "adj_p_value")
    return pairs.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)}).join(ends, [*by, "_a", "_b"], "left").drop("_a", "_b")


def roi_target(clusters: DataFrame, column: str = "cluster", prior: dict[str, float] | None = None) -> dict[str, float]:
    """Share of each cluster that occurs: prior weights (1 where none is given) over their sum."""
    names = [r[0] for r in clusters.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column).collect()]  # clusters, a fixed few
    if not names:
        raise ValueError("no cluster is known")
    if unknown := set(prior or {}) - set(names):
        raise ValueError(f"weights of unknown clusters: {', '.join(sorted(unknown))}")
    weights = {n: float((prior or {}).get(n, 1.0)) for n in names}
    if any(w < 0 or not math.isfinite(w) for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite, non-negative and not all zero")
    total = sum(weights.values())
    return {n: w / total for n, w in weights.items()}


def functional_peak_list(differential: DataFrame) -> DataFrame:
    """(m.z, p.value, t.score) of (feature, p_value, effect_size): p not below the smallest double and 1 where
    missing, effect 0 where missing; features without a mass are left out."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    mass = F.regexp_extract("feature", r"^mz_([0-9]+(?:\.[0-9]+)?)", 1)
    out = differential.select(F.nullif(mass, F.lit("")).cast("double").alias("m.z"), F.greatest(F.coalesce(finite("p_value"), F.lit(1.0)), F.lit(LEAST_P)).alias("p.value"), F.coalesce(finite("effect_size"), F.lit(0.0)).alias("t.score"))
    return out.where("`m.z` is not null")


def compare_groups(long: DataFrame, first: str, second: str, label: str = "domain") -> DataFrame:
    """(feature, mean_a, mean_b, standardized): difference of two groups' means over their pooled deviation."""
    v = F.col("value")
    of = lambda f, name: f(F.when(F.col(label) == name, v))
    s = long.where(F.col(label).isin(first, second)).groupBy("feature").agg(of(F.avg, first).alias("mean_a"), of(F.avg, second).alias("mean_b"), of(F.stddev_samp, first).alias("_a"), of(F.stddev_samp, second).alias("_b"))
    pooled = F.sqrt((F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")) / 2)
    return s.select("feature", "mean_a", "mean_b", F.coalesce(safe_divide(F.col("mean_a") - F.col("mean_b"), pooled), F.lit(0.0)).alias("standardized"))


def between_group_variance(long: DataFrame, label: str = "domain", n: int = 25) -> DataFrame:
    """The n features whose group means vary most (ties by name)."""
    means = long.groupBy("feature", label).agg(F.avg("value").alias("m"))
    return means.groupBy("feature").agg(F.var_samp("m").alias("variance")).orderBy(F.desc("variance"), "feature").limit(n)


def score_plot(scores: DataFrame, samples: DataFrame | None = None, x: str | None = None, y: str | None = None) -> DataFrame:
    """(Sample, x, y, Group) of the first two score columns (PC or Comp), or of those named; groups come from the
    scores, else from the samples' clusters, else are one."""
    named = [c for c in scores.columns if re.fullmatch(r"(PC|Comp)[0-9]+", c)]
    if len(named) < 2:
        raise ValueError("scores need two columns such as PC1 and PC2")
    if "Group" not in scores.columns:
        if samples is not None and {"sample_id", "cluster"} <= set(samples.columns):
            group = samples.select(F.col("sample_id").alias("Sample"), F.concat(F.lit("Region_"), F.col("cluster").cast("string")).alias("Group"))
            scores = scores.join(group, "Sample", "left")
        else:
            scores = scores.withColumn("Group", F.lit("Sample"))
    return scores.select("Sample", F.col(x or named[0]).alias("x"), F.col(y or named[1]).alias("y"), "Group")


def feature_view(result: DataFrame, long: DataFrame, rank: int = 1, metric: str | None = None, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The n best features, and the ion image (x, y, value) of the one at ``rank``."""
    ranked = rank_features(result, metric, n)
    names = [r["Feature"] for r in ranked.select("Feature").collect()]  # at most n
    if not 1 <= rank <= len(names):
        raise ValueError(f"there is no feature at rank {rank}")
    return ranked, long.where(F.col("feature") == names[rank - 1]).select("feature", "x", "y", "value")
