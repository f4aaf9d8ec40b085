"""Mass matching by bucketed range joins, one-to-one assignment, and evidence grading."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EPS, ROOT_EPS, add_hydrogen, average_rank, best_overlap, formula_overlap
from ..storage import small, ship_package
from .components import connected_components


def ppm_pairs(query: DataFrame, reference: DataFrame, ppm: float, q: str = "q_mz", r: str = "r_mz", relative_to: str = "reference", slack: float = 0.0) -> DataFrame:
    """All pairs with |q - r| / (r or q) * 1e6 <= ppm (+ slack): masses meet in logarithmic buckets as wide as
    the tolerance, each query looking into its own and both neighbours."""
    width = math.log1p((ppm + slack) * 1e-6 * 1.01)
    bucket = lambda c: F.floor(F.ln(F.col(c)) / width).cast("long")
    a = query.where(F.col(q) > 0).withColumn("_b", F.explode(F.array(*(bucket(q) + i for i in (-1, 0, 1)))))
    b = reference.where(F.col(r) > 0).withColumn("_b", bucket(r))
    base = F.col(r) if relative_to == "reference" else F.col(q)
    return a.join(b, "_b").drop("_b").withColumn("ppm_error", F.abs(F.col(q) - F.col(r)) / base * 1e6).where(F.col("ppm_error") <= ppm + slack)


def nearest_intensity(spectra: DataFrame, targets: DataFrame, ppm: float = 10) -> DataFrame:
    """(pixel_id, feature, value) from (pixel_id, mz array, intensity array) and (feature, target): the nearest
    peak's intensity (ties: the left one, of equal masses the least intensity) where it lies within
    target * ppm / 1e6, else 0."""
    peaks = spectra.select("pixel_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("pixel_id", F.col("p.mz").alias("q_mz"), F.col("p.intensity").alias("intensity"))
    hits = ppm_pairs(peaks, targets.select("feature", F.col("target").alias("r_mz")), ppm)
    best = hits.groupBy("pixel_id", "feature").agg(F.min_by("intensity", F.struct(F.abs(F.col("q_mz") - F.col("r_mz")), F.col("q_mz"), F.col("intensity"))).alias("value"))
    grid = spectra.select("pixel_id").join(small(targets.select("feature")), how="cross")  # every pixel has every target: the output
    return grid.join(best, ["pixel_id", "feature"], "left").select("pixel_id", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


def find_candidates(msi: DataFrame, lcms: DataFrame, ppm: float = 5, use_mode: bool = True) -> DataFrame:
    """Pairs of (msi_id, msi_mz, mode) and (lc_id, lc_mz, mode) within ppm of the MSI mass and of equal ion mode
    (a missing mode never matches), with rank and number of candidates per MSI feature."""
    a = msi.select("msi_id", "msi_mz", F.col("mode").alias("msi_mode"))
    b = lcms.select("lc_id", "lc_mz", F.col("mode").alias("lc_mode"))
    pairs = ppm_pairs(a, b, ppm, "msi_mz", "lc_mz", "query", EPS)
    if use_mode:
        pairs = pairs.where(F.col("msi_mode") == F.col("lc_mode"))
    w = Window.partitionBy("msi_id")
    return pairs.withColumns({"candidate_rank": F.row_number().over(w.orderBy("ppm_error", "lc_id")), "candidate_count": F.count("*").over(w)})


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost of a rectangular matrix, rows <= columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < best[1:])
            best[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(free, best[1:], np.inf))) + 1
            delta = best[j1]
            u[match[used]] += delta
            v[used] -= delta
            best[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def _greedy(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    used, out = set(), []
    for i, g in pdf.sort_values(["msi_id", "ppm_error", "lc_id"]).groupby("msi_id", sort=True):
        for j in g.lc_id:
            if j not in used:
                used.add(j)
                out.append((i, j))
                break
    return out


def _optimal(pdf: pd.DataFrame, ppm: float) -> list[tuple[int, int]]:
    rows, cols = sorted(set(pdf.msi_id)), sorted(set(pdf.lc_id))
    at = {r: i for i, r in enumerate(rows)}, {c: j for j, c in enumerate(cols)}
    reject = (len(rows) + 1) * (ppm + 1)
    cost = np.full((len(rows), len(cols) + len(rows)), reject)  # a rejection per row is always possible
    forbidden = reject * (len(rows) + 2)
    cost[:, : len(cols)] = forbidden
    for i, j, e in zip(pdf.msi_id, pdf.lc_id, pdf.ppm_error, strict=True):
        cost[at[0][i], at[1][j]] = e
    return [(rows[i], cols[j]) for i, j in hungarian(cost) if j < len(cols) and cost[i, j] < forbidden]


def assign(candidates: DataFrame, ppm: float, method: str = "optimal") -> DataFrame:
    """One-to-one pairs: greedy in MSI order, or most pairs and then least total error.  Both decompose over the
    candidate graph's components, which go to one task each."""
    ship_package(candidates.sparkSession)
    edges = candidates.select((F.col("msi_id") * 2).alias("src"), (F.col("lc_id") * 2 + 1).alias("dst"))
    parts = connected_components(edges).select((F.col("node") / 2).cast("long").alias("msi_id"), "component", (F.col("node") % 2).alias("side")).where("side = 0").drop("side")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = _greedy(pdf) if method == "greedy" else _optimal(pdf, ppm)
        return pd.DataFrame(pairs, columns=["msi_id", "lc_id"])

    chosen = candidates.join(parts, "msi_id").groupBy("component").applyInPandas(lambda pdf: solve(pdf), "msi_id long, lc_id long")
    return candidates.join(chosen, ["msi_id", "lc_id"], "left_semi")


def cross_validate(matches: DataFrame, msi: DataFrame, lcms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with both log2 fold changes and whether their signs agree, and a one-row summary."""
    rows = matches.join(msi.select("msi_id", F.col("log2fc").alias("msi_log2fc")), "msi_id").join(lcms.select("lc_id", F.col("log2fc").alias("lc_log2fc")), "lc_id")
    rows = rows.withColumn("direction_agrees", F.signum("msi_log2fc") == F.signum("lc_log2fc"))
    return rows, rows.agg(F.count("*").alias("n_matched"), F.sum((F.col("candidate_count") > 1).cast("long")).alias("n_ambiguous"), F.avg(F.col("direction_agrees").cast("double")).alias("agreement_rate"))


def cross_validate_annotations(features: DataFrame, left: DataFrame, right: DataFrame, ppm: float = 5, neutral: bool = True) -> DataFrame:
    """Per feature (feature_id, mz): formula sets of both libraries (mz, formula, name) within ppm of the library
    mass, their overlap class as they are and with one more hydrogen on the left, and the better of both."""
    def hits(lib, tag):
        pairs = ppm_pairs(features.select("feature_id", F.col("mz").alias("q_mz")), lib.select(F.col("mz").alias("r_mz"), "formula", "name"), ppm)
        return pairs.groupBy("feature_id").agg(F.array_sort(F.collect_set("formula")).alias(f"{tag}_formulas"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias(f"{tag}_names"))

    out = features.join(hits(left, "left"), "feature_id", "left").join(hits(right, "right"), "feature_id", "left")
    raw = formula_overlap(F.col("left_formulas"), F.col("right_formulas"))
    moved = F.filter(F.transform("left_formulas", lambda f: add_hydrogen(f)), lambda f: f.isNotNull())
    corrected = formula_overlap(moved, F.col("right_formulas")) if neutral else raw
    return out.withColumns({"raw_class": raw, "corrected_class": corrected}).withColumn("best_class", best_overlap(F.col("raw_class"), F.col("corrected_class")))


def lipid_mapping(annotations: DataFrame, features: DataFrame, ppm: float = 5) -> DataFrame:
    """Nearest feature of each annotation (annotation_id, input_mass) with the signed error relative to the
    annotation's mass; annotations without one stay, unmatched."""
    a = annotations.select("annotation_id", F.col("input_mass").alias("q_mz"))
    pairs = ppm_pairs(a, features.select("feature_id", F.col("mz").alias("r_mz")), ppm, relative_to="query", slack=EPS)
    best = pairs.groupBy("annotation_id").agg(F.min_by(F.struct("feature_id", "r_mz"), F.struct("ppm_error", "feature_id")).alias("b"))
    out = annotations.join(best, "annotation_id", "left")
    return out.select(*annotations.columns, F.col("b.feature_id").alias("feature_id"), ((F.col("b.r_mz") - F.col("input_mass")) / F.col("input_mass") * 1e6).alias("ppm_error"), F.col("b").isNotNull().alias("matched"), F.when(F.col("b").isNotNull(), "putative_accurate_mass_annotation").alias("evidence"))


def ccs_evidence(observed: DataFrame, reference: DataFrame, tolerance_pct: float = 2.0, on=("candidate_id", "adduct", "charge", "ion_mode")) -> DataFrame:
    """Relative CCS error, grade, scope and how many references and candidates pass per observation."""
    x = observed.join(reference, list(on), "left")
    error = F.abs(F.col("observed_ccs") - F.col("reference_ccs")) / F.col("reference_ccs") * 100
    x = x.withColumn("error_pct", error).withColumn("within", F.col("error_pct") <= tolerance_pct + ROOT_EPS)
    grade = F.when(F.col("error_pct").isNull(), "not_available").when(~F.col("within"), "inconsistent").when(F.col("reference_source") == "predicted", "consistent_predicted").otherwise("consistent_measured")
    w = Window.partitionBy("observation_id")
    passing = F.coalesce("within", F.lit(False))
    x = x.withColumns({"ccs_grade": grade, "supports_msi_identity": passing & (F.col("observed_source") == "msi_empirical"), "passing_references": F.sum(passing.cast("long")).over(w), "passing_candidates": F.size(F.collect_set(F.when(passing, F.col("candidate_id"))).over(w))})
    return x.withColumn("ambiguous_candidate_set", F.col("passing_candidates") > 1)


def quantification_concordance(msi: DataFrame, lcm: DataFrame, mapping: DataFrame, keys=("roi_id", "section_id"), method: str = "spearman", min_pairs: int = 3, subject: str | None = None) -> DataFrame:
    """Correlation per mapped feature pair of long tables (keys, feature, value) over shared regions, centred
    within subjects where asked; Spearman on mean ranks."""
    a = msi.select(*keys, *([subject] if subject else []), F.col("feature").alias("msi_feature"), F.col("value").alias("a"))
    b = lcm.select(*keys, F.col("feature").alias("lcm_feature"), F.col("value").alias("b"))
    x = mapping.join(a, "msi_feature").join(b, [*keys, "lcm_feature"]).where("a is not null and b is not null")
    if subject:
        w = Window.partitionBy("msi_feature", "lcm_feature", subject)
        x = x.withColumns({"a": F.col("a") - F.avg("a").over(w), "b": F.col("b") - F.avg("b").over(w)})
    by = [F.col("msi_feature"), F.col("lcm_feature")]
    if method == "spearman":
        x = x.withColumns({"a": average_rank(F.col("a"), *by), "b": average_rank(F.col("b"), *by)})
    n, sa, sb = F.count("*"), F.stddev_samp("a"), F.stddev_samp("b")
    r = F.when((n >= min_pairs) & (sa > 0) & (sb > 0), F.covar_samp("a", "b") / F.nullif(sa * sb, F.lit(0.0)))
    return x.groupBy("msi_feature", "lcm_feature").agg(n.alias("n_pairs"), r.alias("correlation"))


def msms_evidence(scans: DataFrame, peaks: DataFrame, diagnostics: DataFrame, precursor: float, precursor_ppm: float = 10, tolerance: float = 0.02, unit: str = "Da", min_relative: float = 0.01, min_core: int = 2) -> tuple[DataFrame, DataFrame]:
    """Per diagnostic ion its grade over core scans (precursor within ppm and inside the isolation window), and
    the scans' hits.  Grades: repeated, single, trace, not detected; never stronger than that."""
    core = scans.where((F.abs(F.col("precursor_mz") - precursor) / precursor * 1e6 <= precursor_ppm) & (F.lit(precursor) >= F.col("isolation_target_mz") - F.col("isolation_lower_offset")) & (F.lit(precursor) <= F.col("isolation_target_mz") + F.col("isolation_upper_offset")))
    core = core.select("scan_number", "base_peak_intensity")
    width = tolerance if unit == "Da" else None
    if width is not None:
        cell = lambda c: F.floor(F.col(c) / width).cast("long")
        d = diagnostics.withColumn("_c", F.explode(F.array(*(cell("target_mz") + i for i in (-1, 0, 1)))))
        pairs = peaks.withColumn("_c", cell("fragment_mz")).join(small(d), "_c").drop("_c").where(F.abs(F.col("fragment_mz") - F.col("target_mz")) <= width)
    else:
        pairs = ppm_pairs(peaks.withColumn("q_mz", F.col("fragment_mz")), diagnostics.withColumn("r_mz", F.col("target_mz")), tolerance)
    best = pairs.join(core, "scan_number").groupBy("scan_number", "label").agg(F.max("fragment_intensity").alias("intensity"), F.first("base_peak_intensity").alias("base"))
    hits = best.withColumn("relative", F.col("intensity") / F.col("base")).withColumn("qualifies", F.col("relative") >= min_relative)
    n = hits.groupBy("label").agg(F.sum(F.col("qualifies").cast("long")).alias("n_qualifying"), F.count("*").alias("n_matched"))
    out = diagnostics.join(n, "label", "left").select("label", "target_mz", F.coalesce("n_qualifying", F.lit(0)).alias("n_qualifying"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))
    grade = F.when(F.col("n_qualifying") >= min_core, "repeated_diagnostic_support").when(F.col("n_qualifying") == 1, "single_scan_support").when(F.col("n_matched") > 0, "trace_match").otherwise("not_detected")
    return out.withColumn("grade", grade), hits


# --- pathways ---------------------------------------------------------------------------------------


def pathway_hits(objects: DataFrame, column: str = "json") -> DataFrame:
    """(source, pathway, compound_id) of nested objects {source: {pathway: [compounds]}} as JSON text."""
    nested = F.from_json(column, "map<string, map<string, array<string>>>")
    a = objects.select(F.explode(nested).alias("source", "paths"))
    return a.select("source", F.explode("paths").alias("pathway", "ids")).select("source", "pathway", F.explode("ids").alias("compound_id")).distinct()


def pathway_links(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Features of a pathway's compounds: by id, else by name, else by m/z (1e-6); unlinked ones are dropped.
    metadata: feature, compound_id, compound_name, mz."""
    by_id = metadata.where("compound_id is not null").groupBy("compound_id").agg(F.min("feature").alias("f1"))
    by_name = metadata.where("compound_name is not null").groupBy("compound_name").agg(F.min("feature").alias("f2"))
    by_mz = metadata.where("mz is not null").groupBy(F.format_string("%.6f", "mz").alias("k")).agg(F.min("feature").alias("f3"))
    x = hits.withColumn("k", F.format_string("%.6f", "mz")).join(by_id, "compound_id", "left").join(by_name, "compound_name", "left").join(by_mz, "k", "left")
    how = F.when(F.col("f1").isNotNull(), "compound_id").when(F.col("f2").isNotNull(), "compound_name").when(F.col("f3").isNotNull(), "mz")
    return x.withColumn("feature", F.coalesce("f1", "f2", "f3")).withColumn("link", how).where("feature is not null").select("pathway", "compound_id", "feature", "link").distinct()


def pathway_pixel_score(long: DataFrame, features: DataFrame, log: bool = True, scale: bool = False, aggregate: str = "mean") -> DataFrame:
    from .preprocess import log10_transform, scale_features

    rows = long.join(features.select("feature").distinct(), "feature", "left_semi")
    rows = log10_transform(rows) if log else rows
    rows = scale_features(rows) if scale else rows
    return rows.groupBy("pixel_id").agg((F.avg if aggregate == "mean" else F.sum)("value").alias("score"))


def pathway_sample_score(samples: DataFrame, weights: DataFrame, method: str = "weighted_mean") -> DataFrame:
    """Weighted mean (by the sum of absolute weights; the number of features where that is 0), weighted sum,
    mean or sum; a missing weight is 1, a value that isn't finite 0."""
    x = samples.join(weights, "feature").withColumns({"w": F.coalesce("weight", F.lit(1.0)), "v": F.coalesce("value", F.lit(0.0))})
    total = F.sum(F.abs("w"))
    score: Column = {"weighted_mean": F.sum(F.col("w") * F.col("v")) / F.when(total > 0, total).otherwise(F.count("*")), "weighted_sum": F.sum(F.col("w") * F.col("v")), "mean": F.avg("v"), "sum": F.sum("v")}[method]
    return x.groupBy("sample_id").agg(score.alias("score"))
