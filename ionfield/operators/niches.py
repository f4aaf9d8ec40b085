"""Neighbourhood composition, niches, label enrichment and proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ROOT_EPS, adjust_p, safe_divide
from .graph import knn_pairs, radius_pairs


def composition(pixels: DataFrame, method: str = "radius", radius: float = 1.0, k: int = 10, include_self: bool = True, min_neighbors: int = 1, label: str = "domain", keys=("section_id",), start: float = 2.0) -> DataFrame:
    """(keys, pixel_id, label type, n, n_neighbors, proportion, eligible): long composition rows of the types
    that occur; ``eligible`` is false (and the proportion NULL) below ``min_neighbors``."""
    at = pixels.select(*keys, F.col("pixel_id").alias("id"), "x", "y")
    if method == "radius":
        pairs = radius_pairs(at, at, radius, keys, ROOT_EPS)
        pairs = pairs if include_self else pairs.where("src <> dst")
    else:
        # The focal pixel is the first of its k when it counts itself, whatever lies on the same place.
        others = knn_pairs(at, at, k + 1, start, keys).where("src <> dst").drop("rank")
        rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("d2", "dst"))
        pairs = others.withColumn("_r", rank).where(F.col("_r") <= (k - 1 if include_self else k)).select(*keys, "src", "dst")
        if include_self:
            pairs = pairs.unionByName(at.select(*keys, F.col("id").alias("src"), F.col("id").alias("dst")))
    types = pixels.select(F.col("pixel_id").alias("dst"), F.col(label).alias("type"))
    counts = pairs.join(types, "dst").groupBy(*keys, F.col("src").alias("pixel_id"), "type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "pixel_id"))
    out = counts.withColumn("n_neighbors", total).withColumn("eligible", F.col("n_neighbors") >= min_neighbors)
    return out.withColumn("proportion", F.when(F.col("eligible"), F.col("n") / F.col("n_neighbors")))


def soft_composition(pixels: DataFrame, proportions: DataFrame, k: int = 10, keys=("section_id",), start: float = 2.0) -> DataFrame:
    """Mean proportions (pixel_id, type, proportion) of each pixel's k nearest, itself included."""
    at = pixels.select(*keys, F.col("pixel_id").alias("id"), "x", "y")
    near = knn_pairs(at, at, k, start, keys).select("src", "dst")
    rows = near.join(proportions.select(F.col("pixel_id").alias("dst"), "type", "proportion"), "dst")
    return rows.groupBy(F.col("src").alias("pixel_id"), "type").agg(F.avg("proportion").alias("proportion"))


def transform_composition(rows: DataFrame, method: str = "hellinger", pseudocount: float = 1e-6, types: list[str] | None = None) -> DataFrame:
    """Square roots, or centred log ratios over all types."""
    if method == "none":
        return rows
    if method == "hellinger":
        return rows.withColumn("proportion", F.sqrt("proportion"))
    logged = F.ln(F.col("proportion") + pseudocount)
    return rows.withColumn("proportion", logged - F.avg(logged).over(Window.partitionBy("pixel_id")))


def niche_distances(profiles: DataFrame, centers: DataFrame) -> DataFrame:
    """For (pixel_id, profile array) and a few (niche, center array): nearest niche, its distance, the second
    nearest's, and their ratio (0/0 is 1, x/0 infinite)."""
    d = F.sqrt(F.aggregate(F.zip_with("profile", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    pairs = profiles.crossJoin(F.broadcast(centers)).withColumn("d", d)  # k centres, a fixed few
    best = F.array_sort(F.collect_list(F.struct("d", "niche")))
    rows = pairs.groupBy("pixel_id").agg(best.alias("b")).select("pixel_id", F.col("b")[0]["niche"].alias("niche"), F.col("b")[0]["d"].alias("nearest"), F.col("b")[1]["d"].alias("second"))
    ratio = F.when(F.col("second") > 0, F.col("nearest") / F.nullif("second", F.lit(0.0))).when(F.col("nearest") == 0, 1.0).otherwise(float("inf"))
    return rows.withColumn("ambiguity_ratio", ratio)


def profile_matrix(rows: DataFrame, types: list[str]) -> DataFrame:
    """(pixel_id, profile): proportions in the order of ``types``, zeros for absent ones."""
    m = F.map_from_entries(F.collect_list(F.struct("type", "proportion")))
    return rows.groupBy("pixel_id").agg(m.alias("m")).select("pixel_id", F.transform(F.array(*(F.lit(t) for t in types)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("profile"))


def _shuffled_labels(pixels: DataFrame, label: str, strata, n_perm: int, seed: int) -> DataFrame:
    """(perm, pixel_id, type): labels permuted within strata by md5 order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("pixel_id").cast("string")))
    ranked = pixels.select(*strata, "pixel_id", F.col(label).alias("type")).withColumn("slot", F.row_number().over(Window.partitionBy(*strata).orderBy("pixel_id")))
    slots = pixels.select(*strata, "pixel_id", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm")).withColumn("slot", F.row_number().over(Window.partitionBy("perm", *strata).orderBy(key, "pixel_id")))
    return slots.join(ranked.select(*strata, "slot", "type"), [*strata, "slot"]).select("perm", "pixel_id", "type")


def _pair_counts(edges: DataFrame, labels: DataFrame, by, directed: bool) -> DataFrame:
    a = labels.select(*by, F.col("pixel_id").alias("src"), F.col("type").alias("ta"))
    b = labels.select(*by, F.col("pixel_id").alias("dst"), F.col("type").alias("tb"))
    pairs = edges.select("src", "dst").join(a, "src").join(b, [*by, "dst"])
    if directed:
        pairs = pairs.select(*by, F.explode(F.array(F.struct("ta", "tb"), F.struct(F.col("tb").alias("ta"), F.col("ta").alias("tb")))).alias("p")).select(*by, "p.ta", "p.tb")
    else:
        pairs = pairs.select(*by, F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb"))
    return pairs.groupBy(*by, "ta", "tb").agg(F.count("*").alias("n"))


def label_pairs(pixels: DataFrame, edges: DataFrame, n_perm: int = 1000, seed: int = 1, directed: bool = True, label: str = "domain", strata=("section_id",), p_adjust: str = "BH") -> DataFrame:
    """Observed and permuted edge counts of label pairs.

    Directed: each edge counts both ways; mean, population sd, z (NULL where the sd is 0) and p-values, the
    adjustment over the upper triangle and mirrored.  Otherwise each edge counts once for the unordered pair;
    expected, ratio, log2 ratio and three p-values, each adjusted."""
    types = pixels.select(F.col(label).alias("ta")).distinct()
    grid = types.crossJoin(types.withColumnRenamed("ta", "tb"))  # label types, a fixed few
    grid = grid if directed else grid.where("ta <= tb")
    observed = _pair_counts(edges, pixels.select("pixel_id", F.col(label).alias("type")), (), directed)
    null = _pair_counts(edges, _shuffled_labels(pixels, label, strata, n_perm, seed), ("perm",), directed)
    o = grid.join(observed, ["ta", "tb"], "left").select("ta", "tb", F.coalesce("n", F.lit(0)).alias("o"))
    # Permutations in which a pair doesn't occur count as zero: they are what is missing from n_perm.
    x = o.join(null.select("ta", "tb", F.col("n").alias("k")), ["ta", "tb"], "left").groupBy("ta", "tb").agg(F.first("o").alias("observed_count"), F.coalesce(F.sum("k"), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)).alias("s2"), F.count("k").alias("seen"), F.sum((F.col("k") >= F.col("o")).cast("long")).alias("ge"), F.sum((F.col("k") <= F.col("o")).cast("long")).alias("le"))
    zero = F.lit(n_perm) - F.col("seen")
    upper = (F.coalesce("ge", F.lit(0)) + F.when(F.col("observed_count") == 0, zero).otherwise(0) + 1) / (n_perm + 1)
    lower = (F.coalesce("le", F.lit(0)) + zero + 1) / (n_perm + 1)
    x = x.withColumns({"mean": F.col("s1") / n_perm, "p_enriched": upper, "p_depleted": lower})
    x = x.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_enriched", "p_depleted")))
    if directed:
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n_perm - F.col("mean") * F.col("mean")))
        x = x.withColumn("permutation_sd", sd).withColumn("z_score", F.when(F.col("permutation_sd") > ROOT_EPS, (F.col("observed_count") - F.col("mean")) / F.nullif("permutation_sd", F.lit(0.0))))
        tri = adjust_p(x.where("ta <= tb"), "p_two_sided", "adj_p_two_sided", method=p_adjust).select(F.col("ta").alias("u"), F.col("tb").alias("v"), "adj_p_two_sided")
        joined = x.join(tri, (F.least("ta", "tb") == F.col("u")) & (F.greatest("ta", "tb") == F.col("v")))
        return joined.select(F.col("ta").alias("from_cell_type"), F.col("tb").alias("to_cell_type"), "observed_count", F.col("mean").alias("permutation_mean"), "permutation_sd", "z_score", "p_enriched", "p_depleted", "p_two_sided", "adj_p_two_sided")
    for p in ("p_enriched", "p_depleted", "p_two_sided"):
        x = adjust_p(x, p, "adj_" + p, method=p_adjust)
    ratio = safe_divide(F.col("observed_count").cast("double"), F.col("mean"))
    return x.withColumn("ratio", ratio).select(F.col("ta").alias("cell_type_a"), F.col("tb").alias("cell_type_b"), "observed_count", F.col("mean").alias("expected_count"), "ratio", F.when(F.col("ratio") > 0, F.log2("ratio")).alias("log2_ratio"), "p_enriched", "p_depleted", "p_two_sided", "adj_p_enriched", "adj_p_depleted", "adj_p_two_sided")


def ward_groups(z: dict[tuple[str, str], float], k: int) -> dict[str, int]:
    """Groups of labels by Ward's criterion on their z profiles (a small matrix, on the driver)."""
    import numpy as np

    names = sorted({a for a, _ in z})
    x = np.array([[z.get((a, b)) or 0.0 for b in names] for a in names])
    groups = {i: [i] for i in range(len(names))}
    while len(groups) > max(1, k):
        keys = list(groups)
        best = min(((len(groups[i]) * len(groups[j]) / (len(groups[i]) + len(groups[j])) * float(((x[groups[i]].mean(0) - x[groups[j]].mean(0)) ** 2).sum()), i, j) for n, i in enumerate(keys) for j in keys[n + 1 :]))
        groups[best[1]] += groups.pop(best[2])
    return {names[m]: g + 1 for g, (_, members) in enumerate(sorted(groups.items())) for m in members}
