"""Pixel clustering: PCA and k-means, neighbour-augmented features, Potts fields, diagnostics.

Cluster labels are canonical: 1.. in order of the centres' coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EPS
from ..storage import materialize, ship_package
from .graph import both_ways, neighborhood_average
from .preprocess import scale_features


def to_vectors(long: DataFrame, features: list[str] | None = None, keys=("section_id", "pixel_id")) -> DataFrame:
    """(keys, v): features as one array, in the order of ``features`` (else by name)."""
    rows = F.array_sort(F.collect_list(F.struct("feature", "value")))
    kept = long.where(F.col("feature").isin(features)) if features else long
    return kept.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.transform("r", lambda s: s["value"]).alias("v"))


def pca(vectors: DataFrame, k: int, scale: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores (keys, v), loadings and variance shares; centred, scaled only where asked."""
    v = vectors.withColumn("f", array_to_vector("v"))
    m, sd = v.select(Summarizer.mean(F.col("f")), Summarizer.std(F.col("f"))).first()
    m, sd = m.toArray(), sd.toArray()
    div = np.where(sd > 0, sd, 1.0) if scale else np.ones_like(sd)
    centred = F.zip_with(F.zip_with("v", F.array(*map(F.lit, m.tolist())), lambda a, b: a - b), F.array(*map(F.lit, div.tolist())), lambda a, b: a / b)
    v = vectors.withColumn("f", array_to_vector(centred))
    model = PCA(k=min(k, len(m)), inputCol="f", outputCol="s").fit(v)
    keys = [c for c in vectors.columns if c != "v"]
    return model.transform(v).select(*keys, vector_to_array("s").alias("v")), model.pc.toArray(), model.explainedVariance.toArray()


def kmeans(vectors: DataFrame, k: int, nstart: int = 5, seed: int = 1, max_iter: int = 100) -> tuple[DataFrame, np.ndarray, float]:
    """(keys, v, cluster), centres in canonical order, within-cluster sum; the best of ``nstart`` runs."""
    v = vectors.withColumn("f", array_to_vector("v"))
    fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="f", predictionCol="c").fit(v) for i in range(nstart)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    centres = np.array(best.clusterCenters())
    order = np.lexsort(np.round(centres, 9).T[::-1])
    rank = {int(old): new + 1 for new, old in enumerate(order)}
    label = F.element_at(F.create_map(*(x for a, b in rank.items() for x in (F.lit(a), F.lit(b)))), F.col("c"))
    return best.transform(v).select(*vectors.columns, label.alias("cluster")), centres[order], float(best.summary.trainingCost)


def augmented(long: DataFrame, edges: DataFrame, lam: float = 0.5) -> DataFrame:
    """Long rows of sqrt(1 - lam) * z(own) and sqrt(lam) * z(neighbour mean) under doubled feature names."""
    avg = neighborhood_average(long, edges)
    own = scale_features(avg.select("pixel_id", "feature", "value"))
    near = scale_features(avg.select("pixel_id", "feature", F.col("neighbor_mean").alias("value")))
    a = own.select("pixel_id", F.concat(F.lit("own_"), "feature").alias("feature"), (F.col("value") * (1 - lam) ** 0.5).alias("value"))
    return a.unionByName(near.select("pixel_id", F.concat(F.lit("nbr_"), "feature").alias("feature"), (F.col("value") * lam**0.5).alias("value")))


def cluster_pixels(long: DataFrame, k: int = 3, pca_components: int | None = None, nstart: int = 5, seed: int = 1, edges: DataFrame | None = None, lam: float = 0.5) -> DataFrame:
    """(pixel_id, cluster); with edges on neighbour-augmented features."""
    rows = augmented(long, edges, lam) if edges is not None else long
    vectors = to_vectors(rows, keys=("pixel_id",))
    if pca_components:
        vectors = pca(vectors, pca_components)[0]
    return kmeans(vectors, k, nstart, seed)[0].select("pixel_id", "cluster")


def adjacency_agreement(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, share of equal neighbours, share of pixels with an unequal one."""
    a = labels.select(F.col("pixel_id").alias("src"), F.col("cluster").alias("la"))
    b = labels.select(F.col("pixel_id").alias("dst"), F.col("cluster").alias("lb"))
    pairs = edges.select("src", "dst").join(a, "src").join(b, "dst")
    unequal = pairs.where("la <> lb").select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("n_boundary"))
    return pairs.agg(F.count("*").alias("n_edges"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("adjacent_pair_agreement")).crossJoin(unequal).crossJoin(labels.agg(F.count("*").alias("n"))).select("n_edges", "adjacent_pair_agreement", (F.col("n_boundary") / F.col("n")).alias("boundary_fraction"))  # one row each


def potts_energy(vectors: DataFrame, labels: DataFrame, edges: DataFrame, beta: float) -> DataFrame:
    """One row: data term (squared distance to the label's mean over the dimension), edge term, energy."""
    x = vectors.join(labels, "pixel_id").select("cluster", F.posexplode("v").alias("i", "x"))
    d = x.groupBy("cluster", "i").agg((F.var_pop("x") * F.count("*")).alias("ss")).agg((F.sum("ss") / (F.max("i") + 1)).alias("data_term"))
    a = labels.select(F.col("pixel_id").alias("src"), F.col("cluster").alias("la"))
    b = labels.select(F.col("pixel_id").alias("dst"), F.col("cluster").alias("lb"))
    e = edges.select("src", "dst", "weight").join(a, "src").join(b, "dst").agg((F.coalesce(F.sum(F.when(F.col("la") != F.col("lb"), F.col("weight"))), F.lit(0.0)) * beta).alias("edge_term"))
    return d.crossJoin(e).withColumn("energy", F.col("data_term") + F.col("edge_term"))  # one row each


def icm(x: np.ndarray, label: np.ndarray, near: list[list[tuple[int, float]]], beta: float, max_iter: int = 20, tolerance: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """Sequential iterated conditional modes in fixed order: never empties a class, keeps the label on ties,
    re-estimates centres after each sweep; the energy never rises."""
    k, d = label.max() + 1, x.shape[1]
    label = label.copy()

    def energy(c):
        edge = sum(w for i, row in enumerate(near) for j, w in row if i < j and label[i] != label[j])
        return float(((x - c[label]) ** 2).sum()) / d + beta * edge

    centres = np.array([x[label == c].mean(0) for c in range(k)])
    log = [energy(centres)]
    for _ in range(max_iter):
        size = np.bincount(label, minlength=k)
        for i in range(len(x)):
            if size[label[i]] == 1:
                continue
            cost = ((x[i] - centres) ** 2).sum(1) / d
            for j, w in near[i]:
                cost[label[j]] -= beta * w
            best = int(cost.argmin())
            if cost[best] < cost[label[i]] - 1e-15:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
        centres = np.array([x[label == c].mean(0) for c in range(k)])
        log.append(energy(centres))
        if log[-1] > log[-2] + 1e-6:
            raise ArithmeticError("the energy rose")
        if log[-2] - log[-1] <= tolerance:
            break
    return label, log


def cluster_pixels_hmrf(long: DataFrame, edges: DataFrame, k: int = 3, beta: float = 1.0, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """(section_id, pixel_id, cluster): k-means labels smoothed by ICM, a task per section (a section is one
    measured field, whose size does not grow with the number of sections)."""
    vectors = to_vectors(scale_features(long), keys=("section_id", "pixel_id"))
    start = kmeans(vectors, k, seed=seed)[0].select("section_id", "pixel_id", "v", "cluster")
    return _smoothed(start, edges, beta, max_iter).select("section_id", "pixel_id", "cluster")


def _smoothed(start: DataFrame, edges: DataFrame, beta: float, max_iter: int) -> DataFrame:
    """(section_id, pixel_id, cluster, sweeps, converged) from (section_id, pixel_id, v, cluster)."""
    ship_package(start.sparkSession)
    near = both_ways(edges).groupBy(F.col("src").alias("pixel_id")).agg(F.collect_list(F.struct("dst", "weight")).alias("near"))
    rows = start.join(near, "pixel_id", "left")

    def smooth(key, pdf):
        pdf = pdf.sort_values("pixel_id").reset_index(drop=True)
        at = {p: i for i, p in enumerate(pdf.pixel_id)}
        names, label = np.unique(pdf.cluster, return_inverse=True)
        adjacent = [[(at[n["dst"]], n["weight"]) for n in (r if r is not None else [])] for r in pdf.near]
        out, log = icm(np.array(pdf.v.tolist()), label, adjacent, beta, max_iter)
        settled = len(log) < 2 or log[-2] - log[-1] <= 1e-9
        return pd.DataFrame({"section_id": key[0], "pixel_id": pdf.pixel_id, "cluster": names[out], "sweeps": len(log) - 1, "converged": settled})

    return rows.groupBy("section_id").applyInPandas(smooth, "section_id string, pixel_id long, cluster int, sweeps int, converged boolean")


def cluster_diagnostics_spatial(long: DataFrame, edges: DataFrame, k: int = 3, lambda_grid=(0.0, 0.25, 0.5, 0.75, 1.0), pca_components: int | None = None, nstart: int = 5, seed: int = 1) -> DataFrame:
    """(lambda, k, tot_withinss, adjacent_pair_agreement, boundary_edge_fraction, n_edges_undirected, n_isolated),
    a row per weight of the neighbours.  Agreement describes smoothness; it is no measure of accuracy."""
    nodes = long.select("pixel_id").distinct()
    n_isolated = nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("pixel_id")), "pixel_id", "left_anti").count()
    out = []
    for lam in lambda_grid:
        vectors = to_vectors(augmented(long, edges, lam), keys=("pixel_id",))
        vectors = materialize(pca(vectors, pca_components)[0] if pca_components else vectors, "augmented")
        labels, _, within = kmeans(vectors, k, nstart, seed)
        r = adjacency_agreement(materialize(labels.select("pixel_id", "cluster"), "labels"), edges).first()
        out.append((float(lam), k, within, r["adjacent_pair_agreement"], 1 - r["adjacent_pair_agreement"], r["n_edges"], n_isolated))
    return long.sparkSession.createDataFrame(out, "lambda double, k int, tot_withinss double, adjacent_pair_agreement double, boundary_edge_fraction double, n_edges_undirected long, n_isolated long")


def cluster_diagnostics_hmrf(long: DataFrame, edges: DataFrame, k: int = 3, beta_grid=(0.0, 0.5, 1.0, 2.0, 4.0), seed: int = 1, max_iter: int = 20) -> DataFrame:
    """(beta, k, data_energy, spatial_energy, total_energy, tot_withinss, n_iterations, converged,
    adjacent_pair_agreement, boundary_edge_fraction, n_edges_undirected), a row per beta; all start from one
    k-means fit.  Iterations are the most that a section took."""
    vectors = materialize(to_vectors(scale_features(long), keys=("section_id", "pixel_id")), "vectors")
    fit, _, within = kmeans(vectors, k, seed=seed)
    start = materialize(fit.select("section_id", "pixel_id", "v", "cluster"), "start")
    out = []
    for beta in beta_grid:
        smoothed = materialize(_smoothed(start, edges, beta, max_iter), "smoothed")
        labels = smoothed.select("pixel_id", "cluster")
        e, a = potts_energy(start.select("pixel_id", "v"), labels, edges, beta).first(), adjacency_agreement(labels, edges).first()
        s = smoothed.agg(F.max("sweeps").alias("sweeps"), F.min("converged").alias("converged")).first()
        out.append((float(beta), k, e["data_term"], e["edge_term"], e["energy"], within, s["sweeps"], s["converged"], a["adjacent_pair_agreement"], 1 - a["adjacent_pair_agreement"], a["n_edges"]))
    return long.sparkSession.createDataFrame(out, "beta double, k int, data_energy double, spatial_energy double, total_energy double, tot_withinss double, n_iterations int, converged boolean, adjacent_pair_agreement double, boundary_edge_fraction double, n_edges_undirected long")


#: Rows on a side of a tile of distances, and of a block that a task holds: at most SILHOUETTE_ROWS, and such that there
#: are about SILHOUETTE_SPLIT blocks.
SILHOUETTE_BLOCK, SILHOUETTE_ROWS, SILHOUETTE_SPLIT = 2048, 131_072, 12


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; where the product form would lose digits, from differences."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    squares = x @ y.T
    squares *= -2
    squares += nx[:, None]
    squares += ny
    i, j = np.nonzero(squares <= 1e-6 * max(nx.max(initial=0), ny.max(initial=0)))
    for at in range(0, len(i), 65_536):
        a, b = i[at : at + 65_536], j[at : at + 65_536]
        squares[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return np.sqrt(squares, out=squares)


def _silhouette_sums(rows: DataFrame) -> DataFrame:
    """(a, la, lb, d): mean distance of every row to the rows of every cluster but itself.  Rows are packed in blocks; a
    task takes two blocks and their distances tile by tile, once for both directions, so pairs of rows are never rows of a
    table.  The work grows with the square of the rows, what a task holds does not grow."""
    ship_package(rows.sparkSession)
    rows = materialize(rows, "rows")
    n = rows.count()
    size = min(SILHOUETTE_ROWS, max(SILHOUETTE_BLOCK, -(-n // SILHOUETTE_SPLIT)))
    n_blocks, tile = -(-n // size) or 1, SILHOUETTE_BLOCK
    packed = rows.groupBy(F.pmod(F.xxhash64("pixel_id"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("pixel_id", "v", "cluster")).alias("r"))
    packed = materialize(packed.select("block", F.col("r.pixel_id").alias("pixel_id"), F.col("r.cluster").alias("cluster"), F.flatten("r.v").alias("v")), "blocks")
    # Every pair of blocks, dealt by both numbers.
    left = packed.toDF("i", "ids", "ca", "va").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n_blocks - 1))))
    right = packed.select(F.col("block").alias("j"), F.col("pixel_id").alias("jds"), F.col("cluster").alias("cb"), F.col("v").alias("vb"))
    n_pairs = n_blocks * (n_blocks + 1) // 2
    pairs = left.join(right, "j").select("i", "j", "ids", "ca", "va", "jds", "cb", "vb").repartition(n_pairs, "i", "j")

    def sums(ids, own, other, total, same_block):
        names, k = np.unique(other, return_inverse=True)
        count = np.tile(np.bincount(k).astype(float), (len(ids), 1))
        if same_block:  # the row itself, at distance 0
            count[own[:, None] == names] -= 1
        return pa.RecordBatch.from_pydict({"a": np.repeat(ids, len(names)), "la": np.repeat(own, len(names)).astype(np.int32), "lb": np.tile(names, len(ids)).astype(np.int32), "total": total.ravel(), "n": count.ravel()})

    def distances(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, ids, ca, va, jds, cb, vb = (batch.column(c)[r] for c in ("i", "j", "ids", "ca", "va", "jds", "cb", "vb"))
                ids, ca, jds, cb = (np.array(c.values.to_numpy(zero_copy_only=False)) for c in (ids, ca, jds, cb))
                x, y = (np.asarray(c.values.to_numpy(zero_copy_only=False)).reshape(len(k), -1) for c, k in ((va, ca), (vb, cb)))
                same = i.as_py() == j.as_py()
                member = [(np.unique(c)[:, None] == c).T.astype(float) for c in (ca, cb)]
                to_b, to_a = np.zeros((len(x), member[1].shape[1])), np.zeros((len(y), member[0].shape[1]))
                for p in range(0, len(x), tile):
                    for q in range(0, len(y), tile):
                        d = _distances(x[p : p + tile], y[q : q + tile])
                        to_b[p : p + tile] += d @ member[1][q : q + tile]
                        if not same:
                            to_a[q : q + tile] += d.T @ member[0][p : p + tile]
                yield sums(ids, ca, cb, to_b, same)
                if not same:
                    yield sums(jds, cb, ca, to_a, False)

    found = pairs.mapInArrow(distances, "a long, la int, lb int, total double, n double")
    return found.groupBy("a", "la", "lb").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select("a", "la", "lb", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("d"))


def silhouette(vectors: DataFrame, labels: DataFrame, max_subsample: int | None = 2000) -> DataFrame:
    """One row: mean Euclidean silhouette over at most ``max_subsample`` pixels (the operator's own bound; the
    sample is those of smallest hash, and its pairs are what the statistic is defined on), or over all for None."""
    rows = vectors.join(labels, "pixel_id").select("pixel_id", "v", "cluster")
    if max_subsample is None:
        return _mean_silhouette(_silhouette_sums(rows))
    rows = rows.orderBy(F.xxhash64("pixel_id"), "pixel_id").limit(max_subsample)
    a, b = rows.toDF("a", "va", "la"), F.broadcast(rows.toDF("b", "vb", "lb"))
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    mean = a.join(b, F.col("a") != F.col("b")).withColumn("d", d).groupBy("a", "la", "lb").agg(F.avg("d").alias("d"))
    return _mean_silhouette(mean)


def _mean_silhouette(mean: DataFrame) -> DataFrame:
    s = mean.groupBy("a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("other"))
    value = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other", F.lit(EPS)))
    return s.agg(F.avg(value).alias("silhouette"), F.count("*").alias("n"))


def cluster_diagnostics(long: DataFrame, max_k: int = 6, seed: int = 1) -> DataFrame:
    """(k, tot_withinss, silhouette) for k = 2..max_k."""
    vectors = to_vectors(long, keys=("pixel_id",))
    out = []
    for k in range(2, max_k + 1):
        labels, _, cost = kmeans(vectors, k, 2, seed)
        out.append((k, cost, silhouette(vectors, labels.select("pixel_id", "cluster")).first()[0]))
    return long.sparkSession.createDataFrame(out, "k int, tot_withinss double, silhouette double")


def define_niches(composition: DataFrame, types: list[str], k: int, transform: str = "hellinger", seed: int = 1) -> DataFrame:
    """(pixel_id, niche, nearest, second, ambiguity_ratio) from composition rows."""
    from .niches import niche_distances, profile_matrix, transform_composition

    profiles = profile_matrix(transform_composition(composition.where("eligible"), transform), types)
    _, centres, _ = kmeans(profiles.withColumnRenamed("profile", "v"), k, 3, seed)
    table = composition.sparkSession.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(centres)], "niche int, center array<double>")
    return niche_distances(profiles, table)


SINGLE_FIELD = ".__single_field__"


def detect_spatial_niches(pixels: DataFrame, k_niches: int, label: str = "domain", subject: str | None = None, section: str | None = None, method: str = "radius", radius: float = 1.5, k: int = 10, include_self: bool = True, min_neighbors: int = 3, transform: str = "hellinger", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Niches of (pixel_id, x, y, label, ...) from neighbourhood compositions within subject-section fields.

    Returns the pixels, with n_neighbors, eligible, exclusion_reason, niche, niche_label, nearest, second and
    ambiguity_ratio, and the exclusion summary (field_id, n_pixels, n_eligible, n_excluded, excluded_fraction).
    Labels and field identifiers must not be missing or empty; pixel_ids are unique over all fields.  Labels that
    occur span the composition, so fields are jointly clustered."""
    from .niches import composition

    given = [c for c in (subject, section) if c]
    bad = " or ".join(f"`{c}` is null or cast(`{c}` as string) = ''" for c in (label, *given))
    if not pixels.where(bad).isEmpty():
        raise ValueError("labels and field identifiers must be non-missing and non-empty")
    field = F.concat_ws("\r", *(F.col(c).cast("string") for c in given)) if given else F.lit(SINGLE_FIELD)
    at = pixels.withColumn("field_id", field)
    rows = materialize(composition(at, method, radius, k, include_self, min_neighbors, label, ("field_id",)), "composition")
    types = [r[0] for r in at.select(label).distinct().orderBy(label).collect()]  # kinds of domains, a fixed few
    found = define_niches(rows, types, k_niches, transform, seed)
    counts = rows.select("pixel_id", "n_neighbors", "eligible").distinct()
    out = at.join(counts, "pixel_id", "left").join(found, "pixel_id", "left")
    out = out.withColumns({"n_neighbors": F.coalesce("n_neighbors", F.lit(0)), "eligible": F.coalesce("eligible", F.lit(False))})
    out = out.withColumns({"exclusion_reason": F.when(~F.col("eligible"), "below_min_neighbors"), "niche_label": F.concat(F.lit("niche_"), F.col("niche").cast("string"))})
    return out, exclusion_summary(out)


def exclusion_summary(pixels: DataFrame) -> DataFrame:
    """(field_id, n_pixels, n_eligible, n_excluded, excluded_fraction) of (field_id, eligible)."""
    n, kept = F.count("*"), F.sum(F.col("eligible").cast("long"))
    return pixels.groupBy("field_id").agg(n.alias("n_pixels"), kept.alias("n_eligible"), (n - kept).alias("n_excluded"), ((n - kept) / n).alias("excluded_fraction"))


def nnls(a: np.ndarray, b: np.ndarray, iterations: int = 500) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    w = a.T @ (b - a @ x)
    for _ in range(iterations):
        if active.all() or w[~active].max() <= 1e-12:
            break
        active[np.flatnonzero(~active)[w[~active].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 0:
                break
            bad = active & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-14
            if not active.any():
                break
        x = s
        w = a.T @ (b - a @ x)
    return x


def deconvolve(counts: DataFrame, signature: dict[str, dict[str, float]], method: str = "nnls", min_confidence: float = 0.1, min_shared: int = 2) -> DataFrame:
    """(spot_id, cell_type, proportions, confidence, margin, entropy, residual) of (spot_id, feature, value)
    against a small signature {type: {gene: value}}; unresolved below the confidence."""
    ship_package(counts.sparkSession)
    types = sorted(signature)
    genes = sorted(set.intersection(*(set(s) for s in signature.values())))
    ref = np.array([[signature[t][g] for t in types] for g in genes], dtype=float)
    ref = ref / np.maximum(ref.sum(0), EPS)
    vectors = counts.where(F.col("feature").isin(genes)).groupBy("spot_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    vectors = vectors.select("spot_id", F.transform(F.array(*map(F.lit, genes)), lambda g: F.coalesce(F.element_at("m", g), F.lit(0.0))).alias("v"))
    if len(genes) < min_shared:
        raise ValueError("too few shared genes")

    def solve(batches):
        for pdf in batches:
            rows = []
            for v in pdf.v:
                v = np.asarray(v) / max(float(np.sum(v)), EPS)
                s = nnls(ref, v) if method == "nnls" else (ref.T @ v) / np.maximum(np.linalg.norm(ref, axis=0) * max(np.linalg.norm(v), EPS), EPS)
                s = np.maximum(s, 0)
                s = s / s.sum() if s.sum() > 0 else s
                top = np.sort(s)[::-1]
                rows.append((types[int(s.argmax())] if top[0] >= min_confidence else "unresolved", dict(zip(types, s.tolist(), strict=True)), float(top[0]), float(top[0] - (top[1] if len(top) > 1 else 0)), float(-(s[s > 0] * np.log(s[s > 0])).sum()), float(np.linalg.norm(v - ref @ s))))
            yield pd.DataFrame({"spot_id": pdf.spot_id, **{n: [r[i] for r in rows] for i, n in enumerate(("cell_type", "proportions", "confidence", "margin", "entropy", "residual"))}})

    return vectors.mapInPandas(solve, f"spot_id {counts.schema['spot_id'].dataType.simpleString()}, cell_type string, proportions map<string,double>, confidence double, margin double, entropy double, residual double")


def transfer_labels(pixels: DataFrame, labels: DataFrame, max_distance: float | None = None, keys=("section_id",)) -> DataFrame:
    """(keys, pixel_id, cell_type, matched): exact coordinates, or the nearest label within ``max_distance``."""
    if max_distance is None:
        found = pixels.join(labels.select(*keys, "x", "y", "cell_type"), [*keys, "x", "y"], "left")
        return found.select(*keys, "pixel_id", "cell_type", F.col("cell_type").isNotNull().alias("matched"))
    from .graph import radius_pairs

    at = lambda d, i: d.select(*keys, F.col(i).alias("id"), "x", "y")
    pairs = radius_pairs(at(pixels, "pixel_id"), at(labels, "object_id"), max_distance, keys, 0.0)
    best = pairs.groupBy(F.col("src").alias("pixel_id")).agg(F.min_by("dst", F.struct("d2", "dst")).alias("object_id"))
    out = pixels.select(*keys, "pixel_id").join(best, "pixel_id", "left").join(labels.select("object_id", "cell_type"), "object_id", "left")
    return out.select(*keys, "pixel_id", "cell_type", F.col("cell_type").isNotNull().alias("matched"))


def tissue_mask(pixels: DataFrame, quantile_at: float = 0.5) -> DataFrame:
    """(pixel_id, score, tissue) of (section_id, pixel_id, x, y, tic, peak_count): mean z of log1p of both at or
    above the quantile, and in the largest 4-connected part."""
    from .graph import largest_components, lattice_edges

    every = Window.partitionBy("section_id")
    z = lambda c: (F.log1p(c) - F.avg(F.log1p(c)).over(every)) / F.nullif(F.stddev_samp(F.log1p(c)).over(every), F.lit(0.0))
    scored = pixels.withColumn("score", (F.coalesce(z("tic"), F.lit(0.0)) + F.coalesce(z("peak_count"), F.lit(0.0))) / 2)
    cut = scored.groupBy("section_id").agg(F.percentile("score", F.lit(quantile_at)).alias("cut"))
    kept = scored.join(F.broadcast(cut), "section_id").where("score >= cut")  # a row per section
    main = largest_components(kept, lattice_edges(kept, "rook")).select("pixel_id").withColumn("tissue", F.lit(True))
    return scored.join(main, "pixel_id", "left").select("section_id", "pixel_id", "score", F.coalesce("tissue", F.lit(False)).alias("tissue"))
