"""Small hand-computed cases and invariants of the engine's operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionfield.functions import distributions as dist
from ionfield.functions import expressions as ex
from ionfield.operators import clustering, differential, distance, graph, matching, niches, pixels, preprocess, regions, registration, signaling, svg
from ionfield.operators.components import connected_components


def grid(spark, w, h, section="s"):
    return spark.createDataFrame([(section, y * w + x, x, y) for y in range(h) for x in range(w)], "section_id string, pixel_id long, x long, y long")


def long_of(spark, values, feature="mz_1"):
    return spark.createDataFrame([("s", i, feature, v) for i, v in values], "section_id string, pixel_id long, feature string, value double")


# --- graphs


def test_lattice_edges(spark):
    nodes = grid(spark, 3, 3)
    assert graph.lattice_edges(nodes, "rook").count() == 12
    assert graph.lattice_edges(nodes, "queen").count() == 20
    s = graph.summary(nodes, graph.lattice_edges(nodes, "rook")).first()
    assert (s["n_nodes"], s["n_edges"], s["n_isolated"]) == (9, 12, 0)


def test_sections_never_touch(spark):
    nodes = grid(spark, 2, 1, "a").unionByName(grid(spark, 2, 1, "b").withColumn("pixel_id", F.col("pixel_id") + 10))
    assert graph.lattice_edges(nodes, "rook").count() == 2


def test_lattice_step(spark):
    nodes = grid(spark, 3, 1).withColumn("x", F.col("x") * 50.0)
    assert graph.lattice_edges(nodes, "rook", step=(50, 1)).count() == 2
    assert graph.lattice_edges(nodes, "rook").count() == 0


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 1001 + i) for i in range(200)]
    got = connected_components(spark.createDataFrame(path + star, "src long, dst long")).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, 101), (1000, 201)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 20, (40, 2)))]
    df = spark.createDataFrame(pts, "section_id string, id long, x double, y double")
    got = {}
    for r in graph.knn_pairs(df, df, 4, 1.0).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for _, i, x, y in pts:
        best = sorted((round((x - a) ** 2 + (y - b) ** 2, 12), j) for _, j, a, b in pts)[:4]
        assert [d for _, d in sorted(got[i])] == [j for _, j in best]


def test_neighborhood_average_corner_and_isolate(spark):
    nodes = grid(spark, 3, 3).unionByName(spark.createDataFrame([("s", 99, 50, 50)], "section_id string, pixel_id long, x long, y long"))
    long = long_of(spark, [(i, float(i)) for i in range(9)] + [(99, 7.0)])
    got = {r["pixel_id"]: r["neighbor_mean"] for r in graph.neighborhood_average(long, graph.lattice_edges(nodes, "rook")).collect()}
    assert got[0] == 2.0 and got[4] == 4.0 and got[99] == 7.0


# --- spatial statistics


def test_geary_chain(spark):
    nodes = spark.createDataFrame([("s", i, i, 1) for i in (1, 2, 3)], "section_id string, pixel_id long, x long, y long")
    edges = graph.lattice_edges(nodes, "rook")
    for values, expected in (((1.0, 2.0, 3.0), 0.5), ((1.0, 3.0, 1.0), 1.5)):
        out = svg.autocorrelation(long_of(spark, list(zip((1, 2, 3), values, strict=True))), edges, "geary").first()
        assert out["statistic"] == pytest.approx(expected)


def test_isolates_and_missing_values_take_no_part(spark):
    nodes = grid(spark, 4, 4)
    values = [(i, float(i % 4)) for i in range(16)]
    base = svg.autocorrelation(long_of(spark, values), graph.lattice_edges(nodes, "rook")).first()
    more = nodes.unionByName(spark.createDataFrame([("s", 500, 100, 100)], "section_id string, pixel_id long, x long, y long"))
    out = svg.autocorrelation(long_of(spark, [*values, (500, 1e9), (501, None)]), graph.lattice_edges(more, "rook")).first()
    assert out["statistic"] == pytest.approx(base["statistic"]) and out["n_isolated"] == 1


def test_constant_feature_has_no_statistic(spark):
    edges = graph.lattice_edges(grid(spark, 3, 3), "rook")
    out = svg.autocorrelation(long_of(spark, [(i, 2.0) for i in range(9)]), edges, n_perm=5).first()
    assert out["statistic"] is None and out["p_value"] is None
    assert svg.binspect(long_of(spark, [(i, 2.0) for i in range(9)]), edges).first()["status"] == "not_tested"


def test_block_beats_checkerboard(spark):
    edges = graph.lattice_edges(grid(spark, 6, 6), "rook")
    block = long_of(spark, [(i, float(i % 6 < 3)) for i in range(36)], "mz_block")
    mixed = long_of(spark, [(i, float((i % 6 + i // 6) % 2)) for i in range(36)], "mz_mixed")
    out = {r["feature"]: r for r in svg.autocorrelation(block.unionByName(mixed), edges, n_perm=29).collect()}
    assert out["mz_block"]["statistic"] > 0.5 > out["mz_mixed"]["statistic"] and out["mz_block"]["p_value"] < 0.05
    again = {r["feature"]: r["p_value"] for r in svg.autocorrelation(block.unionByName(mixed), edges, n_perm=29).collect()}
    assert again == {k: r["p_value"] for k, r in out.items()}


def test_autocorrelation_with_missing_values_per_feature(spark):
    """Features on different sets of nodes form groups of their own; each is as if it were alone."""
    edges = graph.lattice_edges(grid(spark, 5, 5), "rook")
    values = {"mz_1": [float(i * i % 7) for i in range(25)], "mz_2": [None if i % 6 == 0 else float(i % 5) for i in range(25)], "mz_3": [float(i % 3) if i < 20 else None for i in range(25)]}
    frames = {f: long_of(spark, list(enumerate(v)), f) for f, v in values.items()}
    together = frames["mz_1"].unionByName(frames["mz_2"]).unionByName(frames["mz_3"])
    for statistic in ("moran", "geary"):
        got = {r["feature"]: r for r in svg.autocorrelation(together, edges, statistic, 19).collect()}
        for f, frame in frames.items():
            alone = svg.autocorrelation(frame, edges, statistic, 19).first()
            assert (got[f]["statistic"], got[f]["p_value"], got[f]["n_effective"]) == (pytest.approx(alone["statistic"]), alone["p_value"], alone["n_effective"])


def test_two_means_against_all_splits(spark):
    rng = np.random.default_rng(2)
    for n in (2, 5, 30):
        v = np.round(rng.gamma(1.0, 3.0, n), 1)
        cost = {c: v[v < c].var() * (v < c).sum() + v[v >= c].var() * (v >= c).sum() for c in sorted(set(v))[1:]}
        got = svg.two_means(long_of(spark, list(enumerate(v.tolist())))).first()
        assert cost[got["cut"]] == pytest.approx(min(cost.values())) and got["threshold"] == pytest.approx((v[v < got["cut"]].mean() + v[v >= got["cut"]].mean()) / 2)


# --- preprocessing


def test_two_normalisations_differ(spark):
    long = spark.createDataFrame([(1, "mz_a", 1.0), (1, "mz_b", 3.0), (2, "mz_a", 10.0), (2, "mz_b", 10.0), (3, "mz_a", 0.0), (3, "mz_b", 0.0)], "pixel_id long, feature string, value double")
    median = {(r[0], r[1]): r[2] for r in preprocess.tic_normalize(long).select("pixel_id", "feature", "value").collect()}
    total = {(r[0], r[1]): r[2] for r in preprocess.tic_normalize(long, "total").select("pixel_id", "feature", "value").collect()}
    assert median[1, "mz_b"] == pytest.approx(0.75 * 12) and median[3, "mz_a"] == 0
    assert total[1, "mz_b"] == pytest.approx(0.75) and total[3, "mz_a"] == 0


def test_pretty_breaks():
    assert preprocess.pretty_breaks(0, 1, 5) == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert preprocess.pretty_breaks(0, 10, 4) in ([0, 2, 4, 6, 8, 10], [0.0, 5.0, 10.0])


def test_otsu_separates_two_levels(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1.1, 1.2, 5, 5.1, 5.2]], "v double")
    assert 1.15 < preprocess.otsu(df, "v").first()["threshold"] < 5  # the middle of the bin that holds 1.2
    assert preprocess.otsu(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").first()["threshold"] == 2.0


def test_column_names():
    assert pixels.normalize_mz_column_names(["100.5", "a-b", "x"]) == ["mz_100.5", "a_b", "x"]
    assert pixels.stable_mz_column_names([100.0, 100.0]) == ["mz_100", "mz_100_feature_2"]


def test_wide_and_long(spark):
    wide = spark.createDataFrame([(1, 0.0, 1.0, float("nan")), (2, 1.0, 2.0, 3.0)], "pixel_id long, x double, `mz_100.5` double, `mz_200` double")
    rows = {(r["pixel_id"], r["feature"]): r["value"] for r in pixels.to_long(wide).collect()}
    assert rows[1, "mz_200"] is None and rows[2, "mz_100.5"] == 2.0
    assert pixels.resolve_feature_column(wide, 190) == "mz_200"
    assert pixels.reduce_features(wide, ["mz_200"]).columns == ["pixel_id", "x", "mz_200"]
    with pytest.raises(ValueError):
        pixels.required_columns(wide, ["y"])


# --- statistics


def test_tails():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert dist.f_sf(4.0, 2, 10) == pytest.approx(0.0530, abs=2e-4)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert dist.fisher_greater(3, 1, 1, 3) == pytest.approx(0.242857, abs=1e-6)
    assert dist.signed_rank_counts(3).tolist() == [1, 1, 1, 2, 1, 1, 1]


def test_rank_sum_counts_against_brute_force():
    for m, n in ((2, 3), (3, 3), (4, 2)):
        counts = np.zeros(m * n + 1)
        for y in itertools.combinations(range(m + n), m):
            counts[sum(y) - m * (m - 1) // 2] += 1
        assert dist.rank_sum_counts(m, n).tolist() == counts.tolist()


def test_wilcoxon_exact():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([2.1, 3.3, 4.6, 5.7, 6.9])
    out = differential.wilcoxon_test(x, y, True)
    assert out["exact"] and out["p_value"] == pytest.approx(2 / 32) and out["shift"] == pytest.approx(1.6, abs=0.1)
    assert differential.wilcoxon_test(x, x, True, "exact")["status"] == "skipped"
    assert differential.wilcoxon_test(x, x + 100, False)["p_value"] == pytest.approx(2 / 252)


def _samples(spark, effect=1.0, n=6):
    rows = []
    rng = np.random.default_rng(3)
    for s in range(n):
        for g in "ab":
            for t in range(2):
                rows.append((f"s{s}", g, f"{s}{g}{t}", "mz_1", float(s + (effect if g == "b" else 0) + rng.normal(0, 0.05)), float(t), float(s % 2)))
    return spark.createDataFrame(rows, "subject_id string, grp string, sample_id string, feature string, value double, x double, y double")


def test_paired_t_uses_replicates(spark):
    out = differential.differential_t(_samples(spark), "grp", "subject_id").first()
    assert out["method"] == "paired_t" and out["n_pairs"] == 6 and out["effect_size"] == pytest.approx(1, abs=0.1) and out["p_value"] < 1e-4
    assert differential.differential_t(_samples(spark), "grp", "sample_id", unit="sample").first()["method"] == "welch_t"


def test_degenerate_t(spark):
    df = spark.createDataFrame([(f"s{i}", g, "mz_1", v) for i in range(3) for g, v in (("a", 1.0), ("b", 2.0))], "subject_id string, grp string, feature string, value double")
    assert differential.differential_t(df, "grp", "subject_id").first()["p_value"] == 0.0


def test_lmm_finds_the_effect(spark):
    df = _samples(spark, 1.0, 6).withColumn("section_id", F.lit("a"))
    out = differential.spatial_lmm(df, "grp", "subject_id", "section_id", "x", "y").first()
    assert out["status"] == "fitted" and out["estimate"] == pytest.approx(1, abs=0.2) and 0 <= out["nugget"] <= 1 and out["p_value"] < 0.01
    few = differential.spatial_lmm(df, "grp", "subject_id", "section_id", "x", "y", min_subjects=50).first()
    assert few["status"] == "failed" and few["error_message"]


def test_gam_pixel_mode_has_no_p(spark):
    rows = spark.createDataFrame([("mz_1", float(i % 20), float(np.sin(i % 20 / 4)), f"s{i % 6}") for i in range(120)], "feature string, distance double, value double, s0 string")
    out = differential.distance_gam(rows).first()
    assert out["status"] == "fitted" and out["p_value"] is None and out["r_squared"] > 0.8
    assert differential.distance_gam(rows, "s0").first()["p_value"] is not None


def test_adjustments(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, None])], "i int, p double")
    get = lambda m: [r["adj_p_value"] for r in ex.adjust_p(df, "p", method=m).orderBy("i").collect()]
    assert get("BH")[:4] == pytest.approx([0.04] * 4) and get("BH")[4] is None
    assert get("holm")[:4] == pytest.approx([0.04, 0.06, 0.06, 0.06])
    assert get("bonferroni")[:4] == pytest.approx([0.04, 0.08, 0.12, 0.16])
    assert get("hochberg")[:4] == pytest.approx([0.04] * 4)
    assert get("BY")[0] == pytest.approx(0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4))


# --- matching


def test_hungarian_against_brute_force():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (3, 5), (4, 6)):
        cost = rng.uniform(0, 1, (n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        pairs = matching.hungarian(cost)
        assert sorted(i for i, _ in pairs) == list(range(n)) and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_greedy_and_optimal(spark):
    msi = spark.createDataFrame([(1, 100.0, "pos"), (2, 99.9992, "pos")], "msi_id long, msi_mz double, mode string")
    lc = spark.createDataFrame([(1, 100.0001, "pos"), (2, 100.0008, "pos")], "lc_id long, lc_mz double, mode string")
    c = matching.find_candidates(msi, lc, 10)
    assert c.count() == 3
    assert matching.assign(c, 10, "greedy").count() == 1 and matching.assign(c, 10, "optimal").count() == 2


def test_missing_mode_never_matches(spark):
    msi = spark.createDataFrame([(1, 100.0, None)], "msi_id long, msi_mz double, mode string")
    lc = spark.createDataFrame([(1, 100.0, None)], "lc_id long, lc_mz double, mode string")
    assert matching.find_candidates(msi, lc, 10).count() == 0


# --- regions and registration


def test_polygon_of_a_square(spark):
    px = spark.createDataFrame([("s", "r", x, y) for x in range(2) for y in range(2)], "section_id string, roi_id string, x long, y long")
    assert regions.region_polygons(px).count() == 9
    ring = px.unionByName(spark.createDataFrame([("s", "t", 10 + x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], "section_id string, roi_id string, x long, y long"))
    assert regions.region_polygons(ring).where("ring_role = 'hole'").count() == 5


def test_ring_membership(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (2.0, 2.0), (0.25, 0.25)], "x double, y double")
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    hole = [(0.2, 0.2), (0.3, 0.2), (0.3, 0.3), (0.2, 0.3)]
    got = [r[0] for r in df.select(regions.point_in_polygon(F.col("x"), F.col("y"), square, [hole])).collect()]
    assert got == [True, True, False, False]


def test_overlap_error(spark):
    with pytest.raises(ValueError):
        regions.apply_overlap(grid(spark, 2, 1), [("a", F.col("x") >= 0), ("b", F.col("x") >= 1)])


def test_affine_recovery(spark):
    pts = [("s", float(x), float(y), 2 * x - y + 1.0, 0.5 * x + 3 * y) for x, y in ((0, 0), (1, 0), (0, 1), (3, 2))]
    df = spark.createDataFrame(pts, "section_id string, histology_x double, histology_y double, msi_x double, msi_y double")
    fit = registration.fit_affine(df).first()
    assert fit["rmse"] < 1e-10 and fit["ux"] == pytest.approx(2) and fit["vy"] == pytest.approx(3)
    line = spark.createDataFrame([("s", float(i), float(i), 0.0, 0.0) for i in range(4)], df.schema)
    with pytest.raises(ValueError):
        registration.check_affine(line, registration.fit_affine(line))


def test_mask_agreement_of_equal_masks(spark):
    m = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x long, y long")
    out = registration.mask_agreement(m, m).first()
    assert (out["overlap"], out["dice"], out["boundary_median"]) == (1.0, 1.0, 0.0)


# --- distances, niches, communication


def test_distance_in_physical_units(spark):
    px = grid(spark, 9, 9).withColumn("domain", F.when(F.col("x").between(2, 6) & F.col("y").between(2, 6), "t").otherwise("o"))
    out = {r["pixel_id"]: r for r in distance.reference_distance(px, "t", 50, 25).collect()}
    assert out[4 * 9 + 4]["distance"] == pytest.approx(-50) and out[0]["distance"] > 0
    assert distance.reference_distance(px, "none", 50, 25).where("status = 'target_absent'").count() == 81


def test_composition_ties_and_self(spark):
    px = spark.createDataFrame([("s", i + 1, 0, 0, d) for i, d in enumerate("ABC")], "section_id string, pixel_id long, x long, y long, domain string")
    rows = niches.composition(px, "knn", k=2).where("pixel_id = 3").collect()
    assert {r["type"] for r in rows} == {"C", "A"}


def test_enrichment_counts_both_ways(spark):
    px = grid(spark, 3, 2).withColumn("domain", F.when(F.col("x") < 2, "A").otherwise("B"))
    edges = graph.lattice_edges(px, "rook")
    out = {(r["from_cell_type"], r["to_cell_type"]): r["observed_count"] for r in niches.label_pairs(px, edges, 5).collect()}
    assert out["A", "A"] == 8 and out["A", "B"] == out["B", "A"] == 2


def test_lr_database(spark):
    db = spark.createDataFrame([("L", "R"), ("L|L2", "R"), ("L", "missing"), ("L", "R")], "ligand string, receptor string")
    assert signaling.prepare_database(db, ["L", "L2", "R"]).count() == 2


# --- clustering


def test_icm_energy_and_beta_zero():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (24, 2)), rng.normal(3, 1, (25, 2))])
    near = [[(j, 1.0) for j in (i - 1, i + 1, i - 7, i + 7) if 0 <= j < 49 and (abs(i - j) == 7 or i // 7 == j // 7)] for i in range(49)]
    start = (x[:, 0] > 1.5).astype(int)
    rough, log = clustering.icm(x, start, near, 0.0)
    smooth, log4 = clustering.icm(x, start, near, 4.0)
    boundary = lambda lab: sum(lab[i] != lab[j] for i, r in enumerate(near) for j, _ in r)
    assert all(b <= a + 1e-9 for a, b in zip(log4, log4[1:], strict=False)) and boundary(smooth) <= boundary(rough)


def test_nnls_recovers_a_mixture():
    a = np.array([[0.7, 0.1], [0.2, 0.3], [0.1, 0.6]])
    assert clustering.nnls(a, a @ np.array([0.25, 0.75])) == pytest.approx([0.25, 0.75])
    assert (clustering.nnls(a, -a @ np.array([1.0, 1.0])) == 0).all()


def test_tissue_grid(spark):
    px = grid(spark, 9, 9).withColumn("in", F.col("x").between(2, 6) & F.col("y").between(2, 6))
    px = px.withColumns({"tic": F.when(F.col("in"), 100.0).otherwise(1.0), "peak_count": F.when(F.col("in"), 50.0).otherwise(1.0)})
    assert clustering.tissue_mask(px, 0.8).where("tissue").count() == 25


def test_formulas(spark):
    df = spark.createDataFrame([("C2H5OH",), ("H2O",)], "f string")
    assert [r[0] for r in df.select(ex.format_formula(ex.parse_formula(F.col("f")))).collect()] == ["C2H6O", "H2O"]
    assert [r[0] for r in df.select(ex.add_hydrogen(F.col("f"), -3)).collect()] == ["C2H3O", None]
    assert math.isclose(spark.range(1).select(ex.normalized_logistic(F.lit(1.0))).first()[0], 1.0)


# --- images, labels, workflows


def test_watershed_parts_touching_nuclei():
    from ionfield.operators import images

    y, x = np.mgrid[0:24, 0:34]
    grey = np.full((24, 34), 200.0)
    for cx in (10, 20):
        grey[(y - 12) ** 2 + (x - cx) ** 2 <= 36] = 30.0
    found = images.segment_nuclei(grey)
    assert sorted(round(o["x"]) for o in found) == [10, 20]
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert images.fill_holes(ring).sum() == 25 and images.label_components(~ring).max() == 2
    assert images.flood(ring, (1, 1)).sum() == 24 and not images.flood(ring, (3, 3)).any()


def test_label_contracts(spark):
    from ionfield.operators import labels

    px = grid(spark, 2, 2)
    with pytest.raises(ValueError):
        labels.apply_roi_labels(px, spark.createDataFrame([(0, "a"), (0, "b")], "pixel_id long, roi_id string"))
    with pytest.raises(ValueError):
        labels.validate_labels(spark.createDataFrame([(0, 0, "a"), (0, 0, "b")], "x long, y long, label string"))
    assert labels.detect_result(["Name", "VIP score"]) == "vip" and labels.detect_result(["PC1"]) == "pca_scores" and labels.detect_result(["x"]) == "unknown"


def test_circular_tests_are_refused(spark):
    from ionfield.operators import workflows

    with pytest.raises(ValueError):
        workflows.analyze_distance_gradient(long_of(spark, [(0, 1.0)]), grid(spark, 2, 2).withColumn("domain", F.lit("t")), "t", 1, 1, "subject_id", domain_features=["mz_1"])


def test_code_first_pipeline(spark, tmp_path):
    from ionfield.operators import workflows

    f = tmp_path / "p.csv"
    f.write_text("x,y,100,150,200,250,300\n" + "".join(f"{x},{y},{x + 0.1 * y},1,2,3,{0 if x else 4}\n" for x in range(4) for y in range(4)))
    out = workflows.run_pipeline(spark, str(f))
    qc = out.tables["qc"].first()
    assert (qc["n_pixels"], qc["n_kept"], qc["n_features"]) == (16, 16, 5)
    assert out.tables["matrix"].groupBy("pixel_id").agg(F.sum(F.pow(F.lit(10.0), "value") - 1).alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    assert out.tables["features"].where("mz = 150").count() == 1
