import os

import numpy as np
import pytest

from ionfield import storage
from ionfield.operators import clustering, graph, preprocess
from ionfield.plans.bindings import p1
from ionfield.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
PIXELS = "subject string, section string, pixel_id long, x long, y long, domain string"


@pytest.fixture(scope="module")
def fields(spark):
    """Two subjects on the same coordinates with their own domains, and a lone pixel."""
    rows = [(s, "a", n * 100 + x * 10 + y, x, y, "left" if x < 4 else "right" if n == 0 else "other") for n, s in enumerate(("s1", "s2")) for x in range(8) for y in range(8)]
    return spark.createDataFrame([*rows, ("s1", "a", 999, 50, 50, "left")], PIXELS)


def test_niches_stay_in_their_field_and_exclusions_are_counted(spark, fields):
    out, excluded = clustering.detect_spatial_niches(fields, 3, subject="subject", section="section", radius=1.0, min_neighbors=4)
    rows = {r["pixel_id"]: r for r in out.collect()}
    place = {(r["subject"], r["x"], r["y"]) for r in rows.values()}
    for r in rows.values():
        n = sum((r["subject"], r["x"] + dx, r["y"] + dy) in place for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))
        assert (r["n_neighbors"], r["eligible"]) == (n, n >= 4)
        assert (r["exclusion_reason"], r["niche_label"] is None) == ((None, False) if n >= 4 else ("below_min_neighbors", True))
    deep = {d: {rows[i]["niche"] for i in rows if rows[i]["domain"] == d and rows[i]["eligible"] and rows[i]["x"] in (1, 6)} for d in ("left", "right", "other")}
    assert all(len(v) == 1 for v in deep.values()) and len(set.union(*deep.values())) == 3
    summary = {r["field_id"]: r for r in excluded.collect()}
    for s in ("s1", "s2"):
        mine = [r for r in rows.values() if r["subject"] == s]
        got = summary[f"{s}\ra"]
        assert (got["n_pixels"], got["n_eligible"], got["n_excluded"]) == (len(mine), sum(r["eligible"] for r in mine), sum(not r["eligible"] for r in mine))
        assert got["excluded_fraction"] == pytest.approx(got["n_excluded"] / got["n_pixels"])
    whole, one = clustering.detect_spatial_niches(fields.where("subject = 's1'"), 2, radius=1.0)
    assert [r["field_id"] for r in one.collect()] == [clustering.SINGLE_FIELD] and whole.count() == 65
    with pytest.raises(ValueError):
        clustering.detect_spatial_niches(spark.createDataFrame([("s", "a", 1, 1, 1, "")], PIXELS), 1)


@pytest.fixture(scope="module")
def noisy(spark):
    """Two halves of a grid with noise: long rows, edges, and the values as an array."""
    rng = np.random.default_rng(8)
    v = np.array([[(x >= 4) * 2 + rng.normal(0, 1.0), (x >= 4) + rng.normal(0, 0.8)] for x in range(8) for _ in range(8)])
    pixels = spark.createDataFrame([("s", i, i // 8, i % 8) for i in range(64)], "section_id string, pixel_id long, x long, y long")
    long = spark.createDataFrame([("s", i, f"mz_{f}", float(v[i, f])) for i in range(64) for f in range(2)], "section_id string, pixel_id long, feature string, value double")
    return long, graph.lattice_edges(pixels, "queen"), v


def test_diagnostics_over_neighbour_weights(noisy):
    long, edges, _ = noisy
    rows = clustering.cluster_diagnostics_spatial(long, edges, 2, (0.0, 0.5, 1.0)).collect()
    pairs = [(r["src"], r["dst"]) for r in edges.collect()]
    for r in rows:
        label = {x["pixel_id"]: x["cluster"] for x in clustering.cluster_pixels(long, 2, edges=edges, lam=r["lambda"]).collect()}
        agreement = np.mean([label[a] == label[b] for a, b in pairs])
        assert (r["adjacent_pair_agreement"], r["boundary_edge_fraction"]) == pytest.approx((agreement, 1 - agreement))
        assert (r["n_edges_undirected"], r["n_isolated"], r["k"]) == (len(pairs), 0, 2)
    assert rows[2]["adjacent_pair_agreement"] > rows[0]["adjacent_pair_agreement"]


def test_diagnostics_over_smoothing(noisy):
    long, edges, v = noisy
    rows = clustering.cluster_diagnostics_hmrf(long, edges, 2, (0.0, 1.0, 4.0)).collect()
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    pairs = [(r["src"], r["dst"]) for r in edges.collect()]
    for r in rows:
        label = {x["pixel_id"]: x["cluster"] for x in clustering.cluster_pixels_hmrf(long, edges, 2, r["beta"]).collect()}
        at = np.array([label[i] for i in range(64)])
        data = sum(((z[at == c] - z[at == c].mean(0)) ** 2).sum() for c in set(label.values())) / 2
        cut = sum(label[a] != label[b] for a, b in pairs)
        assert (r["data_energy"], r["spatial_energy"], r["total_energy"]) == pytest.approx((data, r["beta"] * cut, data + r["beta"] * cut))
        assert r["boundary_edge_fraction"] == pytest.approx(cut / len(pairs)) and r["converged"] and r["n_iterations"] >= 1
    assert rows[2]["adjacent_pair_agreement"] >= rows[0]["adjacent_pair_agreement"] and len({r["tot_withinss"] for r in rows}) == 1


def test_nearest_search_reaches_far_rows(spark):
    at = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 1e9, 0.0), ("s", 3, 0.5, 0.0)], "section_id string, id long, x double, y double")
    got = {(r["src"], r["dst"], r["rank"]) for r in graph.knn_pairs(at, at, 2, 1.0).collect()}
    assert got == {(1, 1, 1), (1, 3, 2), (3, 3, 1), (3, 1, 2), (2, 2, 1), (2, 3, 2)}


def test_only_small_tables_get_a_hint(spark):
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(storage.small(spark.range(10), 10)) and not hinted(storage.small(spark.range(11), 10))


@needs_tables
def test_background_by_two_means_against_lloyd(spark):
    rows = QUERIES["background_kmeans"](spark, SF).collect()
    tic = {r["pixel_id"]: 0.0 for r in rows}
    for r in p1(spark, SF).select("pixel_id", "value").collect():
        tic[r["pixel_id"]] += r["value"]
    s = {i: np.log10(t + 1) for i, t in tic.items()}
    v = np.array(list(s.values()))
    a, b = np.quantile(v, [0.25, 0.75])
    for _ in range(50):
        cut = (a + b) / 2
        a, b = v[v < cut].mean(), v[v >= cut].mean()
    assert all(r["keep"] == (s[r["pixel_id"]] >= (a + b) / 2) for r in rows if abs(s[r["pixel_id"]] - (a + b) / 2) > 1e-9)


@needs_tables
def test_tissue_mask_against_flood_fill(spark):
    got = {r["pixel_id"]: r["tissue"] for r in QUERIES["tissue_mask_quantile"](spark, SF).collect()}
    cells = {}
    for r in p1(spark, SF).collect():
        t, n, *_ = cells.get((r["section_id"], r["x"], r["y"], r["pixel_id"]), (0.0, 0))
        cells[r["section_id"], r["x"], r["y"], r["pixel_id"]] = (t + r["value"], n + (r["value"] > 0))
    for section in {k[0] for k in cells}:
        keys = sorted(k for k in cells if k[0] == section)
        z = lambda x: (x - x.mean()) / x.std(ddof=1) if x.std() > 0 else x * 0
        score = (z(np.log1p([cells[k][0] for k in keys])) + z(np.log1p([float(cells[k][1]) for k in keys]))) / 2
        left = {(k[1], k[2]): k[3] for k, s in zip(keys, score, strict=True) if s >= np.quantile(score, 0.5)}
        parts = []
        while left:
            place, found = [next(iter(left))], []
            found.append(left.pop(place[0]))
            for x, y in place:
                for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if near in left:
                        place.append(near)
                        found.append(left.pop(near))
            parts.append(found)
        best = max(parts, key=lambda p: (len(p), -min(p)))
        assert {k[3] for k in keys if got[k[3]]} == set(best)


def test_grouped_thresholds_are_each_groups_own(spark):
    rows = [("a" if i < 20 else "b", i, "mz_1", float(i % 20 + 1) * (1 if i < 20 else 100)) for i in range(40)]
    long = spark.createDataFrame(rows, "section_id string, pixel_id long, feature string, value double")
    for method, options in (("tic_percentile", {"percentile": 0.5}), ("median_fraction", {"median_percent": 50})):
        got = {r["pixel_id"] for r in preprocess.background_mask(long, method, by=("section_id",), **options).where("keep").collect()}
        alone = {r["pixel_id"] for s in "ab" for r in preprocess.background_mask(long.where(f"section_id = '{s}'"), method, **options).where("keep").collect()}
        assert got == alone and 0 < len(got) < 40
