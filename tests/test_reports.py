import numpy as np
import pytest

from ionfield.operators import reports


def test_orientation():
    a = np.arange(6.0).reshape(2, 3)
    for values, n, m, source in ((a, 2, 3, "features_x_spectra"), (a, 3, 2, "spectra_x_features")):
        out, found = reports.orient_intensities(values, n, m)
        assert found == source and out.shape == (m, n)
    assert reports.orient_intensities(np.eye(2) + a[:, :2], 2, 2)[1] == "features_x_spectra"
    with pytest.raises(ValueError):
        reports.orient_intensities(a, 4, 4)


def test_roi_target(spark):
    clusters = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "cluster string")
    assert reports.roi_target(clusters) == {"a": 0.5, "b": 0.5}
    assert reports.roi_target(clusters, prior={"a": 3.0}) == {"a": 0.75, "b": 0.25}
    for prior in ({"z": 1.0}, {"a": -1.0}, {"a": float("nan")}, {"a": 0.0, "b": 0.0}):
        with pytest.raises(ValueError):
            reports.roi_target(clusters, prior=prior)
    with pytest.raises(ValueError):
        reports.roi_target(clusters.where("cluster = 'none'"))


def test_score_plot_without_groups_and_without_scores(spark):
    scores = spark.createDataFrame([("s1", 1.0, 2.0)], "Sample string, Comp1 double, Comp2 double")
    assert reports.score_plot(scores).first().asDict() == {"Sample": "s1", "x": 1.0, "y": 2.0, "Group": "Sample"}
    samples = spark.createDataFrame([("s1", 4)], "sample_id string, cluster int")
    assert reports.score_plot(scores, samples, "Comp2", "Comp1").first().asDict() == {"Sample": "s1", "x": 2.0, "y": 1.0, "Group": "Region_4"}
    with pytest.raises(ValueError):
        reports.score_plot(scores.drop("Comp2"))


def test_peak_list_edges(spark):
    rows = [("mz_100.5_feature_2", 0.0, 1.0), ("mz_7", None, float("nan")), ("mz_8", float("nan"), float("inf")), ("note", 0.1, 0.1)]
    got = {r["m.z"]: (r["p.value"], r["t.score"]) for r in reports.functional_peak_list(spark.createDataFrame(rows, "feature string, p_value double, effect_size double")).collect()}
    assert got == {100.5: (reports.LEAST_P, 1.0), 7.0: (1.0, 0.0), 8.0: (1.0, 0.0)}


def test_listed_pixels_that_are_absent_do_not_count(spark):
    samples = spark.createDataFrame([("s", "1,2,9"), ("t", "9"), ("u", None)], "sample_id string, pixel_ids string")
    long = spark.createDataFrame([(1, "mz_1", 2.0), (2, "mz_1", 4.0), (3, "mz_1", 100.0)], "pixel_id long, feature string, value double")
    assert [tuple(r) for r in reports.average_listed_pixels(samples, long).collect()] == [("s", "mz_1", 3.0, 2)]


def test_feature_view_needs_its_rank(spark):
    result = spark.createDataFrame([("mz_1", 1.0), ("mz_2", 5.0)], "Feature string, VIP double")
    long = spark.createDataFrame([("mz_1", 0, 0, 7.0), ("mz_2", 0, 0, 8.0)], "feature string, x int, y int, value double")
    assert [r["value"] for r in reports.feature_view(result, long, 2)[1].collect()] == [7.0]
    with pytest.raises(ValueError):
        reports.feature_view(result, long, 3)
