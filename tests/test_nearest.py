from ionfield.operators.matching import nearest_intensity


def test_peaks_of_equal_mass_give_the_least_intensity(spark):
    rows = [(i, [5.0, 5.0, 5.0, 4.0], order) for i, order in enumerate(([7.0, 3.0, 9.0, 1.0], [3.0, 7.0, 9.0, 1.0], [9.0, 7.0, 3.0, 1.0]))]
    spectra = spark.createDataFrame(rows, "pixel_id long, mz array<double>, intensity array<double>")
    targets = spark.createDataFrame([("mz_5", 5.001)], "feature string, target double")
    assert {r.value for r in nearest_intensity(spectra, targets, 1000).collect()} == {3.0}
