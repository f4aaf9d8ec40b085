"""Packed pixels give what the long form gives, and thresholds are exact without all values meeting in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionfield.functions.expressions import quantile_table
from ionfield.operators import preprocess, regions
from ionfield.operators.pixels import Packed


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(5)
    v = np.where(rng.random((400, 7)) < 0.5, 0.0, rng.integers(1, 900, (400, 7)) / 7.0)
    rows = [("ab"[i % 2], i, i % 20, i // 20, v[i].tolist()) for i in range(400)]
    packed = Packed(spark.createDataFrame(rows, "section_id string, pixel_id long, x long, y long, v array<double>").cache(), [f"mz_{f}" for f in range(7)])
    return packed, packed.long()


def close(a, b):
    a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.select(*a.columns).collect()))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("method", ["tic_percentile", "median_fraction", "log_tic_kmeans", "gap_otsu_log_tic", "trimmed_otsu_log_tic", "median_otsu_log_tic"])
def test_masks_of_packed_rows(both, method):
    packed, long = both
    close(preprocess.background_mask(packed, method, excluded=["mz_3"]), preprocess.background_mask(long, method, excluded=["mz_3"]))


def test_background_kmeans_reads_its_source_once(spark, both, monkeypatch):
    """Lloyd's iterations run over the written scores; before, each computed all totals anew."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = both[0].rows
    counted = Packed(rows.mapInArrow(pass_on, rows.schema), both[0].features)
    assert preprocess.background_mask(counted, "log_tic_kmeans").count() == 400
    assert seen.value == 400


@pytest.mark.parametrize("p", [0.0, 0.1, 0.37, 0.5, 1.0])
def test_quantiles_are_exact(spark, p):
    rng = np.random.default_rng(2)
    sets = {"many": rng.normal(size=30_000), "ties": rng.integers(0, 3, 5_000) * 1.5, "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in sets.items() for x in v] + [("many", None)], "g string, v double")
    got = {r.g: r.cut for r in quantile_table(rows, F.col("v"), p, ("g",)).collect()}
    assert got == pytest.approx({k: np.quantile(v, p) for k, v in sets.items()}, abs=1e-12)
