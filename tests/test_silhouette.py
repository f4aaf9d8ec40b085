import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionfield.operators import clustering

SF = "/root/testdata/sf0.1"


def brute(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        others = [d[i][label == c].mean() for c in set(label) - {label[i]}]
        out.append((min(others) - d[i][same].mean()) / max(min(others), d[i][same].mean()) if same.any() and others else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [7, 2048])
def test_silhouette_of_all_rows_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "SILHOUETTE_BLOCK", block)
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 5)), rng.integers(1, 4, 60)
    label[0] = 9  # a cluster of one
    x[10:20] = x[10]  # copies
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "pixel_id long, v array<double>")
    labels = spark.createDataFrame([(i, int(label[i])) for i in range(60)], "pixel_id long, cluster int")
    s, n = clustering.silhouette(vectors, labels, None).first()
    assert n == 60 and s == pytest.approx(brute(x, label), abs=1e-9)
    assert clustering.silhouette(vectors, labels).first()[0] == pytest.approx(s, abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_takes_every_pixel_and_feature(spark):
    from ionfield.plans.catalogue import QUERIES

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("vec_id", F.transform("embedding", lambda e: F.abs(e.cast("double")))).collect()
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    s, n = QUERIES["silhouette_given"](spark, SF).first()
    assert n == len(rows) and s == pytest.approx(brute(x, np.where((ids % 25 + ids // 25) % 7 < 3, 1, 2)), abs=2e-6)


def test_pairs_of_blocks_are_taken_once(spark, monkeypatch):
    """Tasks hold two whole blocks and use a tile of distances for both directions: n (n + 1) / 2 pairs of blocks."""
    monkeypatch.setattr(clustering, "SILHOUETTE_BLOCK", 5)
    monkeypatch.setattr(clustering, "SILHOUETTE_ROWS", 11)
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(50, 6)) + 100, rng.integers(1, 4, 50)
    x[3:6] = x[3] + 1e-7 * rng.normal(size=(3, 6))  # the product form would lose these distances
    rows = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(50)], "pixel_id long, v array<double>, cluster int")
    s, n = clustering.silhouette(rows.select("pixel_id", "v"), rows.select("pixel_id", "cluster"), None).first()
    assert n == 50 and s == pytest.approx(brute(x, label), abs=1e-9)
