import hashlib
import os

import numpy as np
import pytest

from ionfield.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The first 40 pixels, as a data folder of their own."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 40").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def brute(spark, folder):
    """{feature: (I, p, C, p)} with 199 permutations, by the definition."""
    table = sorted((r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, v = np.array([t[0] for t in table]), np.abs(np.array([t[1] for t in table], dtype=float))
    at = {(i % 25, i // 25): n for n, i in enumerate(ids)}
    e = np.array([(n, at[x + dx, y + dy]) for (x, y), n in at.items() for dx, dy in ((1, 0), (0, 1)) if (x + dx, y + dy) in at])
    assert len(set(e.ravel())) == len(ids)
    c = v - v.mean(0)

    def both(x):
        ss = (c**2).sum(0)
        return len(ids) / len(e) * (x[e[:, 0]] * x[e[:, 1]]).sum(0) / ss, (len(ids) - 1) / (2 * len(e)) * ((x[e[:, 0]] - x[e[:, 1]]) ** 2).sum(0) / ss

    i, g = both(c)
    more, less = np.ones(64), np.ones(64)
    for perm in range(1, 200):
        order = sorted(range(len(ids)), key=lambda n: (hashlib.md5(f"1|{perm}|{ids[n]}".encode()).hexdigest(), ids[n]))
        x = np.empty_like(c)
        x[order] = c
        a, b = both(x)
        more += a >= i - 1e-9
        less += b <= g + 1e-9
    return {f"mz_{101 + f}": (i[f], more[f] / 200, g[f], less[f] / 200) for f in range(64)}


def bh(p):
    order = np.argsort(p)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    return out


def test_permutations_of_all_features_are_brute_force(spark, small):
    want = brute(spark, small)
    for name, at in (("moran_perm", 0), ("geary_perm", 2)):
        got = {r.feature: (r.statistic, r.p_value) for r in QUERIES[name](spark, small).collect()}
        assert got.keys() == want.keys()
        for f, w in want.items():
            assert got[f] == pytest.approx(w[at : at + 2], abs=2e-6)
    names = sorted(want)
    a, b = bh([want[f][1] for f in names]), bh([want[f][3] for f in names])
    got = {r.feature: r for r in QUERIES["compare_svg"](spark, small).collect()}
    for f, x, y in zip(names, a, b, strict=True):
        assert (got[f].moran_p, got[f].geary_p) == pytest.approx((x, y), abs=2e-6)
        assert got[f].agreement == ("both" if x < 0.05 and y < 0.05 else "moran_only" if x < 0.05 else "geary_only" if y < 0.05 else "neither")


def test_queries_without_sql_bind_every_feature(spark, monkeypatch):
    from ionfield.plans import q_clustering, q_differential, q_labels

    seen = []
    real = q_clustering.p2

    def spy(spark, sf, n_features=64):
        seen.append(n_features)
        return real(spark, sf, n_features)

    monkeypatch.setattr(q_clustering, "p2", spy)
    monkeypatch.setattr(q_differential, "p2", spy)
    monkeypatch.setattr(q_labels, "p2", spy)
    for name in ("kmeans_domains", "potts_icm", "distance_gradient"):
        QUERIES[name](spark, SF)
    assert {r.feature for r in QUERIES["spatial_lmm"](spark, SF).select("feature").collect()} == {f"mz_{i}" for i in range(101, 165)}
    assert seen == [64] * 4
