import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionfield.llm import toxicity as tox
from ionfield.llm.langid import crc_residue
from tests.llm.conftest import clashing, docs_frame

BAD = ["blorg", "snarfle", "grunk"]


@pytest.fixture(scope="module")
def labelled(words):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                body.insert(rng.randrange(len(body)), rng.choice(BAD))
        rows.append((i, " ".join(body), toxic))
    return rows


def test_model_on_held_out_rows(spark, labelled):
    docs = docs_frame(spark, [(i, t) for i, t, _ in labelled])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in labelled], "doc_id long, quality int, toxic int")
    held = crc_residue(F.col("doc_id"), 3) == 1
    model = tox.train(docs, labels, ~held)
    assert set(BAD) <= set(model.lexicon.weights) and len(model.lexicon.weights) < 12
    truth = {i: y for i, _, y in labelled}
    rows = tox.score(docs, model).withColumn("held", held).where("held").collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    wrong = sum((r["score"] >= 0.7) != bool(truth[r["doc_id"]]) for r in rows)
    assert wrong <= 0.03 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, labelled):
    docs = docs_frame(spark, [(i, t) for i, t, _ in labelled])
    schema = "doc_id long, quality int, toxic int"
    held = crc_residue(F.col("doc_id"), 3) == 1
    texts = [t for _, t, _ in labelled[:50]]
    out = []
    for flip in (False, True):
        rows = [(i, 0, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in labelled]
        out.append(tox.train(docs, spark.createDataFrame(rows, schema), ~held).score(texts))
    assert np.array_equal(*out)


def test_odd_documents_and_missing_labels(spark, odd_docs):
    frame = clashing(spark, odd_docs)
    none = spark.createDataFrame([(7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = tox.train(frame, none, F.lit(True))
    rows = tox.score(frame, model).collect()
    assert len(rows) == len(odd_docs) and {r["score"] for r in rows} == {0.0}
    one = tox.train(frame, none.union(spark.createDataFrame([(8, 0, 1), (7, 0, 1)], none.schema)), F.lit(True))
    assert {r["score"] for r in tox.score(frame, one).collect()} == {1.0}
    assert tox.score(docs_frame(spark, []), one).collect() == []


def test_features_see_whole_long_texts(words):
    lexicon = tox.Lexicon({"blorg": 5.0})
    long = "fine " * 100_000 + "you blorg!"
    f = dict(zip(tox.FEATURES, tox.features(long, lexicon), strict=True))
    assert f["hits"] > 0 and f["proximity"] == 0.5 and f["exclamations"] > 0
    assert dict(zip(tox.FEATURES, tox.features("you bl0rg", lexicon), strict=True))["obfuscated_density"] > 0
    assert tox.features("xblorg blorgs", lexicon)[2] == 0 and tox.features(None, lexicon) == [0.0] * len(tox.FEATURES)


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 8, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    knots, values = tox.pool_adjacent_violators(s, y)
    fit = np.interp(np.unique(s), knots, values)
    assert (np.diff(fit) >= -1e-12).all()
    xs = np.unique(s)
    w, m = np.array([(s == x).sum() for x in xs]), np.array([y[s == x].mean() for x in xs])
    expected = [max(min(np.average(m[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    assert fit == pytest.approx(expected)


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = tox.BoostedTrees().fit(x[:600], y[:600])
    assert ((model.raw(x[600:]) > 0) == y[600:]).mean() > 0.93


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_accuracy_on_the_tables(spark):
    from ionfield.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9 and hit / sum(r["toxic"] for r in rows) > 0.65
