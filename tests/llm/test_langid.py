import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionfield.llm import langid
from tests.llm.conftest import EXTRA, clashing


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    parts = {"aa": ["lo", "ma", "ti", "ro"], "bb": ["sch", "ein", "ung", "keit"], "cc": ["ção", "é", "eau", "ñ"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(5, 60))), lang) for i, lang in enumerate(rng.choice(sorted(parts)) for _ in range(300))]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = langid.ByteGRU(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 5, (6, 4)).astype(np.uint8)
    y, mask = np.array([0, 1, 1, 0]), np.ones((6, 4))
    mask[4:, 1] = 0
    _, grad = net.gradients(x, y, mask)
    for name, at in (("u", (0, 4, 1)), ("u", (1, 7, 2)), ("x", (0, 1, int(x[0, 0]))), ("x", (1, 8, int(x[2, 1]))), ("o", (1, 0, 2)), ("b", (1, 0))):
        step = 1e-3
        old = net.p[name][at]
        net.p[name][at] = old + step
        up, _ = net.gradients(x, y, mask)
        net.p[name][at] = old - step
        down, _ = net.gradients(x, y, mask)
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5)


def test_fast_pass_is_the_trained_pass():
    rng = np.random.default_rng(1)
    net = langid.ByteGRU(["a", "b", "c"], hidden=4)
    x = rng.integers(0, 256, (langid.WINDOW, 5)).astype(np.uint8)
    kept = net._step_all(x)
    logits = np.zeros((langid.WINDOW, 3, 5)) + net.p["b"]
    for d in range(2):
        for t, *_, new in kept[d]:
            logits[t] += net.p["o"][d] @ new
    expected = np.exp(logits - logits.max(1, keepdims=True))
    assert net.position_probabilities(x) == pytest.approx(expected / expected.sum(1, keepdims=True), abs=1e-4)


def test_pooling_covers_whole_texts():
    net = langid.ByteGRU(["a", "b"], hidden=4)
    texts = [b"", b"x" * 10, b"y" * 200, bytes(range(1, 255)) * 3]
    out = net.document_probabilities(texts)
    assert out[0].tolist() == [0, 0]
    for raw, got in zip(texts[1:], out[1:], strict=True):
        windows = [raw[i : i + 64] for i in range(0, len(raw), 64)]
        total = np.zeros(2)
        for w in windows:
            x = np.frombuffer(w + bytes(64 - len(w)), np.uint8)[:, None]
            total += net.position_probabilities(x)[: len(w), :, 0].sum(0)
        assert got == pytest.approx(total / len(raw), abs=1e-5)


def test_pooling_over_letters():
    net = langid.ByteGRU(["a", "b"], hidden=4)
    texts = [b"abc 12", "é 9é".encode() * 40, b"12 34", b"", b"x" * 64]
    out = net.document_probabilities(texts, True)
    assert out[2].tolist() == [0, 0] and out[3].tolist() == [0, 0]
    for raw, got in zip(texts, out, strict=True):
        total, n = np.zeros(2), 0
        for w in (raw[i : i + 64] for i in range(0, len(raw), 64)):
            x = np.frombuffer(w + bytes(64 - len(w)), np.uint8)[:, None]
            letter = np.array([b >= 128 or chr(b).isalpha() for b in w])
            total += net.position_probabilities(x)[: len(w), :, 0][letter].sum(0)
            n += letter.sum()
        assert got == pytest.approx(total / max(n, 1), abs=1e-5)


def test_held_out_accuracy_and_odd_rows(spark, corpus, odd_docs):
    rows = [(i, t, lang if i % 10 else None, "s", 1, 1, 2, "b", "h", "x", "y", 5, 6) for i, t, lang in corpus]
    docs = spark.createDataFrame(rows, EXTRA)
    held = langid.crc_residue(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held)
    truth = {i: lang for i, _, lang in corpus}
    out = langid.identify(docs, model).withColumn("held", held).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held_rows = [r for r in out if r["held"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held_rows) >= 0.97 * len(held_rows)
    odd = {r["doc_id"]: r for r in langid.identify(clashing(spark, [(i, t) for i, t in odd_docs if i != 13] + [(50, "123 %%% _"), (51, "١٢"), (52, "x² ½"[1:]), (53, "Ⅷ ①")]), model).collect()}
    for i in (1, 2, 3, 50, 51, 52, 53):
        assert (odd[i]["lang_pred"], odd[i]["score"]) == ("und", 0.0)
    assert odd[4]["lang_pred"] in model.labels[:-1] and 0 < odd[10]["score"] <= 1
    kept = langid.keep_identified(docs.unionByName(spark.createDataFrame([(9999, "123", "en", "s", 1, 1, 2, "b", "h", "x", "y", 5, 6)], EXTRA)), model)
    assert kept.columns == docs.columns and kept.where("doc_id = 9999").isEmpty() and kept.count() >= 0.95 * len(corpus)


def test_nothing_to_learn(spark, odd_docs):
    docs = clashing(spark, odd_docs)
    assert langid.train(docs, F.lit(False)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.where(F.lit(False)), None).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_accuracy_on_the_tables(spark):
    from ionfield.llm.queries import op7_language

    sf = "/root/testdata/sf0.01"
    rows = op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_stage_drops_what_is_in_no_learned_language(spark, corpus):
    """Junk, codes, other scripts and unwanted languages go; learned languages stay, mixed in one text too."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = lambda: " ".join("".join(rng.choices(letters, k=rng.randint(2, 10))) for _ in range(40))
    by_lang = {}
    for _, text, lang in corpus:
        by_lang.setdefault(lang, []).append(text)
    bad = [junk() for _ in range(10)] + ["Съешь же ещё этих мягких французских булок. " * 4, "我能吞下玻璃而不伤身体。" * 9, "4f!x 9-- 77;; 0x0 %% 3 ## 12 == a 9 " * 5, None, "", "²½Ⅷ"]
    mixed = [f"{a} {b} {c}" for a, b, c in zip(*(v[:10] for v in by_lang.values()), strict=True)]
    rows = [(i, t, lang, "s", 1) for i, t, lang in corpus] + [(1000 + i, t, None, "s", 1) for i, t in enumerate(bad)] + [(2000 + i, t, None, "s", 1) for i, t in enumerate(mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs, F.lit(True))
    kept = {r["doc_id"] for r in langid.keep_identified(docs, model).collect()}
    assert not [i for i in kept if 1000 <= i < 2000]
    assert len([i for i in kept if i >= 2000]) == len(mixed) and len([i for i in kept if i < 1000]) >= 0.99 * len(corpus)
    beside = [f"{t[:60]} +1 (634) 555-5003 4162727784048781 74.129.143.235" for t in by_lang["aa"][:10]]
    short = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(beside)], docs.schema)
    assert langid.keep_identified(short, model).count() == 10
    wanted = {r["doc_id"] for r in langid.keep_identified(docs, model, ["aa"]).collect()}
    names = {i: lang for i, _, lang in corpus}
    assert {names[i] for i in wanted if i < 1000} == {"aa"}
