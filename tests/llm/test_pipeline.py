import os

import pytest

import corpus_pipeline
from ionfield.llm import decontaminate, secrets
from ionfield.storage import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        tables[name] = docs
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0.7 * sizes[0]
    bench = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r["text"] for r in tables["decontamination"].collect()]
    assert not any(b in decontaminate.normalise(t) for t in kept for b in bench)
    assert secrets.scan(tables["secret_scan"]).where("n_hex + n_access > 0").isEmpty()
    packed = tables["packing"]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in tables["secret_scan"].collect()}
    assert sorted(corpus_pipeline.run(spark, SF).columns) == sorted(packed.columns)


def test_no_stage_fails_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_against_brute_force(spark):
    """Every stage's decisions on the whole table, from the definitions."""
    import numpy as np
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from ionfield.llm import langid
    from tests.llm.test_decontaminate import best_edits
    from tests.llm.test_secrets import base_spans
    from tests.llm.test_simhash import slow_components, slow_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = made[name] = materialize(stage(spark, docs, SF), name)
    ids = lambda name: sorted(r["doc_id"] for r in made[name].select("doc_id").collect())

    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), langid.crc_residue(F.col("doc_id"), 4) != 2)
    kept = []
    for i, text in rows.items():
        raw = (text or "").encode()
        share, n_letters = np.zeros(len(model.labels)), 0
        for at in range(0, len(raw), langid.WINDOW):
            w = raw[at : at + langid.WINDOW]
            x = np.frombuffer(w + bytes(langid.WINDOW - len(w)), np.uint8)[:, None]
            letter = np.array([b >= 128 or chr(b).isalpha() for b in w])
            share += model.position_probabilities(x)[: len(w), :, 0][letter].sum(0)
            n_letters += letter.sum()
        if any(c.isalpha() for c in text or "") and share[-1] < 0.5 * n_letters:
            kept.append(i)
    assert ids("language_id") == sorted(kept)

    roots = slow_components([slow_fingerprint(rows[i]) for i in kept])
    least = {}
    for i, r in zip(kept, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    kept = sorted(least.values())
    assert ids("near_dedup") == kept and len(kept) < len(rows)

    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda t: any(best_edits(m, t) <= int(decontaminate.RATE * len(m)) for m in items if m)
    gone = set(kept) - set(ids("decontamination"))
    some = sorted(gone)[:10] + [i for i in kept if i not in gone][:10]
    assert gone and all(leaks(decontaminate.normalise(rows[i])) == (i in gone) for i in some)

    assert ids("secret_scan") == sorted(set(kept) - gone)
    for r in made["secret_scan"].collect():
        text, out, end = rows[r["doc_id"]], "", 0
        for _, a, b in base_spans(text):
            if a >= end:
                out, end = out + text[end:a] + "[SECRET]", b
            else:
                end = max(end, b)
        assert r["text"] == out + text[end:]

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = {}
    for p in made["packing"].orderBy("doc_id", "start").collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    for r in made["secret_scan"].collect():
        n = len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
        mine = pieces[r["doc_id"]]
        assert sum(p["length"] for p in mine) == n == mine[0]["doc_tokens"]
        assert [p["start"] for p in mine] == [sum(q["length"] for q in mine[:k]) for k in range(len(mine))]
