import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ionfield.llm import packing
from tests.llm.conftest import clashing, docs_frame

FILES = [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
TOKENIZER, ENCODER = Tokenizer.from_buffer(FILES[0]), packing.Encoder(*FILES)


def ids(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30) | st.text(alphabet=" \n\ta'slé.1", max_size=30) | st.just("x <|endoftext|> y"), max_size=4))
def test_ids_are_the_library_s(texts):
    assert ENCODER.encode(texts) == [ids(t) for t in texts]


def check(spark, rows, frame=None, window=1024):
    out = packing.pack(frame if frame is not None else docs_frame(spark, rows), window=window).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, ts in texts.items():
        raw = ids(ts[0] or "") + bytes(4)
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ts) * len(raw) // 4
        for r in pieces:
            assert r["doc_tokens"] == len(raw) // 4 and r["length"] > 0
            assert zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    short = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        short += at < window
    assert short <= 1
    assert set(by_doc) == set(texts)


def test_odd_documents(spark, odd_docs):
    check(spark, odd_docs, clashing(spark, odd_docs))


def test_one_length_only(spark):
    check(spark, [(i, "same text again " * 40) for i in range(200)])


def test_small_windows_and_partitions(spark, words):
    rows = [(i, " ".join(words[: i % 37])) for i in range(500)]
    check(spark, rows, docs_frame(spark, rows).repartition(9), 64)


def test_joined_ranks(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    check(spark, odd_docs)


def test_empty(spark):
    assert packing.pack(docs_frame(spark, [])).collect() == []


def test_nnls_solves_a_known_system():
    columns = np.array([[0, 1, -1], [0, 0, 2], [1, 1, -1]])
    x = np.array([3.0, 2.0, 0.0])
    target = np.array([3 + 4, 3, 2.0])
    assert packing.solve_nnls(columns, target, 3000) == pytest.approx(x, abs=1e-2)


def test_plan_fills_windows_exactly():
    """A histogram made of known combinations is packed almost whole, and nothing is invented."""
    rng = np.random.default_rng(0)
    hist = {}
    for _ in range(40):
        a = int(rng.integers(1, 40))
        b = int(rng.integers(1, 63 - a))
        for v in (a, b, 64 - a - b):
            hist[v] = hist.get(v, 0) + 50
    patterns, left = packing.plan_windows(hist, 64)
    used = dict.fromkeys(hist, 0)
    for combo, n in patterns:
        assert sum(combo) == 64 and n > 0
        for v in combo:
            used[v] += n
    assert all(used[v] + left[v] == hist[v] for v in hist)
    assert sum(v * n for v, n in left.items()) < 0.1 * sum(v * n for v, n in hist.items())
    assert packing.plan_windows({5: 3}, 64) == ([], {5: 3})
