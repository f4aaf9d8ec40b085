import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ionfield.llm.token_counts import PieceCounter, count_tokens, pre_tokens
from tests.llm.conftest import clashing, docs_frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = PieceCounter(open(MODEL, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40) | st.text(alphabet=" ▁ab\n.é", max_size=30))
def test_sum_of_pre_tokens(text):
    if text:
        keys = pre_tokens(text)
        found = COUNTER.lengths(sorted(set(keys)))
        assert sum(found[k] for k in keys) == len(SP.encode(text))


def test_whole_table(spark, odd_docs):
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in count_tokens(clashing(spark, odd_docs)).collect()))
    assert got == sorted(((i or -1, len((t or "").encode()), len(SP.encode(t or ""))) for i, t in odd_docs))


def test_small_cache_and_table(spark, odd_docs, monkeypatch):
    from ionfield.llm import token_counts

    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 50)
    counter = PieceCounter(open(MODEL, "rb").read())
    assert counter.lengths(["x" * 100])["x" * 100] == len(SP.encode("x" * 100))
    assert count_tokens(docs_frame(spark, odd_docs), table_size=3, per_task=2).count() == len(odd_docs)


def test_empty(spark):
    assert count_tokens(docs_frame(spark, [])).collect() == []
