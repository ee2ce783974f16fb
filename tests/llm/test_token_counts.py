import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import token_counts
from lamella.llm.queries import op7_token_counts
from lamella.llm.token_counts import count_tokens, load_counter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = load_counter(MODEL)
PIECES = ["a", "the", " ", "  ", " " * 17, "\n", "é", "▁", "1", "ing", "😀", "Ａ", "中", "</s>", "<unk>", "xxxxx", "==", "\t", "http://", "."]
TEXTS = st.lists(st.sampled_from(PIECES) | st.characters(codec="utf-8"), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_chunks_compose(text):
    whole, token_counts.CHUNK = token_counts.CHUNK, 5
    try:
        assert COUNTER.count(text) == len(LIBRARY.encode(text))
    finally:
        token_counts.CHUNK = whole


def test_long_texts_and_forgetting():
    for text in ("word " * 40000, "x" * 150000, " " * 70000 + "end"):
        assert COUNTER.count(text) == len(LIBRARY.encode(text))
    COUNTER.transducer.forget()
    COUNTER.known.clear()
    assert COUNTER.count("once more") == len(LIBRARY.encode("once more"))


def test_states_are_dropped_inside_a_text(monkeypatch):
    text = "".join(chr(97 + i * i * 7919 % 26) for i in range(30000))
    monkeypatch.setattr(token_counts, "KNOWN_STATES", 50)
    for chunk in (1 << 16, 1000):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        COUNTER.known.clear()
        assert COUNTER.count(text) == len(LIBRARY.encode(text))
        assert len(COUNTER.transducer.known) <= 51
    assert COUNTER.count(text[:5000] + " the end " + text[5000:]) == len(LIBRARY.encode(text[:5000] + " the end " + text[5000:]))


def test_models_that_change_texts_are_refused(monkeypatch):
    class Folds(sentencepiece.SentencePieceProcessor):
        def normalize(self, text, **_):
            return super().normalize(text).lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folds)
    with pytest.raises(ValueError, match="changes texts"):
        load_counter(MODEL)


def test_query_against_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {k: (len(t.encode()), len(LIBRARY.encode(t)), len(LIBRARY.encode(t)) > 4096) for k, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op7_token_counts(spark, sf_dir).collect()} == want


def test_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "a b", 9), (3, "a b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, count_tokens(df, MODEL, 1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True), (3, 3, 2, True), (3, 3, 2, True)], key=str)
    assert count_tokens(df.limit(0), MODEL, 1).count() == 0
