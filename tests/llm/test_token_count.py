import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.token_count import PairMerger, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MERGER = PairMerger(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab  ▁\n<s>/é①", max_size=60)))
def test_counts_are_those_of_the_library(text):
    assert MERGER.count(text) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("text", ["", " ", "   ", "a" * 50_000, "the quick brown fox " * 3000, "<s></s><unk><0x0A>", "▁▁a b", "\x00\t\r\n", "日本語テキスト" * 200])
def test_corner_texts(text):
    assert MERGER.count(text) == len(LIBRARY.encode(text))


def test_table(spark):
    rows = [(1, None, "x"), (1, "hello world", "y"), (None, "é ", "z"), (3, "w " * 5000, None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
