import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlens.llm import token_counts as TC
from tests.conftest import SF_MID

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    return len(TC.tokenizer(PATH).encode(text, add_special_tokens=False).ids)


PIECES = st.sampled_from(["the ", "don't", "'ll", " ", "  ", "\n\n", "é", "日本", "12345", "!!!", "<|endoftext|>",
                          "<|endof", "a" * 90, " " * 70, "#$%", "\t", "word", "😀", "ing "])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=120), st.integers(40, 200), st.integers(1, 60))
def test_splices_equal_the_whole(pieces, chunk, overlap):
    text = "".join(pieces)
    assert TC.count_long(TC.tokenizer(PATH), text, chunk, overlap) == whole(text)


@pytest.mark.parametrize("text", ["", "a", "a" * 5000, " " * 5000, "ab " * 3000, "<|endoftext|>" * 400, "é\n" * 2000])
def test_splices_of_plain_long_texts(text):
    assert TC.count_long(TC.tokenizer(PATH), text, 300, 20) == whole(text)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in TC.count_tokens(docs, PATH, 512, chunk=4000, overlap=100).collect():
        n = whole(texts[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_odd_rows(make, odd):
    rows = TC.count_tokens(make(odd), PATH, 512).collect()
    want = [(i, len((t or "").encode()), whole(t or "")) for i, t in odd]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == sorted(want, key=str)
    assert TC.count_tokens(make([]), PATH, 512).collect() == []
