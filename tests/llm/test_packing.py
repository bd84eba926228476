import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlens.llm import packing as P
from chatlens.llm.queries import op12_packing
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODE = P.Encoder(PATH)


def whole(text):
    return P.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [1]


PIECES = st.sampled_from(["The ", "don't", "'ll", " ", "\n\n", "é", "e", "́", "日本", "12345", "!!!", "<|endoftext|>",
                          "<|endof", "a" * 90, "#$%", "\t", "word", "😀", "ing ", " ", " ", "\x85", "Σ", "ΑΣ ",
                          "ͅ", "\x00", "ᄀ", "ᅡ", "İ", "</w>"])


@settings(max_examples=800, deadline=None)
@given(st.lists(PIECES, max_size=60))
def test_ids_of_words_are_the_texts_ids(pieces):
    text = "".join(pieces)
    encode = P.Encoder(PATH, known=5)
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u2").tolist() == whole(text)[:-1]
        assert encode.by_word(text) == encode(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.characters(max_codepoint=P.PLAIN + 5, exclude_categories=["Cs"]), max_size=80))
def test_quick_ids_of_plain_characters(text):
    assert np.frombuffer(ENCODE(text), "<u2").tolist() == whole(text)[:-1]


def test_quick_way_is_taken_where_it_may_be():
    assert ENCODE.quick is not None
    assert P.Encoder(public_tokenizers.path("byte_bpe_50k.json")).quick is None
    for c in range(P.PLAIN):
        text = f"ab{chr(c)}cd {chr(c)}{chr(c)} 'S{chr(c)}'ll"
        assert np.frombuffer(ENCODE(text), "<u2").tolist() == whole(text)[:-1], hex(c)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing_like_a_plain_search(sizes):
    plain = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b in plain:
            if sum(sizes[i] for i in b) + sizes[k] <= 20:
                b.append(k)
                break
        else:
            plain.append([k])
    assert P.first_fit_decreasing(sizes, 20) == plain


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_pieces_hold_each_id_once_and_need_no_padding(sizes):
    seen = defaultdict(list)
    for sequence in P.pack(sizes, 32):
        used = sum(n for _, _, n in sequence)
        assert 0 < used <= 32 and used & (used - 1) == 0
        for d, start, n in sequence:
            seen[d] += range(start, start + n)
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(sizes))


def check(rows, docs):
    """Rows of pack_documents against the ids of (doc_id, text) rows."""
    texts = defaultdict(list)
    for i, text in docs:
        texts[i].append(whole(text))
    places, found = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        places[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append((r.start, r.doc_tokens, ids))
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    for i, some in found.items():
        for ids in {tuple(x) for x in texts[i]}:
            own = sorted((s, x) for s, n, x in some if n == len(ids) and list(ids[s:s + len(x)]) == x)
            assert sum(len(x) for _, x in own) >= len(ids)
        assert sum(len(x) for _, _, x in some) == sum(len(x) for x in texts[i])
    assert set(found) == set(texts)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = P.pack_documents(docs, PATH, 1, group=50).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.sequence_id >> 32 for r in rows}) > 1


def test_query_of_the_whole_table(spark):
    df = op12_packing(spark, SF_SMALL)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    texts = {r.doc_id: whole(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    at = defaultdict(int)
    for r in df.orderBy("doc_id", "start").collect():
        ids = texts[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids)
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert at == {i: len(x) for i, x in texts.items()}


def test_odd_rows(make, odd):
    check(P.pack_documents(make(odd), PATH, 1).collect(), odd)
    check(P.pack_documents(make(odd), PATH, 1, group=2).collect(), odd)
    assert P.pack_documents(make([]), PATH, 1).collect() == []
